"""Identifiers, locators, dates and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike letters of locators, kinds of identifiers.
LOOKALIKES = ("аАІіХхСсВѴ", "aAIiXxCcVV")
ELI_KINDS = {"R": "reg", "L": "dir", "D": "dec"}
ELI_TAILS = ("html", "pdf", "xml", "xhtml", "txt", "rdf", "fmx4", "mul")
CASE_KINDS = {"C": "JOC", "T": "JO", "F": "JO"}
CENTURY = 53


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def evidence_id(*parts: Column) -> Column:
    """`ev-` and 24 hex digits of the hash of the parts joined by bars; nulls count as empty."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit("ev-"), F.substring(content_hash(joined), 1, 24))


def source_key(order: Column, document: Column, path: Column, version: Column, language: Column) -> Column:
    """Address of a text: five fields joined by bars, order in capitals, language in small letters."""
    def norm(x: Column) -> Column:
        return F.coalesce(F.trim(x.cast("string")), F.lit(""))

    return F.concat_ws("|", F.upper(norm(order)), norm(document), norm(path), norm(version), F.lower(norm(language)))


def document_id(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(x), "^/+|/+$", ""))


def subdivision(x: Column) -> Column:
    """A subdivision's name without its labels, spaces and marks at the ends."""
    low = F.trim(x)
    for _ in range(3):
        low = F.trim(F.regexp_replace(low, r"(?iu)^(?:articles?|art\.?|стаття|статті|ст\.?|пункт|п\.?|частина|ч\.?|paragraphs?|paras?\.?|points?|§+|nos?\.?)\s*", ""))
    return F.lower(F.regexp_replace(F.regexp_replace(low, r"(?U)\s+", ""), "^[.,;]+|[.,;]+$", ""))


def eli(celex: Column) -> Column:
    """The European identifier of a regulation, directive or decision; null for anything else."""
    shape = r"^\d(\d{4})([A-Z])(\d+)$"
    kind = F.regexp_extract(F.trim(celex), shape, 2)
    word = F.coalesce(*(F.when(kind == k, v) for k, v in ELI_KINDS.items()))
    number = F.regexp_replace(F.regexp_extract(F.trim(celex), shape, 3), "^0+(?=[0-9])", "")
    return F.when(word.isNotNull(), F.concat(F.lit("http://data.europa.eu/eli/"), word, F.lit("/"), F.regexp_extract(F.trim(celex), shape, 1), F.lit("/"), number, F.lit("/oj")))


# The languages of European law and those of human-rights case law, two letters to three.
EU_LANGUAGES = {
    "bg": "bul", "cs": "ces", "da": "dan", "de": "deu", "el": "ell", "en": "eng", "es": "spa", "et": "est", "fi": "fin", "fr": "fra", "ga": "gle", "hr": "hrv",
    "hu": "hun", "it": "ita", "lt": "lit", "lv": "lav", "mt": "mlt", "nl": "nld", "pl": "pol", "pt": "por", "ro": "ron", "sk": "slk", "sl": "slv", "sv": "swe",
}
ECHR_LANGUAGES = {"en": "ENG", "fr": "FRA", "ru": "RUS", "uk": "UKR", "de": "GER", "it": "ITA", "es": "SPA", "tr": "TUR", "pl": "POL", "ro": "ROM", "lv": "LAV", "lt": "LIT"}


def language_code(x: Column, codes: dict[str, str] = EU_LANGUAGES) -> Column:
    """The three-letter code of a two-letter one, English if it is empty; null for a language that isn't covered."""
    low = F.coalesce(F.nullif(F.lower(F.trim(x)), F.lit("")), F.lit("en"))
    return F.try_element_at(F.create_map(*(F.lit(v) for pair in codes.items() for v in pair)), low)


def normal_eli(x: Column, languages: tuple[str, ...] = tuple(EU_LANGUAGES.values())) -> Column:
    """Canonical form of a European identifier, without formats and languages at its end; null if it is none, empty if it is broken."""
    raw = F.regexp_extract(F.trim(x), r"^[^?#]*", 0)
    start = r"(?i)^(?:https?://(?:data\.europa\.eu|eur-lex\.europa\.eu|publications\.europa\.eu/resource)/)?eli/"
    parts = F.filter(F.split(F.lower(F.regexp_replace(raw, start, "")), "/"), lambda s: s != "")
    rest = F.array_join(F.slice(parts, 4, F.greatest(F.size(parts), F.lit(1))), "/")
    rest = F.regexp_replace(rest, f"(?:(?:^|/)(?:{'|'.join((*ELI_TAILS, *languages))}))+$", "")
    good = (F.size(parts) >= 3) & F.forall(parts, lambda s: s.rlike(r"^[a-z0-9_\-]+$"))
    path = F.concat_ws("/", F.slice(parts, 1, 3), F.nullif(rest, F.lit("")))
    return F.when(~raw.rlike(start), F.lit(None).cast("string")).when(good, F.concat(F.lit("http://data.europa.eu/eli/"), path)).otherwise("")


def locator(x: Column) -> Column:
    """article, para and sub of a locator such as 5a or 5(1)(a); null if it has another shape."""
    clean, shape = F.translate(F.trim(x), *LOOKALIKES), r"^(\d+[A-Za-z]?)(?:\((\d+)\))?(?:\(([A-Za-z])\))?$"

    def part(k: int) -> Column:
        return F.nullif(F.regexp_extract(clean, shape, k), F.lit(""))

    return F.when(clean.rlike(shape), F.struct(F.lower(part(1)).alias("article"), part(2).alias("para"), F.lower(part(3)).alias("sub")))


def roman(n: Column) -> Column:
    """Roman number of 1 to 99."""
    tens = F.array(*(F.lit(t) for t in ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")))
    ones = F.array(*(F.lit(t) for t in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")))
    return F.when(n.between(1, 99), F.concat(F.get(tens, F.floor(n / 10).cast("int")), F.get(ones, (n % 10).cast("int"))))


def annex(x: Column) -> Column:
    """Roman number of an annex; a bare number is an article, a bare Roman one an annex."""
    clean = F.translate(F.trim(x), *LOOKALIKES)
    named, shape = r"(?iu)^(?:annex|додаток|приложение|anx)[\s_.]*", r"(?i)^([0-9]{1,2}|[IVXLC]+)$"
    bare_number = F.translate(F.regexp_replace(F.trim(x), named, ""), *LOOKALIKES)
    number = F.when(F.trim(x).rlike(named), F.upper(F.regexp_extract(bare_number, shape, 1))).otherwise("")
    bare = F.regexp_extract(clean, "^([IVXLC]+)$", 1)
    return F.coalesce(F.when(number.rlike("^[0-9]+$"), roman(F.nullif(number, F.lit("")).try_cast("int"))), F.nullif(number, F.lit("")), F.nullif(bare, F.lit("")))


def canonical_locator(x: Column) -> Column:
    parts = locator(x)
    shown = F.concat(parts["article"], F.when(parts["para"].isNotNull(), F.concat(F.lit("("), parts["para"], F.lit(")"))).otherwise(""), F.when(parts["sub"].isNotNull(), F.concat(F.lit("("), parts["sub"], F.lit(")"))).otherwise(""))
    return F.coalesce(F.concat(F.lit("Annex "), annex(x)), shown, F.trim(x))


def case_candidates(x: Column) -> Column:
    """Identifiers that a case number may have; null if it is no case number."""
    shape = r"^([CTF])-(\d{1,4})/(\d{2})(?:\s+[A-Z()\s]+)?$"
    forum, number, yy = (F.regexp_extract(F.trim(x), shape, k) for k in (1, 2, 3))
    year = F.concat(F.when(F.nullif(yy, F.lit("")).try_cast("int") >= CENTURY, "19").otherwise("20"), yy)
    kinds = F.coalesce(*(F.when(forum == k, F.array(*(F.lit(c) for c in v))) for k, v in CASE_KINDS.items()))
    padded = F.lpad(number, 4, "0")
    return F.transform(kinds, lambda k: F.concat(F.lit("6"), year, forum, k, padded))


def iso_date(x: Column) -> Column:
    """The date in the first ten characters, or null."""
    return F.try_to_date(F.substring(F.trim(x), 1, 10), "yyyy-MM-dd")


def slash_date(x: Column) -> Column:
    """dd/mm/yyyy as an ISO text, or null."""
    shape = r"^\s*(\d{2})/(\d{2})/(\d{4})\s*$"
    return F.when(x.rlike(shape), F.regexp_replace(x, shape, "$3-$2-$1"))


def bracketed_date(x: Column) -> Column:
    """The date in `:YYYYMMDD:` as an ISO text, or null."""
    d = F.regexp_extract(x, r":(\d{8}):", 1)
    return F.when(d != "", F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))


def application_numbers(x: Column) -> Column:
    """Numbers split on `;`, `,` and white space, without closing plus signs."""
    return F.filter(F.transform(F.split(F.trim(x), r"[;,\s]+"), lambda s: F.regexp_replace(s, r"\++$", "")), lambda s: s != "")


def identifier_kind(x: Column) -> Column:
    t = F.trim(x)
    return F.when(t.rlike("(?i)^ECLI:"), "ecli").when(t.rlike(r"^001-\d+$"), "itemid").when(t.rlike(r"^\d{1,6}/\d{2}$"), "appno")


def age_days(now: Column, then: Column) -> Column:
    """Whole days from `then` to `now`."""
    return F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))) / 86400)


def age(now: Column, then: Column) -> Column:
    """Days from `then` to `now`, to two decimals, halves up."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))
    return F.floor((seconds * 100 + 43_200) / 86_400) / 100


def without_dot(x: Column) -> Column:
    """A metadata value without blanks and dots at its end; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.trim(x), r"\.+$", ""), F.lit(""))


def case_number(x: Column) -> Column:
    """A case number from an address, which may be encoded twice, in small letters and single spaces."""
    once = F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    twice = F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B"))), once)
    return F.regexp_replace(F.lower(F.trim(F.coalesce(twice, F.lit("")))), r"\s+", " ")


def redaction_date(text: Column) -> Column:
    """The date after the words for `redaction of` as an ISO text, or null."""
    shape = r"(?iu)редакція\s+від\s+(\d{2})\.(\d{2})\.(\d{4})"
    return F.when(text.rlike(shape), F.concat_ws("-", *(F.regexp_extract(text, shape, k) for k in (3, 2, 1))))


# Shapes of identifiers that may be sent on.
SHAPES = {"company": r"^\d{8,10}$", "tender": r"^UA-\d{4}-\d{2}-\d{2}-\d{6}-[a-z]$", "generic": r"^[A-Za-z0-9][A-Za-z0-9._/-]{0,63}$"}


def well_formed(x: Column, kind: str) -> Column:
    """Whether an identifier has its kind's shape; null and blanks at the ends don't."""
    return F.coalesce(x.rlike(SHAPES[kind]), F.lit(False))


# Endings of file names.
FILE_ENDINGS = ("pdf", "docx", "doc", "txt", "rtf", "zip", "xml", "html")


def address_fault(x: Column) -> Column:
    """Why a text is no address inside a document: url, path or file; null if it may be one."""
    t = F.trim(F.coalesce(x, F.lit("")))
    low = F.lower(t)
    return (
        F.when(low.contains("://") | low.startswith("file:") | low.startswith("\\\\"), "url")
        .when(t.contains("\\") | t.rlike(r"[A-Za-z]:[/\\]") | t.startswith("/"), "path")
        .when(t.contains("..") | low.rlike(rf"\.(?:{'|'.join(FILE_ENDINGS)})$"), "file")
    )


def flag(x: Column) -> Column:
    """true for `1` and `true`, false for `0` and `false`, else null."""
    return F.when(F.lower(F.trim(x)).isin("1", "true"), True).when(F.lower(F.trim(x)).isin("0", "false"), False)


def file_name(x: Column) -> Column:
    """An id as the name of a file: slashes, backslashes and colons become underscores."""
    return F.translate(F.trim(x), "/\\:", "___")


def document_class(order: Column, ident: Column) -> Column:
    """treaty, procedure or act, by legal order and shape of the id; decision where the id is a court document's."""
    t = F.trim(ident)
    procedure = t.rlike(r"^(?:12016E/PRO/03|1\d{4}E|32012Q|02012Q|32024Y|32024D2490)") | t.rlike(r"(?i)^(?:https?://[^/]+/(?:resource/)?)?eli/proc_rules/")
    return F.when((order == "INTL") | F.lower(t).startswith("treaty:"), "treaty").when((order == "EU") & procedure, "procedure").when(t.rlike(r"(?i)^(?:ecli:|6\d{4}[a-z]{2}\d|001-\d+)"), "decision").otherwise("act")


def citation(*parts: Column) -> Column:
    """The parts that aren't blank, joined by commas."""
    return F.concat_ws(", ", *(F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts))
