"""Text functions as column expressions: tokens, stems, density, quote normalisation, headings, verdicts on a text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Search tokens, service words, prefix rule.
INDEX_TOKEN = r"[\p{L}\p{N}]+"
TOKEN = "[A-Za-zА-Яа-яІіЇїЄєҐґ0-9-]+"
STOP_WORDS = (
    "та", "або", "що", "як", "для", "про", "при", "до", "від", "на", "в", "у", "з", "і", "а", "але", "це", "є", "не",
    "ні", "після", "між", "через", "над", "під", "перед", "без", "по", "із", "зі",
)
PREFIX_FROM, TRIM = 5, 3

# Characters that quote normalisation replaces, by rule.
QUOTES = "«»“”„‟″‶"
APOSTROPHES = "‘’‚‛′‵ʼ´`"
DASHES = "‐‑‒–—―−"
SOFT_HYPHEN = "­"
INVISIBLE = "​‌‍﻿"
SPACES = "\u00a0\u202f\u2007\u2009\u2008\u2005\u2002\u2003\u2004\u2006"
QUOTE_RULES = ("whitespace", "quotes", "apostrophes", "dashes", "soft_hyphen", "invisible", "nbsp")
QUOTE_LEAST = 15


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once for a row, however often f uses it; the planner doesn't share work between branches."""
    return F.get(F.transform(F.array(value), f), 0)


def squeeze(text: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """All search tokens of a text, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_tokens(text: Column) -> Column:
    """The searchable tokens of a query: no service words, no bare dashes."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.filter(words(text), lambda w: (F.length(F.replace(w, F.lit("-"), F.lit(""))) > 0) & ~F.array_contains(stop, w))


def index_tokens(text: Column) -> Column:
    """Index tokens: runs of letters and digits of any script, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(INDEX_TOKEN), F.lit(0))


def stem(token: Column) -> Column:
    """What a token is matched by: its first max(5, length - 3) characters, or itself if shorter than 5."""
    n = F.length(token)
    return F.when(n >= PREFIX_FROM, F.substring(token, 1, F.greatest(F.lit(PREFIX_FROM), n - TRIM))).otherwise(token)


def stem_of(token: str) -> tuple[str, bool]:
    """Stem, and whether it matches as a prefix."""
    return (token[: max(PREFIX_FROM, len(token) - TRIM)], True) if len(token) >= PREFIX_FROM else (token, False)


def hits(of_words: Column, token: str) -> Column:
    """How many of the words the token reaches."""
    start, prefix = stem_of(token)
    return F.size(F.filter(of_words, lambda w: w.startswith(start) if prefix else w == start))


#: White space of any kind, as the inside of a character class.
BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: The same white space and all but it, each with a range in front that decides on most characters at once.
SPACE, VISIBLE = rf"[\x00-\x20\x7f-\x{{10FFFF}}&&[{BLANK}]]", f"[!-~[^{BLANK}]]"


def n_space_words(text: Column) -> Column:
    """Words between white space, 1 at least."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(f"{VISIBLE}+")))


def token_count(low: Column, token: str) -> Column:
    """How many search tokens of a lower-cased text the token reaches, counted in the text: where its stem begins one (and, if it doesn't match as a prefix, ends it)."""
    start, prefix = stem_of(token)
    inside = TOKEN[:-1]
    return F.regexp_count(low, F.lit(rf"\Q{start}\E(?<!{inside}\Q{start}\E)" + ("" if prefix else f"(?!{inside})")))  # the stem first: it fails fast


def may_hit(low: Column, tokens: list[str]) -> Column:
    """Whether a lower-cased text has every token's stem anywhere: a cheap test before any count."""
    return reduce(lambda a, b: a & b, (low.contains(stem_of(t)[0]) for t in tokens))


def density(text: Column, tokens: list[str]) -> Column:
    """Hits per 1000 words, summed over the tokens; 0 unless every token hits."""
    def scored(found: Column, size: Column) -> Column:
        return sum((F.get(found, k) * F.lit(1000.0) / size for k in range(len(tokens))), F.lit(0.0))

    low = F.lower(text)
    counted = F.array(*(token_count(low, t) for t in tokens))
    return F.when(may_hit(low, tokens), let(counted, lambda c: F.when(F.array_min(c) > 0, let(n_space_words(text), lambda n: scored(c, n))).otherwise(0.0))).otherwise(0.0)


def normal_quote(text: Column, rules: tuple[str, ...] = QUOTE_RULES) -> Column:
    """A text as quotes are compared: the given rules applied."""
    if "soft_hyphen" in rules:
        text = F.translate(text, SOFT_HYPHEN, "")
    if "invisible" in rules:
        text = F.translate(text, INVISIBLE, "")
    for rule, chars, to in (("quotes", QUOTES, '"'), ("apostrophes", APOSTROPHES, "'"), ("dashes", DASHES, "-"), ("nbsp", SPACES, " ")):
        if rule in rules:
            text = F.translate(text, chars, to * len(chars))
    if "whitespace" in rules:
        text = F.trim(F.regexp_replace(text, r"[\x00-\x20\x7f\x85\u1680\u200a\u2028\u2029\u205f\u3000]+", " "))
    return text


def article_reference(query: Column) -> Column:
    """The number after an article word, dashes made hyphens; empty if there is none."""
    return F.translate(F.regexp_extract(F.lower(query), r"(?:ст\.?\s*|стаття\s+)(\d+(?:[-–]\d+)?)", 1), "–", "-")


def heading(body: Column, number: Column) -> Column:
    """Label and name of a unit: the first line that is more than a header's scraps, 300 characters at most."""
    label = F.when(number.startswith("frag-"), F.concat(F.lit("Фрагмент "), number)).otherwise(F.concat(F.lit("Стаття "), number))
    lines = F.transform(F.split(body, r"\R"), strip)
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(?:[Сс]таття|\d+|[-–.)]+)$"))
    names = F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^[Сс]таття\s+\d+(?:\s*[-–]\s*\d+)?\s*[.)]?\s*", ""))), lambda x: x != "")
    name = F.get(names, 0)
    return F.when(name.isNull(), label).otherwise(F.substring(F.concat(label, F.lit(". "), name), 1, 300))


def page(text: Column, number: int, size: int) -> Column:
    """The n-th page of a text, from 1; a page has 1 to 80,000 characters."""
    size = max(1, min(size, 80_000))
    return F.substring(text, (max(1, number) - 1) * size + 1, size)


# Markers of pages that stand in for a document, by kind and in order of precedence.
ANTIBOT = (
    "запроваджено інтерактивний елемент захисту", "введіть суму цифр", "інтерактивний елемент захисту системи",
    "підтвердьте, що ви не робот", "перевірка безпеки", "checking your browser", "just a moment",
    "enable javascript and cookies to continue", "please verify you are a human", "unusual traffic from your computer",
    "captcha", "cf-browser-verification", "recaptcha",
)
ACCESS_DENIED = ("доступ заборонено", "необхідна авторизація", "403 forbidden", "access denied", "subscription required", "please log in to continue")
ERRORS = (
    "сторінку не знайдено", "сторінка не знайдена", "документ не знайдено", "запитуваний документ відсутній", "404 not found",
    "500 internal server error", "503 service unavailable", "service temporarily unavailable", "an error has occurred", "the requested url was not found",
)
CONTENTS = ("перелік документів", "table of contents", "document index", "результати пошуку:")
PROSE, SHORT = 200, 500


def any_of(text: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | text.contains(m)
    return found


def stub_kind(text: Column, shortest: int | None = SHORT, extra: tuple[str, ...] = ()) -> Column:
    """Why a text is no document: its kind, or `none`."""
    def by_shape(body: Column, low: Column, lines: Column) -> Column:
        full = F.size(F.filter(lines, lambda x: x != ""))
        prose = F.exists(lines, lambda x: F.length(x) > PROSE)
        listed = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(?:\d{1,3}[.)]|[-—•*])\s+\S")))
        kind = F.when(~prose & (any_of(low, CONTENTS) | ((full >= 8) & (listed >= 8) & (listed / F.greatest(F.lit(1), full) >= 0.7))), "table_of_contents")
        return (kind if shortest is None else kind.when(F.length(body) < shortest, "too_short")).otherwise("none")

    def by_marker(body: Column, low: Column) -> Column:
        kind = F.when(body == "", "empty")
        if extra:
            kind = kind.when(any_of(low, tuple(m.lower() for m in extra)), "antibot_challenge")
        kind = kind.when(any_of(low, ANTIBOT), "antibot_challenge").when(any_of(low, ACCESS_DENIED), "access_denied").when(any_of(low, ERRORS), "error_page")
        return kind.otherwise(let(F.transform(F.split(body, r"\R"), strip), lambda lines: by_shape(body, low, lines)))

    return let(strip(F.coalesce(text, F.lit(""))), lambda body: let(F.lower(body), lambda low: by_marker(body, low)))


# Words that make a requisite line a bylaw's.
BYLAW_WORDS = ("постанова", "наказ", "указ", "розпорядження", "рішення", "лист", "інструкція", "положення", "порядок", "декрет", "угода", "конвенція")


def kind_of_words(words_: Column, bylaw: tuple[str, ...] = BYLAW_WORDS) -> Column:
    low = F.lower(words_)
    return (
        F.when(low.contains("конституція"), "constitution").when(low.contains("кодекс"), "code").when(low.contains("закон"), "law")
        .when(any_of(low, bylaw), "bylaw")
    )


# What makes a heading in capitals a bylaw's; the shapes of a requisite line and of a bylaw's id; the start of a text that is read.
HEADING_BYLAW = ("кабінет міністрів", "міністерство", "постанова", "наказ", "указ", "розпорядження", "рішення", "положення")
REQUISITE = r"(?m)^[^\n]{0,200};\s*([^\n;]{2,120}?)\s+від\s+\d{2}\.\d{2}\.\d{4}"
BYLAW_ID = r"(?i)-\d{4}-(?:п|р)$|^z\d+"
HEAD = 4000


def first_kind(texts: Column, bylaw: tuple[str, ...]) -> Column:
    """The kind that the first of the texts to name one names."""
    return F.get(F.filter(F.transform(texts, lambda x: kind_of_words(x, bylaw)), lambda k: k.isNotNull()), 0)


def document_kind(text: Column, doc_id: Column, type_code: Column | None = None) -> Column:
    """Kind of a document: by type code, else a requisite line, else its id, else its first heading in capitals that names a kind."""
    start = F.substring(text, 1, HEAD)
    heads = F.filter(F.transform(F.split(start, r"\R"), squeeze), lambda x: F.length(x).between(4, 90) & (F.upper(x) == x))
    by_code = F.lit(None).cast("string")
    if type_code is not None:
        code = F.trim(type_code.cast("string"))
        by_code = F.when(code == "216", "constitution").when(code == "1", "law").when(code == "21", "code").when(code != "", "bylaw")
    return F.coalesce(
        by_code, first_kind(F.regexp_extract_all(start, F.lit(REQUISITE), F.lit(1)), BYLAW_WORDS), F.when(F.trim(doc_id).rlike(BYLAW_ID), "bylaw"),
        first_kind(heads, HEADING_BYLAW), F.lit("unknown"),
    )


def sanitised(text: Column, markers: tuple[str, ...]) -> Column:
    """A description without its lines that hold an instruction marker, and a last line that says so."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~any_of(F.lower(x), markers))
    return F.when(F.size(kept) == F.size(lines), text).otherwise(F.concat(F.array_join(kept, "\n"), F.lit("\n[removed: "), (F.size(lines) - F.size(kept)).cast("string"), F.lit("]")))


# Starts of lines that are no title.
BOILERPLATE = ("стан:", "ідентифікатор:", "текст документа", "друкувати", "допомога", "шрифт", "[ image ]", "документ", "сторінка")


def real_title(text: Column) -> Column:
    """The document's own title: its first line that is neither boilerplate nor a requisite and has 5 to 500 characters.

    The print form's date is cut off, and a title that ends in dots is made whole by a later line with the same start.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), squeeze), lambda x: x != "")
    plain = F.transform(lines, lambda x: F.regexp_replace(x, r"^(.+?)\s*\|\s*від\s+\d{2}\.\d{2}\.\d{4}.*$", "$1"))
    skipped = lambda x: x.rlike("(?iu)^(?:" + "|".join(b.replace("[", r"\[").replace("]", r"\]") for b in BOILERPLATE) + ")")
    good = F.filter(plain, lambda x: ~skipped(x) & ~x.rlike(REQUISITE) & F.length(x).between(5, 500))
    title = F.coalesce(F.get(good, 0), F.lit(""))
    start = F.substring(F.regexp_replace(title, r"[.…\s]+$", ""), 1, 24)
    whole = F.get(F.filter(lines, lambda x: (F.length(x) > F.length(title)) & x.startswith(start) & (F.length(x) <= 500) & ~x.rlike(r"\|\s*від\s")), 0)
    return F.when(title.rlike(r"(?:\.\.\.|…)$") & (F.length(start) >= 12), F.coalesce(whole, title)).otherwise(title)


def excerpt(text: Column, tokens: list[str], size: int = 14) -> Column:
    """`size` words of a text around the first that a token reaches, with ` … ` where it was cut; the beginning if none does."""
    other = f"[^{BLANK}{TOKEN[1:-2]}]"
    reached = "|".join(rf"\Q{start}\E" + ("" if prefix else f"{other}*+(?!{VISIBLE})") for start, prefix in map(stem_of, tokens))

    def shown(ws: Column, first: Column) -> Column:
        begin = F.greatest(F.lit(0), F.least(first - size // 2, F.size(ws) - size))
        body = F.array_join(F.slice(ws, begin + 1, size), " ")
        return F.concat(F.when(begin > 0, " … ").otherwise(""), body, F.when(begin + size < F.size(ws), " … ").otherwise(""))

    def around(first: Column) -> Column:  # no more words are split off than decide on the excerpt: the last one stands for the rest
        return let(F.filter(F.split(text, f"{SPACE}+", first + size + 3), lambda w: w != ""), lambda ws: shown(ws, first))

    def first_reached(low: Column) -> Column:
        return let(F.split(low, f"(?:^|{SPACE}){other}*+(?:{reached})", 2), lambda ps: F.when(F.size(ps) > 1, F.regexp_count(F.get(ps, 0), F.lit(f"{VISIBLE}+"))).otherwise(0))

    first = let(F.lower(text), lambda low: F.when(any_of(low, tuple(stem_of(t)[0] for t in tokens)), first_reached(low)).otherwise(0))
    return let(first, around)


def query_status(query: Column) -> Column:
    """`unusable_query` if a query has no searchable word, which is no empty result; else `ok`."""
    return F.when(F.size(query_tokens(F.coalesce(query, F.lit("")))) == 0, "unusable_query").otherwise("ok")


# Kinds of opinions after which a judgment's own text has ended.
OPINIONS = ("CONCURRING", "DISSENTING", "SEPARATE", "PARTLY", "JOINT")


def own_lines(lines: Column) -> Column:
    """The lines of a judgment before the first heading, all in capitals, of an opinion."""
    ends = F.filter(F.transform(lines, lambda x, i: F.when((strip(x) == F.upper(strip(x))) & x.contains("OPINION") & any_of(x, OPINIONS), i)), lambda i: i.isNotNull())
    return F.slice(lines, 1, F.coalesce(F.get(ends, 0), F.size(lines)))
