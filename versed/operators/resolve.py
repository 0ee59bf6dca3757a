"""From what a user wrote to a document: ids, aliases, titles, and cascades over several stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versed.functions import text as T
from versed.operators.records import containment, pick

# Shape of an official id, the title that stands in for one, law words before a title.
OFFICIAL = r"(?iu)^[a-zа-яіїєґ]*\d+[a-zа-яіїєґ]*\d*[-_/]\d+(?:[-_](?:[а-яіїєґ]{1,3}|[ivxlcdm]{1,6}))?$"
STAND_IN = "zakon rada document"
#: What a beginning of a query may stand for, besides itself.
PREFIXES = {"зу ": ("закон ", "закон україни "), "закон україни ": ("закон ", ""), "закон ": ("",)}


def is_official(x: Column) -> Column:
    t = F.trim(x)
    return F.coalesce(t.rlike(OFFICIAL) & ~t.rlike(r"(?U)\s"), F.lit(False))


def official_from_url(url: Column) -> Column:
    """The id in a document's address, or null."""
    part = F.regexp_extract(F.trim(url), r"(?i)^https?://(?:[^/?#]*\.)?zakon\.rada\.gov\.ua/(?:laws/show|go)/([^/?#]+)", 1)
    return F.nullif(F.coalesce(F.try_url_decode(part), part), F.lit(""))


def is_placeholder(title: Column, ident: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("")))
    return (t == "") | F.lower(t).startswith(STAND_IN) | F.coalesce(t == F.trim(ident), F.lit(False))


def normal_title(x: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[«»\"'`,.;:()]+", " ")
    low = F.regexp_replace(low, r"^\s*закон(?:\s+україни)?\s+", " ")
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def title_score(wanted: Column, title: Column) -> Column:
    """3 for equal titles, 2 if the title holds what is wanted, 1 the other way round, else null."""
    w, t = normal_title(wanted), normal_title(title)
    return F.when((w == "") | (t == ""), None).when(w == t, 3).when(t.contains(w), 2).when(w.contains(t), 1)


def best_title(rows: DataFrame, request: str, wanted: str, title: str, seq: str) -> DataFrame:
    """Of each request's rows the first with the best title score; none if no title matches."""
    scored = rows.withColumn("title_score", title_score(F.col(wanted), F.col(title))).where("title_score is not null")
    return pick(scored, [request], F.desc("title_score"), F.col(seq))


def variants(low: Column) -> Column:
    """A query and what it may stand for, in a fixed order: its usual beginning replaced by each of the others."""
    out = F.array(low)
    for start, others in PREFIXES.items():
        rest = F.substring(low, F.lit(len(start) + 1), F.length(low))
        out = F.when(low.startswith(start), F.concat(out, F.array(*(F.concat(F.lit(o), rest) for o in others)))).otherwise(out)
    return F.array_distinct(F.filter(out, lambda x: F.trim(x) != ""))


def plain_name(name: Column) -> Column:
    """A name as it is compared: lower-cased, without number signs, white space squeezed."""
    return T.squeeze(F.replace(F.lower(name), F.lit("№"), F.lit("")))


def by_alias(queries: DataFrame, q: str, aliases: DataFrame) -> DataFrame:
    """q, law_id and matched_by: an id, else an exact alias, else an alias that contains the query or lies in it.

    aliases has alias and law_id. Case, number signs and runs of white space make no difference. The variants of a query are tried in order; of equals the alias that comes
    first by name wins.
    """
    asked = queries.select(F.col(q), plain_name(F.col(q)).alias("__low")).where("__low <> ''").distinct()
    aliases = aliases.select("law_id", plain_name(F.col("alias")).alias("alias"))
    tried = asked.select(q, F.posexplode(variants(F.col("__low"))).alias("variant", "text"))
    ids = asked.join(aliases.select("law_id").distinct(), F.col("__low") == F.trim(F.replace(F.lower("law_id"), F.lit("№"), F.lit("")))).select(q, "law_id", F.lit(0).alias("stage"), F.lit(0).alias("variant"), F.lit("").alias("alias"))
    exact = tried.join(aliases, tried["text"] == aliases["alias"]).select(q, "law_id", F.lit(1).alias("stage"), "variant", "alias")
    near = containment(tried, "text", aliases, "alias").select(q, "law_id", F.lit(2).alias("stage"), "variant", "alias")
    found = pick(ids.union(exact).union(near), [q], F.col("stage"), F.col("variant"), F.col("alias"), F.col("law_id"))
    return found.select(q, "law_id", F.element_at(F.array(F.lit("id"), F.lit("alias"), F.lit("containment")), F.col("stage") + 1).alias("matched_by"))


def cascade(stages: list[DataFrame], request: str, *order: Column) -> DataFrame:
    """The candidates of the first stage that has any for a request, its best by `order`; stages share their columns."""
    rows = reduce(DataFrame.unionByName, (s.withColumn("stage", F.lit(k)) for k, s in enumerate(stages)))
    return pick(rows, [request], F.col("stage"), *order)


def with_parents(items: Column) -> Column:
    """Headings, with `- child` items joined to the last heading before them; headings without children stay."""
    def step(s: Column, x: Column) -> Column:
        child = x.startswith("-")
        name = F.trim(F.regexp_replace(x, "^-+", ""))
        full = F.when(s["parent"] == "", name).otherwise(F.concat(s["parent"], F.lit(" - "), name))
        kept = F.when(~s["used"], F.array_append(s["out"], s["parent"])).otherwise(s["out"])
        return F.struct(
            F.when(child, F.array_append(s["out"], full)).otherwise(kept).alias("out"), F.when(child, s["parent"]).otherwise(x).alias("parent"), child.alias("used"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("parent"), F.lit(True).alias("used"))
    return F.aggregate(items, start, step, lambda s: F.when(s["used"], s["out"]).otherwise(F.array_append(s["out"], s["parent"])))


def court_and_state(x: Column) -> tuple[Column, Column]:
    """The parts before and after the last ` - `; no state without one."""
    has = x.contains(" - ")
    state = F.substring_index(x, " - ", -1)
    return F.when(has, F.substring(x, F.lit(1), F.length(x) - F.length(state) - 3)).otherwise(x), F.when(has, state)


def without_session(url: Column) -> Column:
    clean = F.regexp_replace(url, r";jsessionid=[^?#]*", "")
    return F.regexp_replace(F.regexp_replace(clean, r"([?&])cid=\d+&", "$1"), r"[?&]cid=\d+$", "")


def link_kind(href: Column) -> Column:
    return F.when(href.contains("document.jsf"), "html_url").when(href.contains("showPdf.jsf"), "pdf_url").when(href.contains("eur-lex.europa.eu"), "eurlex_url").when(href.startswith("http"), "external_url")


def icj_parts(x: Column) -> Column:
    """case_no, day, kind, n1, n2 and language of a document id; null for another shape."""
    shape = r"^(\d{1,5})-(\d{8})-([A-Z]{2,5})-(\d{2})-(\d{2})-(EN|FR|BI)$"
    part = lambda k: F.regexp_extract(x, shape, k)
    kinds = {"JUD": "judgment", "ORD": "order", "ORA": "oral_proceedings_verbatim", "AVIS": "advisory_opinion", "COM": "press_communique"}
    label = F.coalesce(*(F.when(part(3) == k, v) for k, v in kinds.items()), F.lower(part(3)))
    return F.when(x.rlike(shape), F.struct(part(1).alias("case_no"), F.try_to_date(part(2), "yyyyMMdd").alias("day"), label.alias("kind"), part(4).alias("n1"), part(5).alias("n2"), F.lower(part(6)).alias("language")))


def allowed_url(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether an address is https on a listed host; literal addresses and local names never are."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#:@]+)(?::\d+)?(?:[/?#]|$)", 1))
    local = host.rlike(r"^[0-9.]+$|^\[|(?:^localhost|\.local|\.internal)$")
    return F.coalesce(host.isin(*hosts) & ~local, F.lit(False))
