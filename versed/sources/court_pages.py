"""Pages of a court register as rows: lists of cases, cards of cases and lists of documents, read from landed pages by columns.

A page that isn't of its kind gives a row with status unexpected_page; null and empty pages do too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versed.functions import ids
from versed.functions.text import squeeze
from versed.operators import resolve

# fixed values: headings of a card by column, the text that stands for a missing value, marks of the pages
CARD = {
    "lodged_on": "Date of lodging of the application initiating proceedings",
    "referred_from": "Source of the question referred for a preliminary ruling",
    "subject_matter": "Subject matter",
    "procedure": "Procedure and result",
    "language_of_case": "Language(s) of the case",
    "parties": "Name of the parties",
    "formation": "Formation of the Court",
    "judge_rapporteur": "Judge-Rapporteur",
    "advocate_general": "Advocate General",
    "hearing_on": "Date of the hearing",
    "opinion_on": "Date of the Opinion",
    "delivered_on": "Date of delivery",
    "official_journal": "Publication in the Official Journal",
}
NOT_AVAILABLE = "Information not available"
CASES_FOUND, DOCUMENTS_FOUND, CASE_STATUS = r"Search result:\s*(\d+)\s*case\(s\)", r"(\d+)\s*document\(s\)", r"\[Case (in progress|closed)\]"
TITLE, ROW, ECLI, HINT = "details_decision_title", "table_document_ligne", "outputEcli", "tooltip"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def _unescaped(x: Column) -> Column:
    for name, char in ENTITIES.items():
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def _plain(x: Column) -> Column:
    return squeeze(_unescaped(F.regexp_replace(x, "<[^>]*>", " ")))


def _all(x: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def _number(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(_plain(x), pattern, 1), F.lit("")).cast("int")


def _hrefs(x: Column) -> Column:
    return F.transform(_all(x, r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), _unescaped)


def _parameter(url: Column, name: str) -> Column:
    return F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)


def case_lists(pages: DataFrame, key: str, html: str, number: str) -> DataFrame:
    """key, status, cases_found, card_id and case_status of lists asked for by the case number in `number`.

    The card is that of the same number, wherever it stands; where no link tells a number, or none was asked, the first.
    Links with other numbers only are number_mismatch, which isn't the same as no case.
    """
    links = F.filter(F.transform(F.filter(_hrefs(F.col("h")), lambda u: u.contains("fiche.jsf")), lambda u: F.struct(_parameter(u, "id").alias("id"), ids.case_number(_parameter(u, "num")).alias("num"))), lambda s: s["id"] != "")
    rows = pages.select(key, F.coalesce(html, F.lit("")).alias("h"), ids.case_number(F.coalesce(number, F.lit(""))).alias("w")).withColumn("links", links)
    rows = rows.withColumns({"cases_found": _number(F.col("h"), CASES_FOUND), "told": F.filter("links", lambda s: s["num"] != ""), "untold": F.filter("links", lambda s: s["num"] == "")})
    first = lambda c: F.get(c, 0)["id"]
    same = first(F.filter("told", lambda s: s["num"] == F.col("w")))
    card = F.when(F.size("told") == 0, first(F.col("untold"))).when(F.col("w") == "", first(F.col("told"))).otherwise(same)
    status = F.when(F.col("cases_found").isNull(), "unexpected_page").when(card.isNotNull(), "ok").when(F.size("told") > 0, "number_mismatch").otherwise("no_case")
    said = F.nullif(F.replace(F.regexp_extract(_plain(F.col("h")), CASE_STATUS, 1), F.lit(" "), F.lit("_")), F.lit(""))
    good = F.col("cases_found").isNotNull()
    return rows.select(key, status.alias("status"), "cases_found", F.when(good, card).alias("card_id"), F.when(good, said).alias("case_status"))


def case_cards(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, status, case_name and the fields of CARD; of equal headings the first counts, a value that isn't available is null."""
    body = F.coalesce(html, F.lit(""))
    title = F.regexp_extract(body, rf"""(?is)<div\b[^>]*class\s*=\s*["'][^"']*{TITLE}[^>]*>(.*?)</div>""", 0)
    name = F.get(F.filter(F.transform(F.split(title, "<[^>]*>|\n"), lambda x: squeeze(_unescaped(x))), lambda x: x != ""), 0)
    field = r"(?is)<h3\b[^>]*>(.*?)</h3>(.*?)(?=<h[23]\b|\z)"
    rows = pages.select(key, (title != "").alias("good"), name.alias("case_name"), F.transform(_all(body, field, 1), _plain).alias("labels"), _all(body, field, 2).alias("bodies"))

    def values(label: str) -> Column:
        at = F.array_position("labels", label).cast("int")
        found = F.when(at > 0, F.get("bodies", at - 1))
        items = F.when(found.rlike(r"(?i)<li\b"), _all(found, r"(?is)<li\b[^>]*>(.*?)(?:</li>|(?=<li\b)|\z)")).otherwise(F.split(found, r"(?i)</(?:p|div|span|table)>"))
        return F.filter(F.transform(items, _plain), lambda x: (x != "") & (x != NOT_AVAILABLE))

    rows = rows.select(key, "good", "case_name", *(values(label).alias(c) for c, label in CARD.items()))
    one = lambda c: F.get(c, 0)
    court, state = resolve.court_and_state(one(F.col("referred_from")))
    none = F.array().cast("array<string>")
    out = {c: ids.slash_date(one(F.col(c))) if c.endswith("_on") else one(F.col(c)) for c in CARD if c != "referred_from"}
    out |= {"subject_matter": F.coalesce(resolve.with_parents(F.col("subject_matter")), none), "language_of_case": F.coalesce("language_of_case", none), "procedure": F.nullif(F.array_join("procedure", "; "), F.lit(""))}
    return rows.select(key, F.when(F.col("good"), "ok").otherwise("unexpected_page").alias("status"), "case_name", court.alias("referring_court"), state.alias("referring_state"), *(x.alias(c) for c, x in out.items()))


def case_documents(pages: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """key, status, declared, complete and documents (day, title, ecli, links by kind) in order of day and title.

    complete: as many documents were read as the page declares. Links lose their session; of each kind the first counts;
    relative ones are joined to `base`, a folder's address.
    """
    body = F.coalesce(html, F.lit(""))
    host = "/".join(base.split("/")[:3])

    def full(u: Column) -> Column:
        return F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), u).when(u.startswith("/"), F.concat(F.lit(host), u)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(u, r"^(\./)+", "")))

    def document(row: Column) -> Column:
        cells = _all(row, r"(?is)<td\b[^>]*>(.*?)</td>")
        hints = F.regexp_replace(row, rf"""(?is)<div\b[^>]*class\s*=\s*["'][^"']*{HINT}.*?</div>""", "")
        links = F.filter(F.transform(_hrefs(hints), lambda u: F.struct(resolve.link_kind(full(u)).alias("kind"), resolve.without_session(full(u)).alias("url"))), lambda s: s["kind"].isNotNull())
        kinds = F.array_distinct(F.transform(links, lambda s: s["kind"]))
        first = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.get(F.filter(links, lambda s: s["kind"] == k), 0)["url"])))
        return F.struct(
            F.size(cells).alias("n"), ids.slash_date(_plain(F.get(cells, 2))).cast("string").alias("day"), squeeze(_unescaped(F.regexp_extract(F.get(cells, 1), "^[^<]*", 0))).alias("title"),
            F.nullif(_plain(F.regexp_extract(F.get(cells, 1), rf"(?is)<span\b[^>]*{ECLI}[^>]*>(.*?)</span>", 1)), F.lit("")).alias("ecli"), first.alias("links"),
        )

    found = F.filter(F.transform(_all(body, rf"""(?is)<tr\b[^>]*class\s*=\s*["'][^"']*{ROW}[^>]*>(.*?)</tr>"""), document), lambda d: d["n"] >= 3)
    order = F.array_sort(F.transform(F.col("found"), lambda d, i: F.struct(F.coalesce(d["day"], F.lit("")).alias("a"), d["title"].alias("b"), i.alias("c"))))
    rows = pages.select(key, _number(body, DOCUMENTS_FOUND).alias("declared"), found.alias("found"))
    documents = F.transform(order, lambda o: F.get("found", o["c"]).dropFields("n"))
    good = F.col("declared").isNotNull()
    return rows.select(key, F.when(good, "ok").otherwise("unexpected_page").alias("status"), "declared", (F.col("declared") == F.size("found")).alias("complete"), F.when(good, documents).alias("documents"))
