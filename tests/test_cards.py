"""Cards, compositions, second identifiers, citation data and registers on small tables."""

from pyspark.sql import functions as F

from versed.operators import cards


def _day(c):
    return F.col(c).cast("date")


def test_consolidations(spark):
    acts = spark.createDataFrame([("32016R0679",), ("32016R0679",), ("62016CJ0001",), (None,)], "act string")
    links = spark.createDataFrame([
        ("32016R0679", "02016R0679-20160504"), ("32016R0679", "02016R0679-20160504"), ("32016R0679", "02018R0001-20160504"), ("32016R0679", "02016R0679-20169999"),
        ("32016R0679", "02016R0679"), ("62016CJ0001", "02016CJ0001-20160504"), ("32016R0679", None), (None, "02016R0679-20160504")], "act string, dated string")
    assert [tuple(map(str, r)) for r in cards.consolidations(acts, links, "act", "dated").select("act", "dated", "day").collect()] == [("32016R0679", "02016R0679-20160504", "2016-05-04")]
    assert cards.consolidations(acts.limit(0), links, "act", "dated").count() == 0


def test_act_cards(spark):
    texts = spark.createDataFrame([("a", "a1", "2001-01-01"), ("a", "a2", "2002-01-01"), ("a", "a2x", "2002-01-01"), ("a", "a3", "2030-01-01"), ("b", "b1", "2030-01-01")], "act string, dated string, day string").withColumn("day", _day("day"))
    acts = spark.createDataFrame([
        ("a", False, "2010", "2001-06-01"), ("a", False, "2010", None), ("a", True, None, "1999-01-01"), ("b", None, None, None), ("c", False, "2010", "2001-06-01")],
        "act string, in_force boolean, ended string, as_of string").withColumn("as_of", _day("as_of"))
    rows = cards.act_cards(acts, texts, "act", "dated", F.lit("2026-01-01").cast("date")).collect()
    got = {(r["act"], r["as_of"] and str(r["as_of"])): (r["latest_id"], r["historical"], r["ended"], r["revision_status"], r["revision_id"], r["valid_to"] and str(r["valid_to"])) for r in rows}
    assert len(rows) == 5 and got == {
        ("a", "2001-06-01"): ("a2x", True, "2010", "ok", "a1", "2001-12-31"), ("a", None): ("a2x", True, "2010", None, None, None), ("a", "1999-01-01"): ("a2x", False, None, "revision_unknown", None, None),
        ("b", None): (None, False, None, None, None, None), ("c", "2001-06-01"): (None, False, None, "not_found", None, None),
    }


def test_compositions_and_identifiers(spark):
    links = spark.createDataFrame([("t", "b"), ("t", "a"), ("t", "b"), ("t", None), ("u", None)], "dated string, part string")
    assert [(r["dated"], r["parts"]) for r in cards.composition(links, "dated", "part").collect()] == [("t", ["a", "b"])]
    works = spark.createDataFrame([("1", "E1"), ("1", None), ("2", " "), ("2", None), (None, "E9")], "id string, ecli string")
    asked = spark.createDataFrame([("1",), ("2",), ("3",), (None,)], "id string")
    assert {(r["id"], r["ecli"], r["status"]) for r in cards.second_identifier(asked, works, "id", "ecli").collect()} == {("1", "E1", "ok"), ("2", None, "none"), ("3", None, "not_found"), (None, None, "not_found")}


def test_citation_data_and_scope(spark):
    rows = spark.createDataFrame([("Court", "2001-11-21T00:00:00", "nested", "forum"), (" ", None, "", "forum"), (None, "2001", None, None)], "court string, day string, part string, name string")
    values = {"court": F.col("court"), "judgment_date": F.col("day"), "consolidation_id": F.when(F.col("court") == "Court", " ")}
    kind = F.when(F.col("part").isNotNull(), "international_forum")
    got = rows.select(cards.citation_data(values, {"consolidation_id": F.col("part")}).alias("m"), cards.binding_scope(kind, F.col("name")).alias("b")).collect()
    assert [r["m"] for r in got] == [{"consolidation_id": "nested", "court": "Court", "judgment_date": "2001-11-21"}, {}, {"judgment_date": "2001"}]
    assert got[0]["b"]["scope"] == cards.BINDING_SCOPE and "forum" in got[0]["b"]["notice"] and got[2]["b"] is None


def test_registers(spark):
    table = spark.createDataFrame([("UA", "y"), ("UA", "x"), ("EU", "z")], "legal_order string, adapter string")
    asked = spark.createDataFrame([(1, " ua"), (2, ""), (3, None), (4, "FR"), (5, "QQ")], "request int, legal_order string")
    got = {r["request"]: (r["status"], r["adapters"], r["total"]) for r in cards.registers(asked, table, ["UA", "EU", "FR"]).collect()}
    assert got == {1: ("ok", ["x", "y"], 2), 2: ("ok", ["x", "y", "z"], 3), 3: ("ok", ["x", "y", "z"], 3), 4: ("ok", [], 0), 5: ("unknown_legal_order", [], 0)}


def test_across(spark, tmp_path):
    docs = spark.createDataFrame([(1, "law of law"), (2, "law"), (3, None), (4, "nothing")], "id int, text string")
    asked = spark.createDataFrame([("a", "law"), ("b", "laws nothing")], "q string, words string")
    for _ in range(2):  # builds the index, then reads it
        got = cards.across(docs, "id", f"{tmp_path}/index", asked, "q", "words", 5, body="text").collect()
        assert sorted(map(tuple, got)) == [("a", 1, 2), ("a", 2, 1)]
