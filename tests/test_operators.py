"""Operators against literal frames."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from versed.functions import ids
from versed.operators import corpus, coverage, evidence, graph, records, search, temporal
from versed.sources import documents
from versed.streaming import windows


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_budget_keeps_the_first_and_stops_at_the_first_violation(spark):
    d = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 5), ("b", 1, 20), ("b", 2, 3)], "p string, o int, n int")
    assert rows(corpus.within_budget(d, "p", "o", F.col("n"), 11), "p", "o") == [("a", 1), ("a", 2), ("b", 1)]


def test_fusion_order(spark):
    fts = spark.createDataFrame([(625, 2.0), (549, 1.0)], "k long, score double")
    vec = spark.createDataFrame([(549, 0.5)], "k long, score double")
    out = search.fused([search.ranked(fts, "k", "fts", 10), search.ranked(vec, "k", "vector", 10)], "k", 5).collect()
    assert [(r["k"], r["matched_by"]) for r in out] == [(549, "fts,vector"), (625, "fts")]
    assert out[0]["rrf_score"] == round(1 / 62 + 1 / 61, 6)


def test_and_or(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "x")], "k long, t string")
    assert rows(search.and_or_search(d, "k", "t", ["alpha", "beta"]), "k") == [(1,)]
    assert rows(search.and_or_search(d, "k", "t", ["alpha", "gamma"]), "k") == [(1,), (2,)]


def test_inverted_index_has_every_language(spark, tmp_path):
    from collections import Counter
    import re

    from versed.plans import catalog

    texts = [(1, "Das Haus, das 12", "de"), (2, "the house the", "en"), (3, "l'été à Paris", "fr"), (4, "años y años", "es"), (5, "no language", None), (6, "", "en"), (7, None, "fr")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((w, k, "body") for k, t, _ in texts for w in re.findall(r"[^\W_]+", (t or "").lower()))
    assert rows(catalog.inverted_index_all(spark, str(tmp_path)), "term", "doc_id", "field", "tf") == sorted((*x, n) for x, n in want.items())


def test_catalogue_scores(spark):
    d = spark.createDataFrame([("254/80", "Закон про мову"), ("1254/80", "Інше"), ("7", "мова і закон")], "i string, t string")
    def score(q):
        return {r["i"]: r["s"] for r in d.select("i", search.catalogue_score(F.col("i"), F.col("t"), q).alias("s")).collect()}

    assert score("254/80") == {"254/80": 10000.0, "1254/80": 5000.0, "7": 0.0}
    assert score("закон про")["254/80"] == 2000.0 + 9 / 14
    assert score("мова закон")["7"] == 2.0


def test_bm25_prefers_more_frequent(spark):
    d = spark.createDataFrame([(1, "cat cat dog"), (2, "cat dog dog bird"), (3, "fish"), (4, "fish"), (5, "fish"), (6, "fish")], "k long, t string")
    out = {r["k"]: r["score"] for r in search.bm25(d, "k", "t", ["cat"]).collect()}
    assert set(out) == {1, 2} and out[1] > out[2]


def test_versions_are_not_revived(spark):
    d = spark.createDataFrame([("a", "h1", 1), ("a", "h2", 2), ("a", "h1", 3)], "k string, h string, at int")
    assert rows(corpus.versions(d, "k", "h", "at"), "h", "status", "effective_to") == [("h1", "superseded", 2), ("h2", "current", None)]


def test_as_of(spark):
    dates = spark.createDataFrame([("a", dt.date(2014, 3, 21)), ("a", dt.date(2016, 3, 13))], "k string, d date")
    asked = spark.createDataFrame([("a", dt.date(2014, 3, 20)), ("a", dt.date(2016, 3, 12)), ("a", dt.date(2016, 3, 13)), ("a", dt.date(2016, 3, 14)), ("b", dt.date(2016, 3, 14))], "k string, as_of date")
    out = {(r["k"], r["as_of"].isoformat()): (r["status"], r["valid_from"], r["valid_to"], r["known_through"]) for r in temporal.as_of(asked, dates, "k", "d").collect()}
    assert out["a", "2014-03-20"][0] == "revision_unknown" and out["a", "2016-03-14"][0] == "revision_unknown" and out["b", "2016-03-14"][0] == "not_found"
    assert out["a", "2016-03-12"] == ("ok", dt.date(2014, 3, 21), dt.date(2016, 3, 12), None)
    assert out["a", "2016-03-13"] == ("ok", dt.date(2016, 3, 13), None, dt.date(2016, 3, 13))


def test_freshness(spark):
    d = spark.createDataFrame([(30, 30, False), (29, 30, True), (5, 0, True), (None, 30, False)], "age int, ttl int, want boolean")
    assert all(r["got"] == r["want"] for r in d.withColumn("got", temporal.fresh(F.col("age"), F.col("ttl"))).collect())


def test_change_state_and_stale(spark):
    d = spark.createDataFrame([("a", 1, "h"), ("a", 2, "h"), ("a", 3, "g")], "k string, o int, h string")
    assert rows(temporal.change_state(d, ["k"], "o", "h"), "o", "state") == [(1, "unknown"), (2, "same"), (3, "changed")]
    s = spark.createDataFrame([("c", False, None), ("c", False, "f"), ("c", True, "f"), (None, False, " ")], "c string, fresh boolean, f string")
    got = [tuple(r["x"]) for r in s.select(temporal.stale_while_error(F.col("c"), F.col("fresh"), F.col("f")).alias("x")).collect()]
    assert got == [("c", "stale_cache", True), ("f", "source", False), ("c", "cache", False), (None, "none", False)]


def test_persistence(spark):
    d = spark.createDataFrame([("t", "bylaw", False, "x", 2), ("t", "bylaw", True, "x", 2), ("t", "law", False, "", 2), ("t", "law", False, "x", 0), (" ", "law", False, "x", 1)], "t string, k string, p boolean, n string, u int")
    got = [r["v"]["reason"] for r in d.select(corpus.persistence(F.col("t"), F.col("k"), F.col("p"), F.col("n"), F.col("u")).alias("v")).collect()]
    assert got == ["bylaw not pinned", "", "no real title", "no units", "empty text"]


def test_merge_keeps_first_and_non_null(spark):
    old = spark.createDataFrame([("a", "2001", "s1", "t1")], "id string, accepted string, source string, title string")
    new = spark.createDataFrame([("a", None, "s2", "t2"), ("b", "2002", "s3", "t3")], "id string, accepted string, source string, title string")
    out = corpus.merge(old, new, ["id"], keep_first=("source",), keep_if_null=("accepted",))
    assert rows(out, "id", "accepted", "source", "title") == [("a", "2001", "s1", "t2"), ("b", "2002", "s3", "t3")]


def test_oversize_and_fuzzy(spark):
    d = spark.createDataFrame([("2", "x" * 12_001), ("3", "y" * 12_000)], "k string, b string")
    assert rows(corpus.split_oversize(d, "k", "b").select("k", F.length("b").alias("n")), "k", "n") == [("2", 3000), ("2#2", 3000), ("2#3", 3000), ("2#4", 3000), ("2#5", 1), ("3", 12_000)]
    u = spark.createDataFrame([("179-1", 1), ("180", 2)], "k string, o int")
    assert corpus.fuzzy_unit(u, "k", "o", "179").first()["k"] == "179-1"


def test_richest_and_completeness(spark):
    d = spark.createDataFrame([("a", 1, "x", None), ("b", 2, "x", None), ("a", 3, "x", "y"), (None, 4, "x", "y")], "k string, seq int, p string, q string")
    assert rows(records.richest(d, ["k"], ["p", "q"], "seq"), "k", "seq", "first_seq") == [("a", 3, 1), ("b", 2, 2)]
    out = graph.first_n(d.where("k is not null"), ["k"], ["p", "q"], "seq", 2, F.col("seq"))
    assert {r["complete"] for r in out.collect()} == {False}


def test_containment_has_no_cross_join(spark):
    q = spark.createDataFrame([("кодекс",), ("ку",), ("зз",)], "q string")
    a = spark.createDataFrame([("цивільний кодекс",), ("к",), ("куп",)], "a string")
    out = records.containment(q, "q", a, "a")
    assert rows(out, "q", "a") == [("кодекс", "к"), ("кодекс", "цивільний кодекс"), ("ку", "к"), ("ку", "куп")]
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()


def test_ladder(spark):
    d = spark.createDataFrame([("u", k, k != 7) for k in range(1, 9)], "u string, t int, bad boolean")
    assert [r["delay_s"] for r in records.ladder(d, "u", ["t"], F.col("bad")).orderBy("t").collect()] == [60, 300, 1800, 7200, 86400, 86400, 60]


def test_coverage_route(spark):
    asked = spark.createDataFrame([(1, "read", "law"), (2, "read", "any"), (3, "find", "law")], "request int, operation string, document_class string")
    caps = spark.createDataFrame([("s1", "read", "law", True, 2, 1), ("s2", "read", "any", True, 3, 1), ("s3", "find", "law", False, 1, 1)], "source_id string, operation string, document_class string, verified boolean, verified_rank int, declared_rank int")
    src = spark.createDataFrame([("s1", True), ("s2", True), ("s3", True)], "source_id string, wired boolean")
    assert rows(coverage.route(asked, caps, src), "request", "reason") == [(1, ""), (2, ""), (3, "not_verified")]


def test_evidence(spark):
    e = spark.createDataFrame([("s", "p", "e1", "d1", ["x"]), ("s", "p", "e2", "d2", ["x"])], "session string, path string, evidence_id string, document string, aliases array<string>")
    a = spark.createDataFrame([("s", "d1", "p"), ("s", "x", "p"), ("s", "q", "p")], "session string, document string, path string")
    assert rows(evidence.find(a, e), "document", "status") == [("d1", "ok"), ("q", "not_found"), ("x", "ambiguous")]


def test_language_choice(spark):
    d = spark.createDataFrame([("a", "FRA"), ("a", "RUS")], "k string, l string")
    assert rows(evidence.language(d, "k", "l", None), "l") == [("FRA",)]
    assert rows(evidence.language(d, "k", "l", "RUS"), "l") == [("RUS",)]
    assert rows(evidence.language(d, "k", "l", "DEU"), "l") == []


@pytest.mark.parametrize(("f", "x", "y"), [
    (ids.eli, "32016R0679", "http://data.europa.eu/eli/reg/2016/679/oj"), (ids.eli, "32016X0001", None), (ids.slash_date, "05/04/2020", "2020-04-05"), (ids.slash_date, "x", None),
    (ids.bracketed_date, "a:20200405:b", "2020-04-05"), (ids.application_numbers, "31253/96;14038/88;37112/97+", ["31253/96", "14038/88", "37112/97"]),
    (ids.subdivision, "Стаття 5(1).", "5(1)"), (ids.document_id, " /A/B/ ", "a/b"), (ids.identifier_kind, "ECLI:EU:C:1", "ecli"),
])
def test_identifiers(spark, f, x, y):
    assert spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first()["y"] == y


def test_cached_documents_and_registry(spark, tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "z1.json").write_text(json.dumps({"title": "T", "text": "body", "articles": {"1": "b"}}))
    (folder / "z2.json").write_text("{not json")
    (folder / "z3.json").write_text(json.dumps({"law_id": "q", "text": "  "}))
    assert rows(documents.cached_documents(spark, str(folder)), "law_id", "title") == [("z1", "T")]
    reg = tmp_path / "laws.json"
    reg.write_text(json.dumps({"aliases": {"КК": "b"}, "laws": {"a": {"title": "Код", "aliases": ["КК"]}, "b": {"title": "Інший"}}}))
    laws, aliases = documents.registry(spark, str(reg))
    assert laws.count() == 2 and ("кк", "b") in rows(aliases, "alias", "law_id") and ("код", "a") in rows(aliases, "alias", "law_id")


def test_catalogue(spark, tmp_path):
    line = "\t".join(["1", "254/96", "Конституція", "", "", "70:19960628:", "", "", "20200101"])
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("doc.txt", (line + "\nкоротко\n").encode("cp1251"))
    (tmp_path / "b.zip").write_bytes(b"no zip")
    out = rows(documents.catalogue(spark, str(tmp_path / "*.zip")), "status", "law_id", "title", "accepted")
    assert [r for r in out if r[0] == "ok"] == [("ok", "254/96", "Конституція", "1996-06-28")] and sum(r[0] == "unusable_archive" for r in out) == 1


def test_versioned_table(spark, tmp_path):
    folder = str(tmp_path / "t")
    for k in (1, 2):
        documents.replace_table(spark.range(k), folder)
    assert documents.read_table(spark, folder).count() == 2


def test_feeds(spark):
    feed = spark.createDataFrame([(json.dumps({"cnt": 2, "list": [{"id": "1", "nreg": "254", "datred": ""}, {"id": "2", "date": "2020"}]}),)], "p string")
    assert rows(documents.changes(feed, "p", 10).fillna(""), "law_id", "changed") == [("2", "2020"), ("254", "")]
    page = spark.createDataFrame([(1, "<tr><a href='/Review/5'>x</a></tr><tr>/Review/5 again</tr><tr>/Review/6</tr>")], "k int, h string")
    assert rows(documents.result_rows(page, "k", "h"), "seq", "id") == [(1, "5"), (2, "6")]
    loc = spark.createDataFrame([("/laws/show/a%2Fb,c",)], "l string")
    assert rows(documents.redirect_ids(loc, "l"), "law_id") == [("a/b",), ("c",)]


def test_stream_with_late_rows(spark, tmp_path):
    first = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 5), "a"), (dt.datetime(2024, 1, 1, 3, 0), "a")], "ts timestamp, k string")
    late = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 6), "a"), (dt.datetime(2024, 1, 1, 6, 0), "a")], "ts timestamp, k string")
    src = str(tmp_path / "src")
    first.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = windows.windowed(stream, "ts", "k", "1 hour", late="10 minutes").writeStream.format("memory").queryName("usage").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    late.coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    out = {r["w_start"].hour: r["n"] for r in spark.sql("select * from usage").collect()}
    assert out[0] == 1 and out.get(3, 1) == 1  # the late row of hour 0 doesn't count


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
