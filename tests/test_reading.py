"""The read path on small tables, and what the registered queries without SQL must give, against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from versed.functions import ids, markup
from versed.functions import python as P
from versed.functions import text as T
from versed.operators import corpus, reading, records, resolve, search, temporal
from versed.plans import catalog


def one(spark, c, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(c.alias("x")).first()["x"]


def test_match_query_stages(spark):
    docs = spark.createDataFrame([(1, "intro\nthe sun shines\nend"), (2, "no hit"), (3, "the sun the sun\nx"), (4, None)], "doc_id long, text string")
    units = spark.createDataFrame([(1, "1", "the moon"), (1, "2", "named body"), (3, "7", "the sun the sun"), (3, "9", "the sun the sun")], "doc_id long, num string, body string")
    out = {r["doc_id"]: r for r in reading.match_query(docs, "doc_id", "text", units, "num", "body", ["the", "sun"], "2").collect()}
    assert set(out) == {1, 3} and (out[1]["score"], out[1]["score_kind"], out[1]["snippet"]) == (10_000.0, "direct", "named body")
    assert out[3]["score_kind"] == "article" and out[3]["score"] == 1000.0 and out[3]["snippet"] == "the sun the sun\n\n---\n\nthe sun the sun"
    out = {r["doc_id"]: r for r in reading.match_query(docs, "doc_id", "text", units, "num", "body", ["the", "sun"]).collect()}
    assert out[1]["score_kind"] == "line" and out[1]["snippet"] == "intro\nthe sun shines\nend" and abs(out[1]["score"] - 400.0) < 1e-9
    assert reading.match_query(docs, "doc_id", "text", units, "num", "body", []).count() == 0
    found = reading.match_query(docs, "doc_id", "text", units, "num", "body", ["the", "sun"])
    shown = {r["doc_id"]: r["snippet"] for r in reading.search_in_text(docs, "doc_id", "text", found, "the sun").collect()}
    assert shown[2] == shown[4] == "" and shown[1].startswith("intro")
    assert {r["doc_id"]: r["snippet"] for r in reading.search_in_text(docs, "doc_id", "text", found, " ").collect()}[2] == "no hit"


def test_excerpts_and_statuses(spark):
    text = " ".join(f"w{k}" for k in range(40))
    assert one(spark, T.excerpt(F.col("t"), ["w20"]), t=text) == " … " + " ".join(f"w{k}" for k in range(13, 27)) + " … "
    assert one(spark, T.excerpt(F.col("t"), ["zzz"]), t="a b") == "a b" and one(spark, T.excerpt(F.col("t"), ["a"]), t="") == ""
    assert one(spark, T.query_status(F.col("t")), t="та -") == "unusable_query" and one(spark, T.query_status(F.col("t")), t="мова") == "ok"
    lines = ["text", "see DISSENTING OPINION of x", "JOINT DISSENTING OPINION", "rest"]
    assert one(spark, T.own_lines(F.split("t", "\n")), t="\n".join(lines)) == lines[:2]


@pytest.mark.parametrize(("text", "doc_id", "kind"), [
    ("ВЕРХОВНА РАДА УКРАЇНИ\nЗАКОН УКРАЇНИ", "1", "law"), ("КАБІНЕТ МІНІСТРІВ УКРАЇНИ\nЗАКОН", "1", "bylaw"), ("назва\nКОДЕКС", "1178-2022-п", "bylaw"),
    ("A; Невідоме від 01.02.2003\nРада; Кодекс від 01.02.2003", "1", "code"), ("1234\n5678 - 9\nтекст", "1", "unknown"), (None, None, "unknown"),
])
def test_kinds_by_text(spark, text, doc_id, kind):
    assert one(spark, T.document_kind(F.col("t"), F.col("i")), t=text, i=doc_id) == kind


def test_aliases_replace_beginnings(spark):
    aliases = spark.createDataFrame([("закон про мову", "a"), ("про освіту", "b")], "alias string, law_id string")
    asked = spark.createDataFrame([("ЗУ про мову",), ("Закон України про освіту",), ("зу",)], "q string")
    assert {r["q"]: (r["law_id"], r["matched_by"]) for r in resolve.by_alias(asked, "q", aliases).collect()} == {"ЗУ про мову": ("a", "alias"), "Закон України про освіту": ("b", "alias")}


@pytest.mark.parametrize(("f", "x", "want"), [
    (ids.normal_eli, "https://eur-lex.europa.eu/eli/reg/2016/679/oj/lit/html", "http://data.europa.eu/eli/reg/2016/679/oj"), (ids.normal_eli, "eli/reg/2016/679/oj/nld/pdf/nld/xml/eng", "http://data.europa.eu/eli/reg/2016/679/oj"),
    (ids.normal_eli, "eli/reg/2016/eng", "http://data.europa.eu/eli/reg/2016/eng"), (ids.annex, "додаток 2", "II"), (ids.annex, "anx_iv", "IV"), (ids.annex, "5", None),
    (ids.case_number, " C-605%252F26%2520P", "c-605/26 p"), (ids.case_number, None, ""), (ids.redaction_date, "редакція від 01.02.2003", "2003-02-01"), (ids.redaction_date, "x", None),
    (ids.flag, " True ", True), (ids.flag, "yes", None), (ids.without_dot, " Name. ", "Name"), (ids.without_dot, " . ", None), (ids.address_fault, "C:\\x", "path"), (ids.address_fault, "ст. 5", None), (ids.language_code, "uk", None), (ids.language_code, "", "eng"),
])
def test_identifier_rules(spark, f, x, want):
    assert one(spark, f(F.col("t")), t=x) == want


def test_pages_with_unclosed_tags():
    page = "<html><body>" + "<p>" * 3000 + "<div>" * 3000 + "text" + "<li>" * 3000
    assert isinstance(markup.units(page), list)


def test_containment_meets_on_rare_grams(spark):
    a, b = [f"nation_{k}" for k in range(30)] + ["xy", "nation"], [f"the nation_{k} of" for k in range(25)] + ["ation", "x", "nation_3"]
    got = {(r["q"], r["alias"]) for r in records.containment(spark.createDataFrame([(x,) for x in a], "q string"), "q", spark.createDataFrame([(x,) for x in b], "alias string"), "alias").collect()}
    assert got == {(x, y) for x in a for y in b if x in y or y in x}


def test_windows_by_stretches_equal_whole_windows(spark):
    r = np.random.default_rng(1)
    rows = [(f"p{k % 3}" if k % 3 else None, int(k), int(r.integers(0, 40)), f"h{r.integers(0, 3)}") for k in range(200)]
    df = spark.createDataFrame(rows, "part string, at long, size long, h string")
    want, states = [], {}
    for part in (None, "p1", "p2"):
        used, last = 0, None
        for n, (_, at, size, h) in enumerate(x for x in rows if x[0] == part):
            states[at] = (last, "unknown" if last is None else "same" if last == h else "changed")
            last = h
            if used is not None and n and used + size > 300:
                used = None
            if used is not None:
                want.append((at, used))
                used += size + 1
    for span in (7, 1 << 16):
        got = corpus.within_budget(df, "part", "at", F.col("size"), 300, span=span)
        assert sorted((x["at"], x["used_before"]) for x in got.collect()) == sorted(want) and set(got.columns) == {*df.columns, "used_before"}
        got = temporal.change_state(df, ["part"], "at", "h", span=span)
        assert {x["at"]: (x["prev_hash"], x["state"]) for x in got.collect()} == states


def test_nearest_vectors(spark):
    r = np.random.default_rng(2)
    vectors = r.integers(-3, 4, (90, 4)).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id long, v array<double>").repartition(5)
    unit = vectors / np.sqrt((vectors**2).sum(1, keepdims=True))
    for block in (4, 1000):
        got = {}
        for x in search.nearest(df.where("id % 9 = 0"), df, "id", "v", 3, block).collect():
            got.setdefault(x["query"], []).append((x["score"], x["id"]))
        for q in range(0, 90, 9):
            if np.isfinite(unit[q]).all():
                want = sorted((-round(float(unit[q] @ unit[k]), 9), k) for k in range(90) if k != q and np.isfinite(unit[k]).all())[:3]
                assert sorted((-s, k) for s, k in got[q]) == want
    assert search.nearest(df.where("false"), df, "id", "v", 3).count() == 0


QUOTES = ["beta gamma", "alp", "alpha beta gamma delta epsilon zeta", "ta gamma delta eps", "one two three four five six seven", "e si", "nowhere at all in these texts"]
BODIES = ["alpha beta gamma delta epsilon zeta eta", "x one two three four five six sevenths", "nothing", "", None]


def test_quotes_of_any_length_are_found(spark, tmp_path):
    spark.createDataFrame(list(enumerate(QUOTES)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(BODIES)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i, d, b.index(q) + 1) for i, q in enumerate(QUOTES) for d, b in enumerate(BODIES) if b and q in b}
    for rules in (None, ("whitespace",)):
        got = [(r["item_id"], r["doc_id"], r["position"]) for r in catalog._pairs(spark, str(tmp_path), rules).collect()]
        assert set(got) == want and len(got) == len(want)


def test_altered_quotes_are_found_in_all_documents(spark, tmp_path):
    quote = "the quick brown fox jumps over the lazy dog near the old river bank today"
    filler = " ".join(f"w{k}" for k in range(20_000))
    texts = [f"{filler} {quote.replace('lazy', 'sleepy')} {filler}", quote.upper().lower(), "other words altogether here", f"x {quote.replace('fox jumps', 'cat leaps')} y"]
    spark.createDataFrame([(7, quote)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in catalog.quote_nearest(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 3} and got[1]["status"] == "exact" and got[1]["start"] == 0
    assert got[0]["status"] == "mismatch" and "sleepy dog" in texts[0][got[0]["start"] : got[0]["start"] + got[0]["len"]]

    def share(body):
        a, b = ([tuple(w[k : k + 4]) for k in range(len(w) - 3)] for w in (re.findall(r"\w+", x.lower()) for x in (quote, body)))
        return len(set(a) & set(b)) >= 0.2 * len(a)

    assert set(got) == {k for k, t in enumerate(texts) if share(t)}


def slow_chunks(text, most=1500):
    out, waiting = [], []
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        while len(p) > most:
            out.append(p[:most])
            p = p[most:].strip()
        if p and waiting and len("\n\n".join([*waiting, p])) > most:
            out.append("\n\n".join(waiting))
            waiting = []
        waiting += [p] * bool(p)
    return out + ["\n\n".join(waiting)] * bool(waiting)


def test_chunks_equal_a_plain_loop():
    r = np.random.default_rng(3)
    for _ in range(300):
        text = "\n\n".join("ab c"[k % 4] * int(r.integers(0, 700)) for k in range(int(r.integers(0, 9))))
        assert [b for _, _, b in P.chunks(text, 300)] == slow_chunks(text, 300)


def test_filters_gates_and_cards(spark):
    asked = F.create_map(F.lit("date"), F.lit("x"), F.lit("z"), F.lit(None).cast("string"))
    assert tuple(one(spark, reading.filters(asked, ("date",), F.array(F.lit("date"))))) == ("ok", "date=declared")
    assert tuple(one(spark, reading.filters(asked, ("court",), F.array(F.lit("date"))))) == ("unsupported_filter", "date")
    rows = spark.createDataFrame([(1, "text", "t"), (2, " ", "t"), (3, "x", "")], "id long, text string, title string")
    good, bad = reading.accepted(rows, corpus.persistence(F.col("text"), F.lit("law"), F.lit(True), F.col("title"), F.lit(2)))
    assert [r["id"] for r in good.collect()] == [1] and Counter(r["reason"] for r in bad.collect()) == {"empty text": 1, "no real title": 1}
    assert tuple(one(spark, reading.select_revision(F.lit(None), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("b")))) == ("b", "base")
