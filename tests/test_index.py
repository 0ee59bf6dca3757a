"""The stored index: segments, what counts, pruned reading, and ranks against brute force."""

import math
import os
import random
import re
from itertools import product

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from versed.functions import text as T
from versed.operators import index

DOCS = "id long, body string, head string, key string, term string"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, (t or "").split("\n")[0], "x", "y") for k, t in texts.items()], DOCS)


def build(spark, texts, path):
    return index.build(frame(spark, texts), "id", path, body="body", heading="head")


def slow_postings(texts):
    out = set()
    for k, t in texts.items():
        for field, text in (("body", t or ""), ("heading", (t or "").split("\n")[0])):
            words = re.findall(r"[^\W_]+", text.lower())
            out |= {(w, k, field, tuple(i + 1 for i, x in enumerate(words) if x == w), len(words)) for w in words}
    return out


def read(spark, path):
    rows = index.stored(spark, path).collect()
    assert all(r["tf"] == len(r["positions"]) for r in rows)
    found = [(r["term"], r["key"], r["field"], tuple(r["positions"]), r["fields"][r["field"]]) for r in rows]
    assert len(found) == len(set(found))
    return set(found)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_segments(spark, tmp_path):
    r, path = random.Random(1), f"{tmp_path}/index"
    words = ["law", "lawful", "lawfully", "of", "the", "sea", "été", "x1"]
    texts = {k: " ".join(r.choice(words) for _ in range(r.randint(0, 30))) + "\nsecond line" for k in range(200)}
    texts[3], texts[4], texts[5] = None, "", "law " * 5000
    assert index.state(spark, path) is None and build(spark, texts, path) == 0
    assert read(spark, path) == slow_postings(texts)
    before = files(path)
    assert build(spark, texts, path) is None  # nothing has changed
    texts[7], texts[300] = "another law", "a new one"
    del texts[8], texts[9]
    assert build(spark, texts, path) == 1
    new = {f for f in files(path) - before if "/postings/" in f or "/docs/" in f}
    assert new and all("segment=1" in f for f in new) and before <= files(path)
    assert spark.read.parquet(f"{path}/postings/segment=1").select("key").distinct().count() == 2
    assert read(spark, path) == slow_postings(texts)
    os.makedirs(f"{path}/postings/segment=9")  # a build that died
    spark.range(1).select(F.lit("zzz").alias("term")).write.parquet(f"{path}/postings/segment=9/bucket=1")
    assert read(spark, path) == slow_postings(texts)
    assert index.compact(spark, path) == 2 and index.segments(spark, path) == [2]
    assert read(spark, path) == slow_postings(texts)
    texts[9] = "back again"
    assert build(spark, texts, path) == 3 and read(spark, path) == slow_postings(texts)


def test_queries_read_their_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/index"
    build(spark, {k: f"word{k} other" for k in range(300)}, path)
    asked = spark.createDataFrame([(1, "word7 others")], "q int, words string")
    rows = index.found(asked, "q", "words", path)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    reached = {k for k in range(300) if f"word{k}".startswith("word7")}
    assert {(r["term"], r["key"]) for r in rows.collect()} == {*((f"word{k}", k) for k in reached), *(("other", k) for k in range(300))}


def slow_covers(masks, every):
    """The sum by definition: every stretch that holds all terms and has no shorter one inside."""
    at = sorted(masks)
    holds = [(a, b) for a, b in product(at, at) if a <= b and all(any(masks[p] >> t & 1 for p in at if a <= p <= b) for t in range(every))]
    least = [(a, b) for a, b in holds if not any((c, d) != (a, b) and a <= c and d <= b for c, d in holds)]
    return sum(0.1 / (1 + (b - a) - (sum(a <= p <= b for p in at) - 1)) for a, b in least)


@pytest.mark.parametrize("every", [1, 2, 3])
def test_covers_equal_their_definition(every):
    r = random.Random(every)
    for _ in range(200):
        places = [sorted(r.sample(range(1, 25), r.randint(1, 7))) for _ in range(every)]
        masks = {}
        for t, some in enumerate(places):
            for p in some:
                masks[p] = masks.get(p, 0) | 1 << t
        assert math.isclose(index.covers(list(range(every)), places, every), slow_covers(masks, every))
    assert index.covers([0, 1], [[1, 5], [5]], 0) == pytest.approx(0.2)


def test_cover_density_of_many_requests(spark, tmp_path):
    path = f"{tmp_path}/index"
    texts = {1: "alpha beta", 2: "alpha x x beta alpha", 3: "alpha only", 4: "nothing", 5: "gammas gamma alphabet beta"}
    build(spark, texts, path)
    asked = spark.createDataFrame([("both", "alpha beta"), ("any", "alpha zzzzz"), ("none", "qqqqq"), ("service", "та -"), ("twice", "beta beta")], "q string, words string")
    got = {(r["query"], r["key"]): r["rank"] for r in index.cover_density_or(asked, "q", "words", path).collect()}
    def ln(n):
        return 1 + math.log(n)

    want = {
        ("both", 1): 0.1 / ln(2), ("both", 2): (0.1 / 3 + 0.1) / ln(5), ("both", 5): 0.1 / ln(4),
        ("any", 1): 0.1 / ln(2), ("any", 2): 0.2 / ln(5), ("any", 3): 0.1 / ln(2), ("any", 5): 0.1 / ln(4), ("twice", 1): 0.1 / ln(2), ("twice", 2): 0.1 / ln(5), ("twice", 5): 0.1 / ln(4),
    }
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert {r["q"]: r["status"] for r in index.statuses(asked, "q", "words", path).collect()} == {"both": "ok", "any": "ok", "none": "ok", "service": "unusable_query", "twice": "ok"}
    assert {r["status"] for r in index.statuses(asked, "q", "words", f"{path}-absent").collect()} == {"not_built"}


def test_index_without_documents(spark, tmp_path):
    path = f"{tmp_path}/index"
    assert build(spark, {}, path) == 0 and read(spark, path) == set()
    asked = spark.createDataFrame([(1, "law")], "q int, words string")
    assert index.found(asked, "q", "words", path).count() == 0
    assert index.statuses(asked, "q", "words", path).first()["status"] == "empty"
    assert build(spark, {1: "law"}, path) == 1 and index.counted(index.found(asked, "q", "words", path)).count() == 1


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_a_build_shuffles_no_texts_or_postings(spark, tmp_path, monkeypatch):
    path, plans = f"{tmp_path}/index", []
    own = index.written
    monkeypatch.setattr(index, "written", lambda rows, *more: (plans.append(plan_of(rows)), own(rows, *more)))
    texts = {k: f"law number {k}\nof the sea" for k in range(50)}
    build(spark, texts, path)
    assert len(plans) == 1 and "Exchange" not in plans[0] and "Join" not in plans[0]
    assert read(spark, path) == slow_postings(texts)


def test_of_several_units_with_a_key_one_counts(spark, tmp_path):
    path = f"{tmp_path}/index"
    rows = [(1, "one text", "h", "x", "y"), (1, "another text", "h", "x", "y"), (1, "another text", "h", "x", "y"), (2, "alone", "h", "x", "y"), (None, "no key", "h", "x", "y")]
    index.build(spark.createDataFrame(rows, DOCS), "id", path, body="body")
    got = {(r["key"], r["term"], tuple(r["positions"])) for r in index.stored(spark, path).collect()}
    assert got in ({(1, "one", (1,)), (1, "text", (2,)), (2, "alone", (1,))}, {(1, "another", (1,)), (1, "text", (2,)), (2, "alone", (1,))})


def test_current_equals_stored_over_segments(spark, tmp_path):
    path, texts = f"{tmp_path}/index", {k: f"law {k}" for k in range(20)}
    build(spark, texts, path)
    assert "Join" not in plan_of(index.current(spark, path))
    texts[3], texts[40] = "changed", "new"
    del texts[4]
    build(spark, texts, path)
    build(spark, texts | {3: "changed again"}, path)
    both = [sorted((r["key"], r["field"], r["term"], tuple(r["positions"])) for r in f(spark, path).collect()) for f in (index.current, index.stored)]
    assert both[0] == both[1] and (3, "body", "again", (2,)) in both[0] and not any(r[0] == 4 for r in both[0])


def test_tokens_equal_the_pattern(spark):
    r, table = random.Random(5), index.word_characters(spark)
    for _ in range(300):
        texts = ["".join(r.choice("ab1é—日😀𝟙 _\n-") for _ in range(r.choice((0, 0, 1, 2, 9)))) for _ in range(r.randint(1, 6))]
        found, sizes = index.tokens(pa.array(texts), table)
        want = [re.findall(r"[^\W_]+", x) for x in texts]
        assert found.to_pylist() == sum(want, []) and list(sizes) == [len(w) for w in want]
    text = spark.createDataFrame([("x٠Ⅷ²ª̀y﻿〇ͅⒶz",)], "t string")
    want = text.select(T.index_tokens(F.col("t"))).first()[0]
    assert index.tokens(pa.array([text.select(F.lower("t")).first()[0]]), table)[0].to_pylist() == want
