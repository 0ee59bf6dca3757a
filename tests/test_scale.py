"""Steps whose cost was out of proportion: what passes through one task, what is worked out twice, what is shuffled."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from versed.functions import text as T
from versed.operators import backfill, reading, vectors

SF = "/root/testdata/sf0.001"


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString().split("\n")


def test_a_wave_of_many_rows_is_no_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(backfill, "ONE_TASK", 3)
    gap = spark.createDataFrame([((k * 7) % 20, str(k), k % 3) for k in range(20)], "key long, text string, place long")
    first = backfill.first_of(gap, 8)
    want = sorted((k % 3, (k * 7) % 20) for k in range(20))[:8]
    assert [(r["place"], r["key"]) for r in first.collect()] == want
    assert not any("TakeOrdered" in line for line in plan_of(backfill.first_of(gap, 100)))
    assert not any("TakeOrdered" in line and "text" in line for line in plan_of(first))


def test_match_query_scores_each_text_once(spark):
    docs = spark.createDataFrame([(1, "the sun\nthe moon and the sun"), (2, "the sun alone"), (3, "nothing")], "id long, text string")
    units = spark.createDataFrame([(1, "1", "the sun"), (1, "2", "the moon and the sun")], "id long, num string, body string")
    words = reading.by_words(docs, "id", "text", units, "num", "body", ["the", "sun"])
    assert sum("Scan ExistingRDD" in line for line in plan_of(words)) == 2
    for named in (None, "2"):
        one, two = (sorted(map(tuple, reading.match_query(docs, "id", "text", units, "num", "body", ["the", "sun"], named, words=w).collect())) for w in (None, words))
        assert one == two and len(one) == 2


def slow_excerpt(text, tokens, size):
    ws = re.findall(f"[^{T.BLANK}]+", text)
    def hit(w):
        low = re.sub(f"^(?:(?!{T.TOKEN}).)+|(?:(?!{T.TOKEN}).)+$", "", w.lower())
        return any(low.startswith(s) if p else low == s for s, p in map(T.stem_of, tokens))

    first = next((k for k, w in enumerate(ws) if hit(w)), 0)
    begin = max(0, min(first - size // 2, len(ws) - size))
    return (" … " if begin > 0 else "") + " ".join(ws[begin : begin + size]) + (" … " if begin + size < len(ws) else "")


def test_excerpts_equal_their_definition(spark):
    r = random.Random(2)
    words = ["The", "the", "(the", "the,", "x—the", "the-", "—", "thesis", "lawful", "«Lawfully»", "a", "é", "été", "other"]
    blanks = [" ", "\n", "  ", " ", " \t"]
    texts = ["".join(r.choice(words) + r.choice(blanks) for _ in range(r.randint(0, 25))) for _ in range(400)] + ["", " ", " the", "the"]
    texts += [r.choice(blanks) + t for t in texts[:100]]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").cache()
    for tokens in (["the"], ["lawfully", "é"], ["zzz", "the"]):
        got = {x[0]: x[1] for x in rows.select("k", T.excerpt(F.col("t"), tokens, 6)).collect()}
        assert got == {k: slow_excerpt(t, tokens, 6) for k, t in enumerate(texts)}
    got = {x[0]: tuple(x[1:]) for x in rows.select("k", T.n_space_words(F.col("t")), T.token_count(F.lower("t"), "the"), T.token_count(F.lower("t"), "lawfully")).collect()}
    def count(t, start, end):
        return len(re.findall(f"(?<!{T.TOKEN[:-1]}){start}{end}", t.lower()))

    assert got == {k: (max(1, len(re.findall(f"[^{T.BLANK}]+", t))), count(t, "the", f"(?!{T.TOKEN[:-1]})"), count(t, "lawfu", "")) for k, t in enumerate(texts)}
    assert not any("transform" in line and "regexp_replace" in line for line in plan_of(rows.select(T.excerpt(F.col("t"), ["the"]))))


def test_kind_tiebreak_scores_no_text_in_a_filter(spark):
    lines = plan_of(entry.queries()["kind_tiebreak_order"](spark, SF))
    assert not any(re.search(r"\bFilter .*text#", line) for line in lines)


def test_version_chain_hashes_behind_the_shuffles(spark):
    lines = plan_of(entry.queries()["version_chain"](spark, SF))
    shuffles = [k for k, line in enumerate(lines) if "Exchange" in line]
    assert shuffles and max(k for k, line in enumerate(lines) if "sha2(" in line) < min(shuffles)


def test_vectors_go_by_blocks(spark):
    rows = spark.range(200).select(F.col("id").alias("key"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("unit"), (F.col("id") % 3).cast("int").alias("cell")).coalesce(1)
    made = vectors.blocks(rows).collect()
    assert len(made) == 3
    for b in made:
        x = np.frombuffer(b["units"]).reshape(-1, 2)
        assert b["keys"] == [k for k in range(200) if k % 3 == b["cell"]] and x[:, 0].tolist() == b["keys"]
