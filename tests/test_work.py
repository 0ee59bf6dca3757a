"""Work that keeps state: near vectors by cells, backfill, sessions, tables replaced in one step, feeds; each against brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from versed.operators import backfill, corpus, resolve, search, vectors
from versed.sources import documents
from versed.streaming import evidence

# --- near vectors ---


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16)) * 4
    rows = [(k, (centres[k % 12] + r.normal(size=16)).tolist()) for k in range(600)]
    rows += [(1000, [0.0] * 16), (1001, None), (1002, [1.0, None, *[0.0] * 14]), (1003, [1.0] * 4), (1004, rows[0][1]), (1005, rows[0][1])]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(3)


def test_cells_find_the_neighbours(spark, points, tmp_path):
    cells, probes = vectors.build(points, "id", "v", f"{tmp_path}/cells", cells=12)
    assert cells == 12 and 1 <= probes < 12
    asked = points.where("id % 20 = 0")
    exact = search.nearest(asked.where("id < 1000"), points.where("id < 1001 or id > 1003"), "id", "v", 10).withColumnRenamed("id", "key").cache()
    found = vectors.nearest(asked, "id", "v", f"{tmp_path}/cells", 10)
    assert vectors.recall(found, exact) >= 0.9
    every = vectors.nearest(asked, "id", "v", f"{tmp_path}/cells", 10, probes=12)
    assert sorted(map(tuple, every.select("query", "key", "score").collect())) == sorted(map(tuple, exact.select("query", "key", "score").collect()))
    assert vectors.build(points.where("false"), "id", "v", f"{tmp_path}/none") == (0, 1) and vectors.nearest(asked, "id", "v", f"{tmp_path}/none", 10).count() == 0


# --- backfill ---


def broken(path, fails):
    """A function that counts its calls in a file and fails at some."""
    name = str(path)

    def embed(texts):
        with open(name, "a+") as f:
            f.seek(0)
            n = len(f.read())
            f.write("x")
        if fails(n):
            raise RuntimeError("quota")
        return [[float(len(t))] if t != "none" else [] for t in texts]

    return embed


def test_backfill_resumes_and_does_each_row_once(spark, tmp_path):
    units = spark.createDataFrame([(k, "y" * (k + 1)) for k in range(100)] + [(200, " "), (201, None), (None, "z"), (5, "other")], "id long, text string")
    path = f"{tmp_path}/vectors"
    first = backfill.vectors(units, "id", "text", path, broken(tmp_path / "a", lambda n: False), "m", batch=8, rows_of_a_wave=32, most_rows=40)
    assert (first.written, first.failed_batches, first.remaining, first.stopped) == (40, 0, 60, False)
    second = backfill.vectors(units, "id", "text", path, broken(tmp_path / "b", lambda n: n == 1), "m", batch=8, rows_of_a_wave=32)
    assert second.written == 60 and second.failed_batches >= 1 and second.remaining == 0
    rows = backfill.stored(spark, path).collect()
    assert sorted(r["key"] for r in rows) == list(range(100)) and all(r["vector"] == [float(r["key"] + 1)] for r in rows if r["key"] != 5)
    assert backfill.vectors(units, "id", "text", path, broken(tmp_path / "c", lambda n: True), "m").written == 0 and not (tmp_path / "c").exists()


def test_backfill_stops_after_failures_in_a_row(spark, tmp_path):
    units = spark.createDataFrame([(k, "text") for k in range(64)] + [(100, "none")], "id long, text string").coalesce(1)
    report = backfill.vectors(units, "id", "text", f"{tmp_path}/v", broken(tmp_path / "n", lambda n: True), "m", batch=4, most_failures=3)
    assert report.stopped and report.written == 0 and report.remaining == 65 and len((tmp_path / "n").read_text()) == 3
    again = backfill.vectors(units, "id", "text", f"{tmp_path}/v", broken(tmp_path / "k", lambda n: False), "m", batch=4, most_failures=3)
    assert again.written == 64 and again.remaining == 1 and again.stopped  # the empty vector isn't stored


def test_backfill_of_units(spark):
    from versed.functions.python import chunks

    versions = spark.createDataFrame([(1, "a\n\nb"), (2, "c"), (3, " ")], "v long, text string")
    have = spark.createDataFrame([(2,)], "version long")
    got = backfill.units(versions, "v", "text", have, "version", chunks).collect()
    assert {r["v"] for r in got} == {1}


# --- sessions ---


def slow_sessions(events, limits):
    """(id, status, n, chars) of the events in order of session, time and id, as the rule reads."""
    out, held = [], {}
    for session, at, ident, entry, size, agent in sorted(events):
        s = held.setdefault(session, {"entries": {}, "agents": {}, "last": None})
        if s["last"] is not None and at - s["last"] > limits.ttl:
            s.update(entries={}, agents={}, last=None)
        chars = sum(s["entries"].values())
        if entry in s["entries"]:
            status = "known"
        elif len(s["entries"]) >= limits.entries or chars + size > limits.chars:
            status = "session_full"
        elif agent and s["agents"].get(agent, 0) >= limits.agent:
            status = "agent_full"
        else:
            status = "accepted"
            s["entries"][entry] = size
            s["agents"][agent] = s["agents"].get(agent, 0) + bool(agent)
        if status in ("known", "accepted"):
            s["last"] = at
        out.append((ident, status, len(s["entries"]), sum(s["entries"].values())))
    return out


LIMITS = evidence.Limits(entries=6, chars=300, agent=3, ttl=100)


def made_events(n=400):
    r = random.Random(7)
    return [(f"s{r.randint(0, 5)}", float(r.randint(0, 4000)), f"{k:04d}", f"e{r.randint(0, 9)}", r.randint(1, 90), r.choice(["", "a", "b"])) for k in range(n)]


EVENTS = "session string, at double, id string, entry string, size long, agent string"


def prepared(df):
    return evidence.prepared(df.withColumn("ts", F.timestamp_seconds("at")), "session", "ts", "id", F.col("entry"), F.col("size"), F.col("agent"))


def test_sessions_of_a_table(spark):
    events = made_events()
    rows = spark.createDataFrame([*events, (None, 1.0, "x", "e", 1, ""), ("s1", None, "y", "e", 1, "")], EVENTS).repartition(4)
    got = [(r["id"], r["status"], r["n"], r["chars"]) for r in evidence.decided(prepared(rows), LIMITS).collect()]
    assert sorted(got) == sorted(slow_sessions(events, LIMITS)) and {s for _, s, _, _ in got} == {"accepted", "known", "session_full", "agent_full"}
    assert evidence.decided(prepared(rows.where("false"))).count() == 0


def test_sessions_of_a_stream_forget_and_drop_late_rows(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = sorted(made_events(), key=lambda e: e[1])
    feed = tmp_path / "feed"
    feed.mkdir()

    def run(some, name):
        with open(feed / f"{name}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(("session", "at", "id", "entry", "size", "agent"), e, strict=True))) + "\n" for e in some)
        stream = prepared(spark.readStream.schema(EVENTS).json(str(feed)))
        query = evidence.decided_stream(stream, "10 seconds", LIMITS).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    run(events[:200], "a")
    run(events[200:], "b")  # the state of the first run goes on
    run([("s9", 10_000.0, "end", "e", 1, ""), ("s1", 20.0, "late", "e1", 1, "")], "c")
    run([("s1", 30.0, "later", "e1", 1, "")], "d")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    got = {(r["id"], r["status"], r["n"], r["chars"]) for r in rows if r["id"] not in (None, "end", "late", "later")}
    assert got == set(slow_sessions(events, LIMITS))
    assert "later" not in {r["id"] for r in rows} and {r["session"] for r in rows if r["status"] == "forgotten"} >= {f"s{k}" for k in range(6)}


# --- tables in one step, feeds, names ---


def test_tables_are_replaced_in_one_step(spark, tmp_path):
    folder = f"{tmp_path}/corpus"
    assert documents.read_tables(spark, folder) == {}
    one = {name: spark.createDataFrame([(1, name)], "id long, x string") for name in ("laws", "units", "vectors")}
    documents.replace_tables(one, folder)
    before = documents.read_tables(spark, folder)
    for name in ("laws", "units"):  # a writer that dies between its tables
        spark.range(5).write.parquet(f"{folder}/{name}/v-died")
    assert {k: v.count() for k, v in documents.read_tables(spark, folder).items()} == {"laws": 1, "units": 1, "vectors": 1}
    documents.replace_tables({"units": spark.range(7), "vectors": spark.range(0)}, folder)
    assert {k: v.count() for k, v in documents.read_tables(spark, folder).items()} == {"laws": 1, "units": 7, "vectors": 0}
    assert {k: v.count() for k, v in before.items()} == {"laws": 1, "units": 1, "vectors": 1}  # a reader that began earlier


def test_oversize_units_and_their_vectors(spark):
    units = spark.createDataFrame([(1, "a", "x" * 25), (2, "b", "y"), (3, "c", None)], "unit long, key string, body string")
    vecs = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (9, [9.0])], "unit long, v array<double>")
    u, v = corpus.replace_oversize(units, vecs, "unit", "key", "body", over=20, piece=10)
    assert sorted((r["key"], r["unit"], len(r["body"] or "")) for r in u.collect()) == [("a", None, 10), ("a#2", None, 10), ("a#3", None, 5), ("b", 2, 1), ("c", 3, 0)]
    assert sorted(r["unit"] for r in v.collect()) == [2, 9]


def test_fuzzy_units_equal_one_request_at_a_time(spark):
    r = random.Random(6)
    keys = ["179", "179-1", "179.2", "1791", "18", "18-2-1", "-3", "a.b.c", "a"]
    units = [(law, k, n) for law in ("x", "y") for n, k in enumerate(r.sample(keys, 7))]
    asked = [(k, law, q) for k, (law, q) in enumerate((law, q) for law in ("x", "y", "z", None) for q in (*keys, "18–2", " 179 ", "", None, "a.b"))]
    frame = spark.createDataFrame(units, "law string, key string, ordinal long")
    got = {r["n"]: (r["unit"]["key"] if r["unit"] else None) for r in corpus.fuzzy_units(spark.createDataFrame(asked, "n long, law string, asked string"), frame, "law", "asked", "key", "ordinal").collect()}
    assert len(got) == len(asked)
    for n, law, q in asked:
        target = (q or "").strip().replace("–", "-")
        mine = [k for of, k, _ in sorted(units, key=lambda u: u[2]) if of == law]
        want = (target if target in mine else next((k for k in mine if k.startswith((f"{target}-", f"{target}."))), None)) if target else None
        assert got[n] == want, (law, q)


def test_a_feed_that_starts_again_reads_nothing_twice(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()

    def run():
        query = documents.change_feed(spark, str(folder), 1).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r["file"], r["n"], r["law_id"], r["changed"]) for r in spark.read.schema("file string, n int, law_id string, title string, changed string").parquet(f"{tmp_path}/out").collect())

    (folder / "a.json").write_text(json.dumps({"cnt": 2, "list": [{"nreg": "1", "datred": "20240101"}, {"id": "2", "organs": "x"}]}))
    first = [("a.json", 0, "1", "20240101"), ("a.json", 1, "2", "x")]
    assert run() == first and run() == first
    (folder / "b.json").write_text(json.dumps([{"id": "3", "date": "d"}]))
    assert run() == [*first, ("b.json", 0, "3", "d")]


def test_aliases_lose_number_signs_and_blanks(spark):
    aliases = spark.createDataFrame([("Закон  № 435-15", "435-15"), ("закон про мову", "m")], "alias string, law_id string")
    asked = spark.createDataFrame([("№ 435-15",), ("зу  про   мову",), ("ЗАКОН №435-15",)], "q string")
    assert {r["q"]: r["law_id"] for r in resolve.by_alias(asked, "q", aliases).collect()} == {"№ 435-15": "435-15", "зу  про   мову": "m", "ЗАКОН №435-15": "435-15"}


def test_quotas_and_ladders_over_many_stretches(spark):
    from versed.operators import records

    r = random.Random(8)
    rows = [("hot" if k % 3 else f"p{k % 5}", k, r.randint(1, 20), r.random() < 0.8) for k in range(400)] + [(None, k, 1, True) for k in range(400, 420)]
    df = spark.createDataFrame(rows, "p string, t long, size long, bad boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x["t"]: (x["n"], x["chars"], x["allowed"]) for x in records.quota(df, "p", "t", F.col("size"), 50, 300).collect()}
        steps = {x["t"]: (x["attempt"], x["delay_s"]) for x in records.ladder(df, "p", ["t"], F.col("bad")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, tries = {}, {}
    for part in {x[0] for x in rows}:
        n = used = failed = 0
        for _, t, size, bad in (x for x in rows if x[0] == part):
            n, used, failed = n + 1, used + size, failed + 1 if bad else 0
            want[t] = (n, used, n <= 50 and used <= 300)
            if bad:
                tries[t] = (failed, records.LADDER[min(failed, 5) - 1])
    assert got == want and steps == tries
