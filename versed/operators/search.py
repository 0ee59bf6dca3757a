"""Lexical, vector and fused search over tables of texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versed.functions import text as T
from versed.plans.session import bounded, workspace
from versed.sources.documents import landed

#: Reciprocal-rank constant, BM25 parameters and weights of heading and body.
RRF, K1, B, HEADING, BODY = 60, 1.2, 0.75, 5.0, 1.0


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in a total order: one heap for each task, no global sort."""
    return df.orderBy(*order).limit(k)


def by_density(units: DataFrame, key: str, text: str, tokens: list[str]) -> DataFrame:
    """key and score of the units in which every token hits, hits per 1000 words."""
    rows = units.where(T.may_hit(F.lower(text), tokens))
    return rows.select(key, F.explode(F.array(T.density(F.col(text), tokens))).alias("score")).where("score > 0")  # exploded, so that the filter doesn't work the score out again


def token_hits(units: DataFrame, key: str, text: str, tokens: list[str]) -> DataFrame:
    """key, token and hits, for tokens that hit."""
    low = F.lower(text)
    each = F.array(*(F.struct(F.lit(t).alias("token"), T.token_count(low, t).cast("long").alias("hits")) for t in tokens))
    return units.where(reduce(lambda a, b: a | b, (T.may_hit(low, [t]) for t in tokens))).select(key, F.inline(each)).where("hits > 0")


def terms_search(units: DataFrame, key: str, text: str, tokens: list[str], every: bool) -> DataFrame:
    """key and n_terms (query terms that occur): units with all terms, or any."""
    found = token_hits(units, key, text, tokens).groupBy(key).agg(F.count(F.lit(1)).alias("n_terms"))
    return found.where(F.col("n_terms") == len(tokens)) if every else found


def and_or_search(units: DataFrame, key: str, text: str, tokens: list[str]) -> DataFrame:
    """Units with all terms; only if there are none, those with any."""
    n = token_hits(units, key, text, tokens).groupBy(key).agg(F.count(F.lit(1)).alias("n_terms"))
    every = F.col("n_terms") == len(tokens)
    return n.where(every | ~n.where(every).exists())  # both read one exchange


def postings(units: DataFrame, key: str, **fields: str) -> DataFrame:
    """term, key, field and tf: the inverted index of the fields' index tokens."""
    parts = [units.select(key, F.lit(name).alias("field"), F.explode(T.index_tokens(F.col(column))).alias("term")) for name, column in fields.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("term", key, "field").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(units: DataFrame, key: str, text: str) -> DataFrame:
    """term, df (units) and cf (occurrences) of the search tokens. Rows of one key are units each."""
    bounded(units.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            coded = lists.flatten().dictionary_encode()
            if len(coded):
                words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                own = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
                n = len(coded.dictionary)
                df = np.bincount(np.unique(own * n + words) % n, minlength=n)
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(df), pa.array(np.bincount(words, minlength=n))], names=["term", "df", "cf"])

    rows = units.select(T.words(F.col(text)).alias("terms")).mapInArrow(run, "term string, df long, cf long")  # counted within a batch, so only its distinct terms are shuffled
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def bm25(units: DataFrame, key: str, body: str, tokens: list[str], heading: str | None = None) -> DataFrame:
    """key and score (higher is better) of the units that have every token as a stem prefix.

    One pass counts units, lengths and matches by token; a second scores. No postings are shuffled: a query's terms are
    counted inside each unit's token array.
    """
    def counted(text: Column, token: str) -> Column:
        start, prefix = T.stem_of(token)
        return F.size(F.filter(text, lambda w: w.startswith(start) if prefix else w == start))

    rows = units.select(key, T.index_tokens(F.col(body)).alias("b"), (T.index_tokens(F.col(heading)) if heading else F.array().cast("array<string>")).alias("h"))
    weighted = [(HEADING * counted(F.col("h"), t) + BODY * counted(F.col("b"), t)).alias(f"t{k}") for k, t in enumerate(tokens)]
    rows = rows.select(key, (F.size("b") + F.size("h")).alias("n"), *weighted)
    sums = rows.agg(F.count(F.lit(1)).alias("units"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"t{k}") > 0).alias(f"d{k}") for k in range(len(tokens)))).first()
    score = F.lit(0.0)
    for k in range(len(tokens)):
        idf = F.greatest(F.lit(1e-6), F.log((F.lit(sums["units"] - sums[f"d{k}"]) + 0.5) / (F.lit(sums[f"d{k}"]) + 0.5)))
        tf = F.col(f"t{k}")
        score = score + idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("n") / (sums["mean"] or 1.0)))
    every = reduce(lambda a, b: a & b, (F.col(f"t{k}") > 0 for k in range(len(tokens))))
    return rows.where(every).select(key, score.alias("score"))


def line_windows(units: DataFrame, key: str, text: str, tokens: list[str], before: int = 3, after: int = 7) -> DataFrame:
    """key, line_no (from 1), score and window_text: the lines in which every token hits, with the lines around them."""
    rows = units.where(T.may_hit(F.lower(F.col(text)), tokens)).select(key, F.split(F.col(text), "\n").alias("lines"))
    n = F.size("lines")
    hit = F.filter(
        F.transform("lines", lambda x, i: F.struct(i.alias("i"), T.density(x, tokens).alias("score"))), lambda s: s["score"] > 0)
    rows = rows.select(key, "lines", n.alias("n"), F.explode(hit).alias("s"))
    start = F.greatest(F.lit(0), F.col("s.i") - before)
    window = F.slice("lines", start + 1, F.least(F.col("n"), F.col("s.i") + after + 1) - start)
    return rows.select(key, (F.col("s.i") + 1).cast("long").alias("line_no"), F.col("s.score").alias("score"), F.array_join(window, "\n").alias("window_text"))


def catalogue_score(ident: Column, title: Column, query: str) -> Column:
    """10000 for the id, 5000 for a part of it, 2000 and a share for a part of the title, else the tokens that occur; 0 is no match."""
    q = query.lower().strip()
    low, name = F.lower(ident.cast("string")), F.lower(title)
    tokens = [t for t in q.split() if t]
    loose = sum((F.when(name.contains(t) | low.contains(t), 1.0).otherwise(0.0) for t in tokens), F.lit(0.0))
    return F.when(low == q, 10_000.0).when(low.contains(q), 5_000.0).when(name.contains(q), 2_000.0 + F.lit(float(len(q))) / F.greatest(F.length(name), F.lit(1))).otherwise(loose)


def confident(ident: Column, title: Column, query: str) -> Column:
    """Whether a catalogue row matches beyond doubt."""
    q = query.lower().strip()
    low, name = F.lower(ident.cast("string")), F.lower(title)
    long = [t for t in q.split() if len(t) >= 4]
    sure = low.contains(q)
    if len(q) >= 6 or len(long) >= 2:
        sure = sure | name.contains(q)
    if long:
        sure = sure | reduce(lambda a, b: a & b, (name.contains(t) for t in long))
    return sure


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers, in double precision; null if a norm is 0."""
    a, b = a.cast("array<double>"), b.cast("array<double>")

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """query, key and score: for each query vector the k nearest others by cosine (9 decimals, ties by key), exactly.

    Queries go out in blocks of about `block`, told by a hash, so that what is sent and what a worker holds is bounded; each
    block is a pass over the vectors, written before the next one. A task keeps the k best of its rows for each query of a
    block, and the tasks' bests are merged.
    """
    spark = vectors.sparkSession
    bounded(spark)
    blocks = max(1, -(-queries.count() // block))
    kind = vectors.schema[key].dataType.simpleString()

    def unit(rows) -> np.ndarray:
        x = np.array(rows.to_pylist(), dtype=float).reshape(len(rows), -1)
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, n, out=np.full_like(x, np.nan), where=n > 0)

    out = []
    for b in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).select(key, vector).toArrow()
        if not asked.num_rows:
            continue
        sent = spark.sparkContext.broadcast((asked[key].to_numpy(), unit(asked[vector])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            kept = []  # the best keys and scores so far, a column for each query
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(key).to_numpy(zero_copy_only=False)
                score = np.round(unit(batch.column(vector)) @ matrix.T, 9)
                score[own[:, None] == ids] = np.nan  # not itself; nor vectors of no length
                names = np.broadcast_to(own[:, None], score.shape)
                if kept:
                    names, score = np.concatenate([kept[0], names]), np.concatenate([kept[1], score])
                by = np.argsort(names, axis=0, kind="stable")
                names, score = np.take_along_axis(names, by, 0), np.take_along_axis(score, by, 0)
                by = np.argsort(-score, axis=0, kind="stable")[:k]  # nan sorts last
                kept = [np.take_along_axis(names, by, 0), np.take_along_axis(score, by, 0)]
            if kept:
                good = ~np.isnan(kept[1])
                of = np.broadcast_to(ids, good.shape)[good]
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(kept[0][good]), pa.array(kept[1][good])], names=["query", key, "score"])

        found = vectors.select(key, vector).mapInArrow(run, f"query {kind}, {key} {kind}, score double")
        out.append(landed(found, workspace(spark)) if blocks > 1 else found)
    rows = reduce(DataFrame.unionByName, out) if out else vectors.select(F.col(key).alias("query"), key, F.lit(0.0).alias("score")).where("false")
    merged = rows.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col(key)))), 1, k).alias("best"))  # k rows for each task
    return merged.select("query", F.explode("best").alias("b")).select("query", F.col(f"b.{key}").alias(key), (-F.col("b.far")).alias("score"))


def ranked(hits: DataFrame, key: str, channel: str, pool: int) -> DataFrame:
    """key, channel and rank (from 1) of the best `pool` hits by (score desc, key)."""
    best = top(hits, pool, F.desc("score"), F.col(key))
    return best.select(key, F.lit(channel).alias("channel"), F.row_number().over(W.orderBy(F.desc("score"), F.col(key))).alias("rank"))  # of `pool` rows


def fused(channels: list[DataFrame], key: str, k: int) -> DataFrame:
    """key, rrf_score and matched_by of the best k keys by the sum of 1 / (60 + rank)."""
    rows = reduce(DataFrame.unionByName, channels)
    out = rows.groupBy(key).agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 6).alias("rrf_score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("matched_by"))
    return top(out, k, F.desc("rrf_score"), F.col(key))
