"""A stored inverted index: built by segments, merged, read by pruned buckets, ranked by cover density or BM25.

A folder holds
  postings/segment=S/bucket=B   term, key, field, tf, positions (from 1, ascending), sorted by term in each file
  docs/segment=S                key, fields (lengths by field), content_hash, gone
  state-FORMAT                  a pointer to the segments that count (replace_table): segment, docs, built_at
Bucket LENGTHS has no terms: a row for each document and field, whose tf is the field's length. An index of another format
counts as not built, and is built anew.
A build compares content hashes, makes postings of the documents that are new or changed, and writes them as one more
segment; documents that went get a row that says so. Of a document that several segments have, the latest counts. The state
is replaced last, so a build that dies leaves folders that nobody reads. `compact` writes one segment of what counts.
A build reads texts twice (for hashes, and for postings) and shuffles neither texts nor postings, unless a key has several
units: each task sorts its own postings into files by bucket.

Terms are dealt into buckets by their first LEAD characters, which is what a query term of any kind knows: one that reaches
words by a prefix has a prefix of at least that length. A query reads its buckets only (partition filters), and within
them the row groups of its terms. A frequent term is spread over tasks and files by document; postings are never gathered.
"""

from __future__ import annotations

import sys
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from versed.functions import text as T
from versed.functions.python import flat
from versed.operators.search import B, BODY, HEADING, K1
from versed.plans.session import bounded
from versed.sources.documents import landed, read_table, replace_table

#: Buckets of terms, and characters that decide on a term's bucket; no stem that matches as a prefix is shorter.
BUCKETS, LEAD = 64, T.PREFIX_FROM
#: The layout of the folder, and the bucket of the fields' lengths.
FORMAT, LENGTHS = 2, -1
#: What a hit adds to a rank by cover density: the weight of an unlabelled word.
WEIGHT = 0.1
#: Names of the statuses that a search of an index may have beside ok.
NOT_BUILT, EMPTY, UNUSABLE = "not_built", "empty", "unusable_query"


def bucket(term: Column) -> Column:
    return F.pmod(F.crc32(F.substring(term, 1, LEAD).cast("binary")), F.lit(BUCKETS)).cast("int")


def postings_of(key: StructField, more: str = "") -> StructType:
    """The columns of postings of units with that key."""
    return StructType([*StructType.fromDDL("term string"), key, *StructType.fromDDL("field string, tf int, positions array<int>"), *(StructType.fromDDL(more) if more else ())])


def word_characters(spark: SparkSession) -> np.ndarray:
    """Of each code point whether an index token may hold it, as the pattern of T.index_tokens says on this cluster."""
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    points = spark.range(sys.maxunicode + 1).where("id not between 55296 and 57343").where(char.rlike(f"^{T.INDEX_TOKEN}$")).toArrow()
    table = np.zeros(sys.maxunicode + 1, bool)
    table[points["id"].to_numpy()] = True
    return table


def tokens(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All tokens of the (lower-cased) texts in turn, and how many each text has."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    joined = b"".join(texts.cast(pa.binary()).to_pylist())
    points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    inside, at = table[points], np.cumsum(width) - width
    begins = inside & ~np.append(False, inside[:-1])
    ends = np.cumsum(sizes)
    firsts = np.searchsorted(at, ends[:-1])  # a token doesn't go on from a text to the next
    firsts = firsts[firsts < len(points)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    kept = np.frombuffer(joined, np.uint8)[np.repeat(inside, width)]
    before = np.append(0, np.cumsum(np.where(inside, width, 0)))
    offsets = np.append(before[starts], before[-1]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept)).cast(pa.string())
    return found, np.bincount(np.searchsorted(ends, at[starts], side="right"), minlength=len(sizes))


def positional(units: DataFrame, key: str, **fields: str) -> DataFrame:
    """term, key, field, tf, positions and bucket of the fields' index tokens, grouped within each document without a shuffle, and the fields' lengths; a batch comes sorted by bucket and term, which a later sort makes use of."""
    bounded(units.sparkSession)
    parts = [units.select(F.col(key).alias("key"), F.lit(name).alias("field"), F.lower(F.coalesce(F.col(column), F.lit(""))).alias("low")) for name, column in fields.items()]
    rows = reduce(DataFrame.unionByName, parts)
    sent = units.sparkSession.sparkContext.broadcast(word_characters(units.sparkSession))  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found, sizes = tokens(batch.column("low"), sent.value)
            coded = found.dictionary_encode()
            heads = pc.utf8_slice_codeunits(coded.dictionary, 0, LEAD).dictionary_encode()
            buckets = np.array([zlib.crc32(h.encode()) % BUCKETS for h in heads.dictionary.to_pylist()], np.uint16)[heads.indices.to_numpy(zero_copy_only=False)]
            by_rank = pc.array_sort_indices(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
            by_rank = by_rank[np.argsort(buckets[by_rank], kind="stable")]
            rank = np.empty(len(by_rank), np.int64)
            rank[by_rank] = np.arange(len(by_rank))
            words = rank[coded.indices.to_numpy(zero_copy_only=False)]
            own = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            order = np.argsort((words & 0xFFFF).astype(np.uint16), kind="stable")  # numpy sorts 16 bits at a time without comparisons; units and places stay in order
            if len(rank) > 1 << 16:
                order = order[np.argsort((words[order] >> 16).astype(np.uint16), kind="stable")]
            by_word, by_own = words[order], own[order]
            starts = np.flatnonzero(np.append(True, (by_word[1:] != by_word[:-1]) | (by_own[1:] != by_own[:-1])))[: len(order)]
            first = order[starts]
            ends = np.append(starts, len(order)).astype(np.int32)
            at, which = pa.array(own[first]), by_rank[words[first]]
            names = ["term", "key", "field", "tf", "positions", "bucket"]
            none = pa.nulls(batch.num_rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, coded.dictionary.type), batch.column("key"), batch.column("field"), pa.array(sizes, pa.int32()), none, pa.array([LENGTHS] * batch.num_rows, pa.int32())], names=names)
            yield pa.RecordBatch.from_arrays([
                coded.dictionary.take(pa.array(which)), batch.column("key").take(at), batch.column("field").take(at), pa.array(np.diff(ends)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32))), pa.array(buckets[which].astype(np.int32)),
            ], names=names)

    return rows.mapInArrow(run, postings_of(rows.schema["key"], "bucket int"))


def state(spark: SparkSession, path: str) -> DataFrame | None:
    """segment, docs and built_at of the segments that count; none if the index isn't built."""
    try:
        return read_table(spark, f"{path}/state-{FORMAT}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def segments(spark: SparkSession, path: str) -> list[int]:
    rows = state(spark, path)
    return sorted(r["segment"] for r in rows.select("segment").collect()) if rows is not None else []


def listed(spark: SparkSession, path: str, which: list[int]) -> DataFrame:
    """key, segment, fields, content_hash and gone of all documents of all segments."""
    return spark.read.option("basePath", f"{path}/docs").parquet(*(f"{path}/docs/segment={s}" for s in which))


def live(spark: SparkSession, path: str) -> DataFrame:
    """key, segment (where its postings are), fields and content_hash of the documents that count; a build's documents are told apart by key."""
    rows = listed(spark, path, segments(spark, path))
    latest = rows.groupBy("key").agg(F.max_by(F.struct("segment", "fields", "content_hash", "gone"), "segment").alias("d")).where("not d.gone")
    return latest.select("key", "d.segment", "d.fields", "d.content_hash")


def fingerprint(units: DataFrame, fields: dict[str, str]) -> Column:
    return F.sha2(F.to_json(F.array(*(F.coalesce(F.col(c), F.lit("")) for c in fields.values()))), 256)


def build(units: DataFrame, key: str, path: str, **fields: str) -> int | None:
    """Bring the index up to date with `units`: the number of the segment that this wrote, or none if nothing had changed.

    `key` tells units apart; of units with the same key the one with the least content hash counts; those without a key
    are left out. `fields` are columns by the names that they have in the index.
    """
    spark = units.sparkSession
    which = segments(spark, path)
    columns = {name: f"text_{name}" for name in fields}
    rows = units.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *(F.col(c).alias(columns[name]) for name, c in fields.items())).withColumn("content_hash", fingerprint(units, columns))
    number = max(which, default=-1) + 1
    folder = f"{path}/docs/segment={number}"
    chosen = rows.groupBy("key").agg(F.min("content_hash").alias("content_hash"), F.count(F.lit(1)).alias("units"))
    if which:
        have = live(spark, path).select(F.col("key").alias("old_key"), F.col("content_hash").alias("old_hash"))
        chosen = chosen.join(have, F.col("key") == F.col("old_key"), "full").where("key is null or old_hash is null or old_hash <> content_hash")
        changed = chosen.select(F.coalesce("key", "old_key").alias("key"), "content_hash", "units", F.col("key").isNull().alias("gone"))
    else:
        changed = chosen.withColumn("gone", F.lit(False))
    changed = landed(changed, f"{path}/changes")
    if which and changed.isEmpty():
        return None
    texts = rows.drop("content_hash")
    if which:
        texts = texts.join(changed.where("not gone").select(F.col("key").alias("of")), F.col("key") == F.col("of"), "left_semi")
    several = changed.where("units > 1").select(F.col("key").alias("of"), F.col("content_hash").alias("own"))
    if not several.isEmpty():
        one = rows.join(several, (F.col("key") == F.col("of")) & (F.col("content_hash") == F.col("own"))).drop("of", "own", "content_hash").dropDuplicates(["key"])
        texts = texts.join(several, F.col("key") == F.col("of"), "left_anti").unionByName(one)
    written(positional(texts, "key", **columns), path, number)
    lengths = rows_of(spark, path, [number], rows.schema["key"]).where(F.col("bucket") == LENGTHS)
    own = lengths.groupBy(F.col("key").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("field", "tf"))).alias("own"))
    size = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.coalesce(F.try_element_at("own", F.lit(name)), F.lit(0)) for name in columns)))
    rows = changed.join(own, F.col("key") == F.col("of"), "left").select("key", F.when(~F.col("gone"), size).alias("fields"), "content_hash", "gone")
    rows.write.mode("overwrite").parquet(folder)
    point(spark, path, [*which, number])
    return number


def point(spark: SparkSession, path: str, which: list[int]) -> None:
    """Make the given segments those that count."""
    counts = listed(spark, path, which).groupBy("segment").agg(F.count_if(~F.col("gone")).alias("docs"))
    old = spark.range(1).select(F.explode(F.array(*map(F.lit, which))).alias("segment"))
    replace_table(old.join(counts, "segment", "left").select("segment", F.coalesce("docs", F.lit(0)).alias("docs"), F.current_timestamp().alias("built_at")), f"{path}/state-{FORMAT}")


def written(rows: DataFrame, path: str, number: int) -> None:
    """Write postings with their bucket as a segment; a task sorts what it has made, and a frequent term lies in the files of many tasks."""
    rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/segment={number}")


def rows_of(spark: SparkSession, path: str, which: list[int], key: StructField | None = None) -> DataFrame:
    """All rows of the given segments, lengths and outdated documents among them, with segment and bucket."""
    schema = postings_of(key or listed(spark, path, which).schema["key"], "segment int, bucket int")
    return spark.read.schema(schema).option("basePath", f"{path}/postings").parquet(*(f"{path}/postings/segment={s}" for s in which))


def outdated(spark: SparkSession, path: str, which: list[int]) -> DataFrame:
    """key and segment of what doesn't count, because a later segment has the document or says that it went."""
    per = listed(spark, path, which).groupBy("key").agg(F.max("segment").alias("last"), F.max_by("gone", "segment").alias("gone"), F.collect_list("segment").alias("all"))
    return per.where("gone or size(all) > 1").select("key", F.explode(F.filter("all", lambda s: F.col("gone") | (s < F.col("last")))).alias("segment"))


def current(spark: SparkSession, path: str) -> DataFrame:
    """term, key, field, tf and positions of the documents that count; a single segment has nothing outdated, and no postings are shuffled then."""
    which = segments(spark, path)
    rows = rows_of(spark, path, which).where(F.col("bucket") >= 0)
    if len(which) > 1:
        old = outdated(spark, path, which).select(F.col("key").alias("of"), F.col("segment").alias("at"))
        rows = rows.join(old, (F.col("key") == F.col("of")) & (F.col("segment") == F.col("at")), "left_anti")
    return rows.select("term", "key", "field", "tf", "positions")


def with_lengths(rows: DataFrame, path: str) -> DataFrame:
    """Those of the rows (key, segment) whose document counts, with its lengths (fields)."""
    docs = live(rows.sparkSession, path).select(F.col("key").alias("of"), F.col("segment").alias("at"), "fields")
    return rows.join(docs, (F.col("key") == F.col("of")) & (F.col("segment") == F.col("at"))).drop("of", "at", "segment")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """term, key, field, tf and positions of the documents that count, with their lengths (fields)."""
    rows = rows_of(spark, path, segments(spark, path)).where(F.col("bucket") >= 0)
    return with_lengths(rows, path).select("term", "key", "field", "tf", "positions", "fields")


def compact(spark: SparkSession, path: str) -> int:
    """Write one segment of all that counts, in fewer files, and let that alone count from then on."""
    which = segments(spark, path)
    number = max(which) + 1
    docs = live(spark, path)
    docs.select("key", "fields", "content_hash", F.lit(False).alias("gone")).write.mode("overwrite").parquet(f"{path}/docs/segment={number}")
    rows = current(spark, path).withColumn("bucket", bucket(F.col("term")))
    rows.repartitionByRange("bucket", "term", "key").sortWithinPartitions("bucket", "term", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/segment={number}")
    point(spark, path, [number])
    return number


def asked(queries: DataFrame, query: str, text: str) -> DataFrame:
    """query, n (its usable terms), token, start and prefix: the terms of each query, numbered from 0; equal terms count once."""
    terms = F.array_distinct(T.query_tokens(F.col(text)))
    rows = queries.select(F.col(query).alias("query"), terms.alias("ts"))
    rows = rows.select("query", F.size("ts").alias("n"), F.posexplode("ts").alias("token", "term"))
    return rows.select("query", "n", "token", T.stem(F.col("term")).alias("start"), (F.length("term") >= T.PREFIX_FROM).alias("prefix"))


def found(queries: DataFrame, query: str, text: str, path: str) -> DataFrame:
    """query, n, token, and term, key, field, tf, positions, fields of the postings that each query term reaches; a term that has several words as prefixes has a row for each."""
    spark = queries.sparkSession
    terms = asked(queries, query, text).withColumn("lead", F.substring("start", 1, LEAD))
    buckets = [r[0] for r in terms.select(bucket(F.col("start"))).distinct().collect()]  # at most BUCKETS
    rows = rows_of(spark, path, segments(spark, path)).where(F.col("bucket").isin(buckets)).drop("bucket").withColumn("head", F.substring("term", 1, LEAD))
    reaches = (F.col("head") == F.col("lead")) & F.when(F.col("prefix"), F.col("term").startswith(F.col("start"))).otherwise(F.col("term") == F.col("start"))
    return with_lengths(rows.join(terms, reaches).drop("head", "lead", "start", "prefix"), path)


def covers(tokens: list[int], places: list[list[int]], every: int) -> float:
    """Sum over the shortest stretches that hold `every` query term (or any one, if 0) of the weight of a hit, less for each other word inside."""
    at: dict[int, int] = {}
    for token, some in zip(tokens, places, strict=True):
        for p in some:
            at[p] = at.get(p, 0) | 1 << token
    if not every:
        return WEIGHT * len(at)
    total, last, begun = 0.0, {}, -1
    for k, p in enumerate(sorted(at)):
        hit = at[p]
        for token in range(every):
            if hit >> token & 1:
                last[token] = (p, k)
        if len(last) == every and (start := min(last.values()))[0] > begun:
            begun = start[0]
            total += WEIGHT / (1 + (p - start[0]) - (k - start[1]))
    return total


def cover_density(hits: DataFrame, every: bool = True, fields: tuple[str, ...] = ("body",)) -> DataFrame:
    """query, key and rank of the documents that hold every term of a query (or any): cover density over 1 + ln of the field's length.

    `hits` comes from found(). Several fields are ranked each and summed.
    """
    per = grouped(hits, fields)
    per = per.where(F.col("met") == F.col("n")) if every else per
    return ranked(per.withColumn("of", F.when(F.lit(every), F.col("n")).otherwise(0)))


def grouped(hits: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """query, key, field, n, size (the field's length), met (terms that hit), and the terms with their places."""
    return hits.where(F.col("field").isin(*fields)).groupBy("query", "key", "field").agg(
        F.any_value("n").alias("n"), F.any_value(F.col("fields")[F.col("field")]).alias("size"), F.count_distinct("token").alias("met"),
        F.collect_list("token").alias("tokens"), F.collect_list("positions").alias("places"),
    )


def ranked(per: DataFrame) -> DataFrame:
    """query, key and rank of grouped() hits; `of` is how many terms a stretch must hold, or 0."""
    rows = flat(per, ["query", "key", "size"], ["tokens", "places", "of"], "cover double", lambda tokens, places, of: [(covers(tokens, places, of),)])
    return rows.groupBy("query", "key").agg(F.sum(F.col("cover") / (1 + F.log("size"))).alias("rank"))


def cover_density_or(queries: DataFrame, query: str, text: str, path: str) -> DataFrame:
    """query, key and rank by all terms; queries that no document answers so are ranked by any term. The hits are found once, and grouped before it is known which."""
    per = landed(grouped(found(queries, query, text, path), ("body",)), f"{path}/changes")
    answered = per.where("met = n").select(F.col("query").alias("q")).distinct().withColumn("strict", F.lit(True))
    rows = per.join(answered, F.col("query").eqNullSafe(F.col("q")), "left").where("strict is null or met = n")
    return ranked(rows.withColumn("of", F.when(F.col("strict"), F.col("n")).otherwise(0)))


def bm25(hits: DataFrame, spark: SparkSession, path: str, weights: dict[str, float] | None = None) -> DataFrame:
    """query, key and score of the documents that hold every term, fields weighted; all from the index."""
    weights = weights or {"heading": HEADING, "body": BODY}
    sizes = F.aggregate(F.map_values("fields"), F.lit(0), lambda a, b: a + b)
    whole = live(spark, path).agg(F.count(F.lit(1)).cast("double").alias("docs"), F.avg(sizes).alias("mean")).first()
    weight = F.coalesce(*(F.when(F.col("field") == name, w) for name, w in weights.items()), F.lit(0.0))
    per = hits.groupBy("query", "n", "token", "key").agg(F.sum(weight * F.col("tf")).alias("tf"), F.any_value(sizes).alias("size"))
    df = per.groupBy(F.col("query").alias("q"), F.col("token").alias("t")).agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(whole["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    one = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / (whole["mean"] or 1.0)))
    rows = per.join(df, F.col("query").eqNullSafe(F.col("q")) & (F.col("token") == F.col("t"))).groupBy("query", "n", "key").agg(F.sum(one).alias("score"), F.count(F.lit(1)).alias("met"))
    return rows.where("met = n").select("query", "key", "score")


def counted(hits: DataFrame) -> DataFrame:
    """query, key and hits (occurrences of all terms) of the documents that hold every term."""
    rows = hits.groupBy("query", "n", "key").agg(F.sum("tf").alias("hits"), F.count_distinct("token").alias("met"))
    return rows.where("met = n").select("query", "key", "hits")


def statuses(queries: DataFrame, query: str, text: str, path: str) -> DataFrame:
    """query and status: whether the index can answer it, so that nothing found and nothing searched aren't the same."""
    rows = state(queries.sparkSession, path)
    docs = None if rows is None else rows.agg(F.sum("docs")).first()[0]
    usable = F.size(T.query_tokens(F.col(text))) > 0
    whole = F.lit(NOT_BUILT if docs is None else EMPTY if docs == 0 else "ok")
    return queries.select(query, F.when(whole != "ok", whole).when(usable, "ok").otherwise(UNUSABLE).alias("status"))
