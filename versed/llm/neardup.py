"""MinHash near-duplicates by ProbMinHash.

A document is its shingles of five words (lower-cased runs of letters, digits and underscores), weighted by
1 + log(occurrences). For each shingle a Poisson process with its weight as rate deals arrivals to the components of the
signature; a component keeps the shingle that arrives first, so two documents agree in a component with their
probability Jaccard similarity. A shingle's process ends as soon as it is later than all components of its document.

Bands of components make buckets, and candidates are compared on their shingles:
 1. Equal texts (by a hash of 128 bits) are one: a member list carries them, and one of each enters the buckets.
 2. In each bucket all documents are compared with its most central one, that whose other buckets hold most documents:
    in a group of copies, that is the one nearest to the original. Links make components, and a group of n copies needs
    about n comparisons, not n squared.
 3. In buckets that still hold several components, the pairs across components are compared, unless what is known of
    both against the central document rules them out, with certainty (see `across`). Pairs that are ruled out make no rows.
Every pair that shares a bucket is either compared, or ruled out, or in one component already, whatever the bucket's size.
Two documents are linked if the plain or the probability Jaccard similarity of their shingles is SIMILAR or more.
Classes are the connected components, found by alternating large and small stars in tables.

Rows are aggregated before they are shuffled, joins on hot keys are plain equi-joins that adaptive execution splits, no
links reach the driver, and each step is cut by a table in the shared folder.

Defined cases: a null text counts as empty; texts without words are linked only to equal texts; a text of one to four
words is one shingle; whole texts count; texts that share a doc_id are documents of their own, as are those without one;
a class of documents without any id has a negative number made from its least hash; rows that repeat are members of one
class; an empty table gives an empty result; other columns are ignored by classes() and kept by keep_one(), whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from versed.llm.common import Scratch, bounded_batches, cut, number, texts, whole_row, whole_text

WORDS, SIMILAR = 5, 0.8
#: Bands, and components in each.
BANDS, ROWS = 32, 5
COMPONENTS = BANDS * ROWS
#: 64-bit words of the bitmaps of the shingles that only one of a document and its bucket's central one has.
BITMAP = 16

FACTS = ("js", "jp", "size", "weight", "shares", "whole", "more", "less")
WORD = re.compile(r"\w+").findall
BITS = 54  # of a shingle; the rest of a number holds the document's place in its batch


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Numbers(dict):
    """Words and their numbers, and the hashes of words by number."""

    MOST = 300_000

    def __init__(self):
        super().__init__()
        self.hashes = np.empty(1 << 12, dtype=np.uint64)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        if number == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty(number, dtype=np.uint64)])
        self.hashes[number] = xxhash.xxh64_intdigest(word)
        return number


def shingles(some: list[str], numbers: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' distinct shingles in order of text and hash: place of the text, 54-bit hash, occurrences."""
    if len(numbers) > numbers.MOST:
        numbers.__init__()
        numbers.clear()
    flat: list[int] = []
    lengths = []
    for text in some:
        words = WORD(text.lower())
        flat += map(numbers.__getitem__, words)
        short = (WORDS - len(words)) if 0 < len(words) < WORDS else 0
        flat += [numbers[""]] * short  # fills up the only shingle of a short text
        lengths.append(len(words) + short)
    if not flat:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    h = numbers.hashes[np.array(flat, dtype=np.int64)]
    n, own = len(h) - WORDS + 1, np.repeat(np.arange(len(some)), lengths)
    whole = own[:n] == own[WORDS - 1 :]
    s = h[:n].copy()
    for k in range(1, WORDS):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
    key = np.sort((own[:n][whole].astype(np.uint64) << np.uint64(BITS)) | (mix(s[whole]) >> np.uint64(64 - BITS)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(BITS)).astype(np.int64), key & np.uint64((1 << BITS) - 1), count


def signatures(own: np.ndarray, hashes: np.ndarray, weights: np.ndarray, documents: int) -> np.ndarray:
    """By document, the shingle that each component keeps; 0 throughout for one without shingles."""
    first = np.full(documents * COMPONENTS, np.inf)
    kept = np.zeros(documents * COMPONENTS, dtype=np.uint64)
    time, turn = np.zeros(len(hashes)), 0
    while len(hashes):
        turn += 1
        x = mix(hashes + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights
        at = own * COMPONENTS + ((x & np.uint64(2047)) * np.uint64(COMPONENTS) >> np.uint64(11)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        kept[at[won]] = hashes[won]
        late = first.reshape(documents, COMPONENTS).max(axis=1)
        on = time < late[own]
        own, hashes, weights, time = own[on], hashes[on], weights[on], time[on]
    return kept.reshape(documents, COMPONENTS)


def bands(kept: np.ndarray) -> np.ndarray:
    """A number for each band of each signature."""
    parts = kept.reshape(len(kept), BANDS, ROWS)
    x = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(kept), BANDS)).copy()
    for k in range(ROWS):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return x.view(np.int64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[float, float, int, np.ndarray, np.ndarray]:
    """Plain and probability Jaccard similarity of two sorted lists of distinct shingles with occurrences, how many they share, and which only a and only b has."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    plain = len(both) / max(1, len(a) + len(b) - len(both))
    alone = np.delete(a, ia), np.delete(b, ib)
    if len(both) == 0 or (wa.max() == 1 and wb.max() == 1):
        return plain, plain, len(both), *alone
    x, y = 1 + np.log(wa), 1 + np.log(wb)
    xs, ys = x[ia], y[ib]
    only_x, only_y = x.sum() - xs.sum(), y.sum() - ys.sum()
    t = xs / ys
    order = np.argsort(t, kind="stable")
    below_y, upto = np.append(0, np.cumsum(ys[order])), np.append(0, np.cumsum(xs[order]))
    left = np.searchsorted(t[order], t, side="left")
    sums = only_x + (upto[-1] - upto[left]) + t * (only_y + below_y[left])
    return plain, float((xs / sums).sum()), len(both), *alone


def bitmap(some: np.ndarray) -> np.ndarray:
    """A bit for each 32-bit shingle; several may share one."""
    at = (some.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(64 * BITMAP)
    out = np.zeros(BITMAP, dtype=np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64)


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and key, the hash that tells texts apart."""
    rows = docs.select(number(F.col(id_col)).alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))


def sketched(rows: DataFrame) -> DataFrame:
    """doc_id, key and bands of every row of `hashed`."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for batch, some in texts(batches):
            own, hashes, count = shingles(some, numbers)
            found = bands(signatures(own, hashes, 1 + np.log(count), len(some)))
            has = np.bincount(own, minlength=len(some)) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has * BANDS)), type=pa.int32()), pa.array(found[has].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), lists], names=["doc_id", "key", "bands"])

    return rows.mapInArrow(run, "doc_id long, key binary, bands array<long>")


def shingled(rows: DataFrame) -> DataFrame:
    """id, sh (sorted 32-bit shingles) and n (occurrences) of rows with id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for batch, some in texts(batches):
            own, hashes, count = shingles(some, numbers)
            short = (hashes >> np.uint64(BITS - 32)).astype(np.uint32)  # still in order; what falls together is one
            if len(short):
                first = np.flatnonzero(np.append(True, (short[1:] != short[:-1]) | (own[1:] != own[:-1])))
                own, short, count = own[first], short[first], np.add.reduceat(count, first)
            short = short.view(np.int32)
            ends = pa.array(np.append(0, np.cumsum(np.bincount(own, minlength=len(some)))), type=pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (short, count)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], names=["id", "sh", "n"])

    return rows.select("id", "text").mapInArrow(run, "id long, sh array<int>, n array<int>")


def compared(pairs: DataFrame, cand: DataFrame) -> DataFrame:
    """x, y and both similarities of the pairs (x, y); of x: size (distinct shingles), weight (of all its shingles), shares (with y), more (bitmap of the others); of y: whole (distinct shingles), less (bitmap of those that x hasn't)."""
    one = cand.select(F.col("id").alias("x"), F.col("sh").alias("a"), F.col("n").alias("m"))
    two = cand.select(F.col("id").alias("y"), F.col("sh").alias("b"), F.col("n").alias("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {}
            for name in ("a", "m", "b", "o"):
                lists = batch.column(name)
                values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
                columns[name] = [values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
            found = [similarity(a.view(np.uint32), m, b.view(np.uint32), o) for a, m, b, o in zip(*columns.values(), strict=True)]
            js, jp, shares = (np.array([f[k] for f in found], dtype=kind) for k, kind in ((0, float), (1, float), (2, np.int32)))
            more, less = (pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([bitmap(f[k]) for f in found] or [np.empty(0, dtype=np.int64)])), BITMAP).cast(pa.list_(pa.int64())) for k in (3, 4))
            size, whole = (np.array([len(a) for a in columns[c]], dtype=np.int32) for c in "ab")
            weight = np.array([len(m) + np.log(m).sum() for m in columns["m"]], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), *map(pa.array, (js, jp, size, weight, shares, whole)), more, less], names=["x", "y", *FACTS])

    rows = pairs.join(one, "x").join(two, "y").select("x", "y", "a", "m", "b", "o")
    return rows.mapInArrow(run, "x long, y long, js double, jp double, size int, weight double, shares int, whole int, more array<long>, less array<long>")


def linked() -> Column:
    return F.greatest("js", "jp") >= SIMILAR - 1e-9


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id and component (its least id) of every node of the edges (x, y), by alternating large and small stars."""
    edges = scratch.cut(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def related(docs: DataFrame, sketches: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """key, first (the least doc_id, null if none has one) and component of every distinct text."""
    grouped = sketches.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"))
    # the table fixes the numbers, which are in order of the keys however the rows are dealt out
    groups = scratch.cut(grouped.repartitionByRange("key").sortWithinPartitions("key").withColumn("id", F.monotonically_increasing_id()))

    buckets = groups.where(F.size("bands") > 0).select("id", F.explode("bands").alias("bucket"))
    sizes = scratch.cut(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    shared = scratch.cut(buckets.join(sizes, "bucket"))
    central = shared.groupBy("id").agg(F.sum("members").alias("rank"))
    pivots = scratch.cut(shared.join(central, "id").groupBy("bucket").agg(F.max_by("id", "rank").alias("pivot")))
    shared = scratch.cut(shared.join(pivots, "bucket"))
    pairs = scratch.cut(shared.where("id <> pivot").select(F.col("id").alias("x"), F.col("pivot").alias("y")).distinct())

    place = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("no"), F.col("doc_id").isNull().alias("nameless")]
    rows = hashed(docs, id_col, text_col).select("key", *place, "text").groupBy("key", "no", "nameless").agg(F.first("text").alias("text"))
    needed = groups.join(shared.select("id").distinct(), "id", "left_semi").withColumnRenamed("first", "doc_id").select("id", "key", *place)
    cand = scratch.cut(shingled(rows.join(needed, ["key", "no", "nameless"]).select("id", "text")))
    seen = scratch.cut(compared(pairs, cand))  # x against the central document of a bucket

    edges = seen.where(linked()).select("x", "y")
    parts = scratch.cut(components(edges, scratch))
    more = scratch.cut(compared(across(shared, seen, parts, scratch), cand).where(linked()).select("x", "y"))
    parts = components(edges.union(more), scratch)
    return groups.join(parts, "id", "left").select("key", "first", F.coalesce("component", "id").alias("component"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id (the least doc_id of the class) of every row."""
    with Scratch(docs.sparkSession) as scratch:
        sketches = scratch.cut(sketched(hashed(docs, id_col, text_col)))
        texts_ = scratch.cut(related(docs, sketches, id_col, text_col, scratch))
        stand_in = -1 - F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long")
        least = texts_.groupBy("component").agg(F.coalesce(F.min("first"), F.min(stand_in)).alias("class_id"))
        named = scratch.cut(texts_.join(least, "component").select("key", "class_id"))  # a table, so that the join with it can split a hot text
        return cut(sketches.select("doc_id", "key").join(named, "key").select("doc_id", "class_id"))


def across(shared: DataFrame, seen: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of a bucket that are in different components and that the bucket's central document p doesn't rule out.

    What rules out a pair (x, y), with certainty:
     - 1 - similarity is a metric for both similarities, so x and y are too far apart if they differ much in that to p;
     - x and y share at most as many of p's shingles as p has, less those that one of them lacks, and at most as many
       others as their bitmaps agree in, so at most a fraction X of x's weight and Y of y's is shared; both similarities
       are at most 1 / (1/X + 1/Y - 1) (the plain one with equal weights), so X and Y must both be SIMILAR at least, and
       one of them 2 SIMILAR / (1 + SIMILAR). A shingle weighs 1 at least.
    A bucket's largest component is never joined with itself, so what is tried grows with the pairs across components.
    """
    rows = scratch.cut(shared.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component"))
    mixed = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("part", "n").alias("main"), F.count(F.lit(1)).alias("parts"))
    mixed = scratch.cut(mixed.where("parts > 1").select("bucket", "main"))
    def ones(c: Column) -> Column:
        return sum((F.bit_count(F.get(c, F.lit(k))) for k in range(BITMAP)), F.lit(0))

    # beside: elements beyond those that a bitmap tells apart; least_plain and so on: what must be shared, of one side
    known = seen.select(
        F.col("x").alias("id"), F.col("y").alias("pivot"), "js", "jp", "size", "shares", "whole", "more", "less", (F.col("weight") > F.col("size")).alias("repeats"),
        (F.col("size") - F.col("shares") - ones(F.col("more"))).alias("more_beside"), (F.col("whole") - F.col("shares") - ones(F.col("less"))).alias("less_beside"),
        (F.col("size") - (1 - SIMILAR) * F.col("weight")).alias("any"), (F.col("size") - (1 - SIMILAR) / (1 + SIMILAR) * F.col("weight")).alias("either"),
    )
    rows = rows.where("id <> pivot and members > 2").join(mixed, "bucket")  # the central document has been compared with all
    rows = scratch.cut(rows.select("id", "pivot", "bucket", "part", "main").join(known, ["id", "pivot"]).drop("pivot"))

    def one(side: str, some: DataFrame) -> DataFrame:
        return some.select(*(F.col(c).alias(f"{side}_{c}") for c in some.columns))

    def x(c: str) -> Column:
        return F.col(f"x_{c}")

    def y(c: str) -> Column:
        return F.col(f"y_{c}")

    def near(c: str) -> Column:
        return F.abs(x(c) - y(c)) <= 1 - SIMILAR + 1e-9

    def common(c: str) -> Column:
        """Elements that two sets share at most, by their bitmaps."""
        agreed = sum((F.bit_count(F.get(x(c), F.lit(k)).bitwiseAND(F.get(y(c), F.lit(k)))) for k in range(BITMAP)), F.lit(0))
        return agreed + F.least(x(f"{c}_beside"), y(f"{c}_beside"))

    inside = F.least(x("shares"), y("shares"), x("shares") + y("shares") - x("whole") + common("less"))
    most = inside + common("more")
    weighted = (x("repeats") | y("repeats")) & near("jp")
    plain = F.when(near("js"), (x("size") + y("size")) * (SIMILAR / (1 + SIMILAR)))
    needed = F.least(plain, F.when(weighted, F.greatest(x("any"), y("any"), F.least(x("either"), y("either")))))  # null: neither can be
    reached = (near("js") | weighted) & (most >= needed - 1e-6)
    apart = (x("bucket") == y("bucket")) & (x("part") != y("part"))
    minor = rows.where("part <> main")
    both = one("x", minor).join(one("y", minor), apart & (x("id") > y("id")) & reached)
    mixed_ = one("x", minor).join(one("y", rows.where("part = main")), apart & reached)
    return both.union(mixed_).select(F.greatest(x("id"), y("id")).alias("x"), F.least(x("id"), y("id")).alias("y")).distinct()


def least_row(docs: DataFrame) -> Column:
    """The least of equal documents' rows by their columns; by a hash of them where a column is a map, which has no order."""
    def ordered(kind) -> bool:
        return not isinstance(kind, MapType) and all(map(ordered, [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []))

    return F.min("row") if ordered(docs.schema) else F.min_by("row", F.sha2(F.to_json("row"), 256))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs`, all columns, of each class: that of the least doc_id; of several texts with that id (or, in a class without ids, of all) that of the least hash; of rows that repeat both the least by its columns."""
    with Scratch(docs.sparkSession) as scratch:
        sketches = scratch.cut(sketched(hashed(docs, id_col, text_col)))
        texts_ = related(docs, sketches, id_col, text_col, scratch)
        place = F.struct(F.col("first").isNull().alias("nameless"), F.coalesce("first", F.lit(0)).alias("no"), "key")
        first = scratch.cut(texts_.groupBy("component").agg(F.min(place).alias("at")).select("at.key", "at.no", "at.nameless"))
        keys = [F.unhex(F.md5(whole_text(text_col).cast("binary"))).alias("key"), F.coalesce(number(F.col(id_col)), F.lit(0)).alias("no"), number(F.col(id_col)).isNull().alias("nameless")]
        rows = docs.select(*keys, whole_row(docs)).groupBy("key", "no", "nameless").agg(least_row(docs).alias("row"))
        return cut(rows.join(first, ["key", "no", "nameless"], "left_semi").select("row.*"))
