"""Vector code compression: product quantisation in whole numbers with exact ties.

Each component x counts as floor(256 * x). A vector is cut into PARTS equal consecutive parts, and each part position has
a codebook of at most ENTRIES entries. Every round broadcasts a kd-tree for each codebook, assigns all parts to their
nearest entries (squared Euclidean distance, ties to the lower index), sums the parts of each entry in whole numbers over
all tasks and replaces the entry by the floor of its mean; entries that nothing was assigned to stay.

The nearest search goes down to each point's own leaf first; then it walks the tree with the points for which a node's box
is as near as the best so far, or nearer: boxes at equal bound are visited, so that a lower index in them wins. Distances
are exact 64-bit integers. A task sends one row for each entry's component, whatever it read, so hot vectors or labels
weigh nothing; the driver sees the codebooks, whose size is entries x dimensions.

Defined cases: rows whose vector is null or holds null or non-finite components are left out; so are those of another
length than the most frequent one among the rest (of equally frequent ones the shorter), and empty vectors; a length that
PARTS doesn't divide is filled up with zeros; components count as at most the largest whose error fits a long (over a
million for usual lengths). Codebooks start from the rows of the least ids, those without an id last and rows of one id in
order of their vectors; fewer rows give fewer entries; repeated rows count and are coded each; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from versed.llm.common import bounded_batches, cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a leaf of the kd-trees.
LEAF = 8


@dataclass
class Tree:
    """A kd-tree over one codebook. Nodes are in preorder: `low` and `high` are their boxes, `after` the node that follows the subtree, `axis` and `at` the split (-1: a leaf), `members` the entries of a leaf in order."""

    entries: np.ndarray
    low: np.ndarray
    high: np.ndarray
    after: list[int]
    axis: np.ndarray
    at: np.ndarray
    right: np.ndarray
    members: list[np.ndarray | None]


def grow(entries: np.ndarray) -> Tree:
    """The tree over the rows of `entries`, cut at the median of the widest side."""
    low, high, after, axis, at, right, members = [], [], [], [], [], [], []

    def node(own: np.ndarray) -> None:
        k = len(low)
        box = entries[own]
        low.append(box.min(axis=0))
        high.append(box.max(axis=0))
        wide = int(np.argmax(high[k] - low[k]))
        for column, value in ((after, 0), (axis, -1), (at, 0), (right, 0), (members, None)):
            column.append(value)
        middle = np.sort(box[:, wide])[(len(own) - 1) // 2]
        goes = box[:, wide] <= middle
        if len(own) <= LEAF or goes.all():
            members[k] = np.sort(own)
        else:
            axis[k], at[k] = wide, middle
            node(own[goes])
            right[k] = len(low)
            node(own[~goes])
        after[k] = len(low)

    node(np.arange(len(entries)))
    return Tree(entries, np.array(low), np.array(high), after, np.array(axis), np.array(at), np.array(right), members)


def nearest(tree: Tree, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each point (int64), ties to the lower index."""
    best, index = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(tree.entries))

    def leaf(k: int, own: np.ndarray) -> None:
        for entry in tree.members[k]:
            gap = points[own] - tree.entries[entry]
            d = np.einsum("ij,ij->i", gap, gap)
            better = (d < best[own]) | ((d == best[own]) & (entry < index[own]))
            best[own[better]], index[own[better]] = d[better], entry

    home = np.zeros(len(points), dtype=np.int64)
    while len(inner := np.flatnonzero(tree.axis[home] >= 0)):
        k = home[inner]
        home[inner] = np.where(points[inner, tree.axis[k]] <= tree.at[k], k + 1, tree.right[k])
    for k, some in enumerate(tree.members):
        if some is not None and len(own := np.flatnonzero(home == k)):
            leaf(k, own)

    def walk(k: int, own: np.ndarray) -> None:
        gap = np.maximum(np.maximum(tree.low[k] - points[own], points[own] - tree.high[k]), 0)
        own = own[np.einsum("ij,ij->i", gap, gap) <= best[own]]
        if tree.members[k] is None:
            if len(own):
                walk(k + 1, own)
                walk(int(tree.right[k]), own)
        elif len(own := own[home[own] != k]):
            leaf(k, own)

    walk(0, np.arange(len(points)))
    return index, best


@dataclass
class Books:
    """The codebooks: entries (parts, entries, components of a part) and the vectors' length before filling up."""

    entries: np.ndarray
    length: int

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether all components are there and finite, and there is one."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(vectors: pa.Array, length: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have finite components only, and these as integers (rows, parts, components of a part)."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), length)
    good = np.isfinite(x).all(axis=1)
    width = -(-length // parts)
    most = math.isqrt((2**63 - 1) // (4 * length)) - 1
    out = np.zeros((int(good.sum()), parts * width), dtype=np.int64)
    out[:, :length] = np.clip(np.floor(x[good] * SCALE), -most, most)
    return good, out.reshape(-1, parts, width)


def rows_of(vectors: DataFrame, length: int, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), *more).where(F.col("vector").isNotNull() & (F.size("vector") == length))


def update(rows: DataFrame, books: Books) -> Books:
    """One round: assign all parts, and replace each used entry by the floor of its parts' mean."""
    parts, entries, width = books.entries.shape
    trees = rows.sparkSession.sparkContext.broadcast([grow(x) for x in books.entries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            _, points = whole(batch.column("vector"), books.length, parts)
            for k, tree in enumerate(trees.value):
                index, _ = nearest(tree, points[:, k])
                order = np.argsort(index, kind="stable")
                found, first = np.unique(index[order], return_index=True)
                if len(found):
                    sums[k, found, :width] += np.add.reduceat(points[order, k], first, axis=0)
                    sums[k, :, width] += np.bincount(index, minlength=entries)
        flat = sums.ravel()
        cells = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(flat[cells])], names=["cell", "total"])

    found = rows.select("vector").mapInArrow(run, "cell long, total long").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    sums = np.zeros(books.entries.size // width * (width + 1), dtype=np.int64)
    for r in found:
        sums[r["cell"]] = r["total"]
    sums = sums.reshape(parts, entries, width + 1)
    count = sums[:, :, width:]
    trees.unpersist()
    return Books(np.where(count > 0, sums[:, :, :width] // np.maximum(count, 1), books.entries), books.length)


def learn(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books | None:
    """Codebooks of all usable vectors; none if there is no such vector."""
    bounded_batches(vectors.sparkSession)
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    first = kept.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").first()
    if first is None:
        return None
    length = first["length"]
    seeds = kept.where(F.size("vector") == length).orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").toArrow()
    _, points = whole(seeds["vector"].combine_chunks(), length, parts)
    books = Books(points.transpose(1, 0, 2).copy(), length)
    rows = rows_of(vectors, length, id_col, vector_col)
    for _ in range(rounds):
        books = update(rows, books)
    return books


def encode(vectors: DataFrame, books: Books | None, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """`id_col`, the columns of `keep` (in a struct `kept`), codes (array<int>, the index of each part) and error (squared distance over all parts) of every usable row."""
    bounded_batches(vectors.sparkSession)
    kept = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in keep), F.lit(0).alias("__none")).alias("kept")
    rows = rows_of(vectors, books.length if books else 0, id_col, vector_col, kept)
    schema = StructType.fromDDL("codes array<int>, error long").add(rows.schema["id"]).add(rows.schema["kept"])
    if books is None:
        return rows.where("false").select(F.col("id").alias(id_col), "kept", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
    parts = books.entries.shape[0]
    sent = vectors.sparkSession.sparkContext.broadcast([grow(x) for x in books.entries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, points = whole(batch.column("vector"), books.length, parts)
            found = [nearest(tree, points[:, k]) for k, tree in enumerate(sent.value)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts), pa.array(codes.ravel()))
            some = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([lists, pa.array(sum(d for _, d in found)), some.column("id"), some.column("kept")], names=["codes", "error", "id", "kept"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(coded: DataFrame, books: Books, codes_col: str = "codes") -> DataFrame:
    """The columns of `coded` with `approximation`, the entries that the codes name, as array<double>."""
    table = F.from_json(F.lit(json.dumps((books.entries / SCALE).tolist())), "array<array<array<double>>>")
    picked = F.flatten(F.transform(F.col(codes_col), lambda c, k: F.get(F.get(table, k), c)))
    return coded.withColumn("approximation", F.slice(picked, 1, books.length))


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """`id_col`, code (two hex digits for each part), error, label_error (the errors of the rows of equal labels in all) and codebooks_sha256 of every usable row."""
    books = learn(vectors, id_col, vector_col)
    coded = encode(vectors, books, id_col, vector_col, (label_col,))
    digits = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    coded = cut(coded.select(F.col(id_col).alias("id"), F.col("kept").getField(label_col).alias("label"), F.array_join(digits, "").alias("code"), "error"))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))
