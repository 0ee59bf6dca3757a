"""Prefix trie of conversations: nodes as preorder intervals.

A node is a distinct sequence of first turns. Its key is the exclusive or of one 128-bit hash for each (place, turn), so
keys are running values along a conversation and a long one is worked out in stretches, like every running value here:
rows are sorted by ranges, each task works its range out by itself, and what goes on from one range into the next is
carried over by one small row for each range.

Nodes are ranked in lexicographic order of their paths. A path is written by its turnings: going down, the child with
most conversations (of equal ones that with the least conv_id) comes last among the children of a node, and going there is
no turning. Any other step halves the conversations at least, so a path has at most log2(conversations) turnings however
long it is. With this order the subtree of a node ends at the bottom of the chain of last children that the node is on, so
one end position is kept for each chain, and a sum over a subtree is the difference of two running sums.

The hash of the ids that end at a node runs over all of them in order, by nature one after another: they are joined in
runs by the tasks of a range sort, and the runs of a node pass through one task as a stream, in bounded memory.

Defined cases: turns are ordered by `turn`, null first, equal ones by a hash of role and text; a null role or text counts
as empty; repeated rows are turns each; rows whose conv_id is null or no whole number belong to no conversation; c % 5
takes the sign of c, as in SQL; other columns are ignored; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versed.llm.common import Scratch, bounded_batches, cut, whole_text
from versed.llm.neardup import mix

#: Conversations of one block share its first conversation's beginning, of SHARED - 1 turns at most.
BLOCK, SHARED = 5, 9
#: Characters of one run of joined ids, about.
RUN = 1 << 20
LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def name(column: str) -> Column:
    return F.col(f"`{column.replace('`', '``')}`")


def laid(rows: DataFrame, order: list[str], keep: list[str], run, made: str) -> DataFrame:
    """`keep` of the rows sorted by `order` over all partitions, as `run` makes them, with `part`, the place of the partition."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for out in run(b for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays([*out.values(), pa.array(np.full(len(next(iter(out.values()))), part))], names=[*out, "part"])

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*keep).mapInArrow(numbered, f"{made}, part long")


def longs(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False)


def heads(ids: np.ndarray, before: int | None) -> np.ndarray:
    """Where another conversation than that of the row before starts."""
    return np.append(before is None or ids[0] != before, ids[1:] != ids[:-1])


def over(rows: DataFrame, columns: list[str], add) -> DataFrame:
    """part, conv and what the conversation with which a range begins has from the ranges before: `add` of the last values of those; conversations that begin there have none.

    The driver sees one row for each range.
    """
    last = rows.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "n", *columns)).alias("last")).orderBy("part").collect()
    out, conv, so_far = [], None, [0] * len(columns)
    for r in last:
        so_far = so_far if conv == r["first"] else [0] * len(columns)
        if any(so_far):
            out.append((r["part"], r["first"], *so_far))
        ends = [r["last"][c] for c in columns]
        so_far = [add(a, b) for a, b in zip(so_far, ends, strict=True)] if conv == r["first"] == r["last"]["conv"] else ends
        conv = r["last"]["conv"]
    return rows.sparkSession.createDataFrame(out, ", ".join(f"{c} long" for c in ("at", "of", *(f"from_{c}" for c in columns))))


def carried(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows with the columns of `carry`, null where there is nothing to carry; one row for each range is broadcast."""
    return rows.join(F.broadcast(carry), (F.col("part") == F.col("at")) & (F.col("conv") == F.col("of")), "left")


def ordered(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, n (1 up in order of the turns), digest of role and text, bytes of the text."""
    bounded_batches(conversations.sparkSession)
    role, text = whole_text("role"), whole_text("text")
    rows = conversations.select(
        name("conv_id").try_cast("long").alias("conv"), "turn", F.octet_length(text).cast("long").alias("bytes"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
    ).where("conv is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, n = None, 0
        for batch in batches:
            ids = longs(batch, "conv")
            at = np.arange(len(ids))
            starts = heads(ids, conv)
            begins = np.maximum.accumulate(np.where(starts, at, -1))
            places = np.where(begins < 0, n + at, at - begins) + 1
            conv, n = ids[-1], places[-1]
            yield {"conv": batch.column("conv"), "n": pa.array(places), "digest": batch.column("digest"), "bytes": batch.column("bytes")}

    rows = scratch.cut(laid(rows, ["conv", "turn", "digest"], ["conv", "digest", "bytes"], run, "conv long, n long, digest binary, bytes long"))
    carry = over(rows.withColumn("count", F.col("n")), ["count"], lambda a, b: a + b)
    return carried(rows, carry).select("conv", (F.col("n") + F.coalesce("from_count", F.lit(0))).alias("n"), "digest", "bytes")


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The turns of conversations that begin with up to SHARED - 1 turns of their block's first one: conv, n, digest, bytes; `convs` has conv and turns, their number."""
    base, shared = F.col("conv") - F.col("conv") % BLOCK, F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    firsts = convs.select(F.col("conv").alias("of"), F.col("turns").alias("there"))
    shift = convs.select("conv", base.alias("of"), shared.alias("h")).join(firsts, "of", "left")
    shift = shift.select(F.col("conv").alias("of"), F.least(F.coalesce("there", F.lit(0)) - F.col("h"), F.lit(0)).alias("shift"))
    own = turns.where(F.col("n") > shared).join(shift, F.col("conv") == F.col("of")).withColumn("n", F.col("n") + F.col("shift"))
    names = ("conv", "n", "digest", "bytes")
    block = F.sequence(F.lit(1 - BLOCK), F.lit(BLOCK - 1))
    taken = turns.where((F.col("conv") % BLOCK == 0) & (F.col("n") < SHARED))
    taken = taken.select(F.col("conv").alias("base"), "n", "digest", "bytes", F.explode(block).alias("by")).withColumn("conv", F.try_add("base", "by"))
    taken = taken.where(F.col("conv").isNotNull() & (base == F.col("base")) & (F.col("n") <= shared)).join(convs.select("conv"), "conv", "left_semi")
    return own.select(*names).unionByName(taken.select(*names))


def keyed(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, n, ka and kb (the key of the first n turns), pa and pb (that of the first n - 1), bytes of turn n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, so_far = None, [np.uint64(0), np.uint64(0)]
        for batch in batches:
            ids, n = longs(batch, "conv"), longs(batch, "n").astype(np.uint64)
            starts = heads(ids, conv)
            begins = np.maximum.accumulate(np.where(starts, np.arange(len(ids)), -1))
            digests = np.frombuffer(b"".join(batch.column("digest").to_pylist()), dtype="<u8").reshape(-1, 2)
            keys, before = [], []
            for k, by in enumerate(LANES):
                one = mix(digests[:, k] + n * by)
                all_ = np.bitwise_xor.accumulate(one)
                key = np.where(begins < 0, all_ ^ so_far[k], all_ ^ np.where(begins > 0, all_[begins - 1], np.uint64(0)))
                so_far[k] = key[-1]
                keys.append(pa.array(key.view(np.int64)))
                before.append(pa.array((key ^ one).view(np.int64)))
            conv = ids[-1]
            yield {"conv": batch.column("conv"), "n": batch.column("n"), "ka": keys[0], "kb": keys[1], "pa": before[0], "pb": before[1], "bytes": batch.column("bytes")}

    made = "conv long, n long, ka long, kb long, pa long, pb long, bytes long"
    rows = scratch.cut(laid(turns, ["conv", "n"], ["conv", "n", "digest", "bytes"], run, made))
    carry = over(rows, ["ka", "kb"], lambda a, b: a ^ b)
    moved = [F.col(c).bitwiseXOR(F.coalesce(f"from_k{c[1]}", F.lit(0).cast("long"))).alias(c) for c in ("ka", "kb", "pa", "pb")]
    return carried(rows, carry).select("conv", "n", *moved, "bytes")


def linked(rows: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """All nodes: ka, kb, conv_id (least member), depth, n_convs, bytes of the last turn, n_children, parent_conv_id, and whether they are `aside`: no root and not the last child."""
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("conv_id is not null")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    names = ("ka", "kb", "pa", "pb", "conv_id", "depth", "n_convs", "bytes")
    nodes = rows.groupBy("ka", "kb").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n").alias("depth"), F.max("bytes").alias("bytes"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    nodes = nodes.select(*names).unionByName(root.select(zero.alias("ka"), zero.alias("kb"), none.alias("pa"), none.alias("pb"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("bytes")))
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("xa"), F.col("pb").alias("xb")).agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("first"))).alias("last"))
    nodes = nodes.join(children, (F.col("ka") == F.col("xa")) & (F.col("kb") == F.col("xb")), "left")
    nodes = scratch.cut(nodes.select(*names, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.bitwise_not("last.first").alias("last_child")))  # written, so that the next join can split a node with many children
    parents = nodes.where("n_children > 0").select(F.col("ka").alias("xa"), F.col("kb").alias("xb"), F.col("conv_id").alias("parent_conv_id"), F.col("last_child").alias("last_there"))
    nodes = nodes.join(parents, (F.col("pa") == F.col("xa")) & (F.col("pb") == F.col("xb")), "left")
    return nodes.select("ka", "kb", "conv_id", "depth", "n_convs", "bytes", "n_children", "parent_conv_id", ((F.col("depth") > 0) & (F.col("conv_id") != F.col("last_there"))).alias("aside"))


def pathed(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes with their path (array of longs) and its chain of last children: `top`, depth and conv_id of where that begins."""
    asides = nodes.where("aside").select(F.col("ka").alias("xa"), F.col("kb").alias("xb"), "depth", F.col("conv_id").alias("first"))
    turnings = rows.join(asides, (F.col("ka") == F.col("xa")) & (F.col("kb") == F.col("xb")))
    turnings = turnings.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "first"))).alias("turnings"))  # at most log2 of the conversations
    there = nodes.join(turnings, F.col("conv_id") == F.col("conv"), "left")
    steps = F.filter(F.coalesce("turnings", F.array().cast("array<struct<depth:bigint,first:bigint>>")), lambda s: s["depth"] <= F.col("depth"))
    there = there.withColumn("steps", steps)
    path = F.concat(F.flatten(F.transform("steps", lambda s: F.array(s["depth"] * 2 - 1, s["first"]))), F.array(F.col("depth") * 2))
    last = F.try_element_at("steps", F.lit(-1))
    top = F.struct(F.coalesce(last["depth"], F.lit(0)).alias("depth"), F.coalesce(last["first"], F.lit(0)).alias("first"))
    return there.drop("conv", "turnings").withColumn("path", path).withColumn("top", top).drop("steps")


def intervals(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes with start and end (their place in preorder and that of the last node below them), n_leaves and saved_tokens of their subtrees."""
    columns = ["ka", "kb", "conv_id", "depth", "n_convs", "n_children", "parent_conv_id", "top_depth", "top_first", "leaf", "saving"]
    nodes = nodes.withColumns({
        "leaf": (F.col("n_children") == 0).cast("long"), "saving": (F.col("n_convs") - 1) * F.col("bytes"), "top_depth": F.col("top.depth"), "top_first": F.col("top.first"),
    })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at = leaves = saved = 0
        for batch in batches:
            a, b = leaves + np.cumsum(longs(batch, "leaf")), saved + np.cumsum(longs(batch, "saving"))
            yield {**{c: batch.column(c) for c in columns}, "at": pa.array(at + np.arange(batch.num_rows)), "leaves": pa.array(a), "saved": pa.array(b)}
            at, leaves, saved = at + batch.num_rows, int(a[-1]), int(b[-1])

    made = ", ".join(f"{c} long" for c in [*columns, "at", "leaves", "saved"])
    rows = scratch.cut(laid(nodes, ["path"], columns, run, made))
    sums, so_far, out = rows.groupBy("part").agg(F.count(F.lit(1)), F.sum("leaf"), F.sum("saving")).orderBy("part").collect(), (0, 0, 0), []
    for r in sums:  # one row for each range
        out.append((r[0], *so_far))
        so_far = tuple(a + b for a, b in zip(so_far, r[1:], strict=True))
    before = rows.sparkSession.createDataFrame(out, "of long, x long, y long, z long")
    rows = rows.join(F.broadcast(before), F.col("part") == F.col("of"))
    rows = rows.select(*columns, (F.col("at") + F.col("x")).alias("start"), (F.col("leaves") + F.col("y")).alias("leaves"), (F.col("saved") + F.col("z")).alias("saved"))
    bottoms = rows.groupBy(F.col("top_depth").alias("xa"), F.col("top_first").alias("xb")).agg(F.max("start").alias("end"), F.max("leaves").alias("all_leaves"), F.max("saved").alias("all_saved"))  # running sums: the largest are those of the bottom
    rows = rows.join(bottoms, (F.col("top_depth") == F.col("xa")) & (F.col("top_first") == F.col("xb")))
    leaves, saved = F.col("all_leaves") - F.col("leaves") + F.col("leaf"), F.col("all_saved") - F.col("saved") + F.col("saving")
    return rows.select("ka", "kb", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", leaves.alias("n_leaves"), saved.alias("saved_tokens"), "start", "end")


def endings(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """xa, xb (a node's key) and ends_sha256, the hash of the ids that end there, in order and joined by commas."""
    lasts = rows.groupBy("conv").agg(F.max(F.struct("n", "ka", "kb")).alias("last")).select("conv", "last.ka", "last.kb")
    zero = F.lit(0).cast("long")
    lasts = lasts.unionByName(convs.select("conv").join(rows.select("conv"), "conv", "left_anti").select("conv", zero.alias("ka"), zero.alias("kb")))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            a, b, conv = (longs(batch, c) for c in ("ka", "kb", "conv"))
            bounds = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)]
            bounds = [k for i, j in zip(bounds[:-1], bounds[1:], strict=True) for k in range(i, j, RUN // 20)] + [len(a)]
            ids = conv.tolist()
            yield {
                "xa": pa.array(a[bounds[:-1]]), "xb": pa.array(b[bounds[:-1]]), "first": pa.array(conv[bounds[:-1]]),
                "ids": pa.array([",".join(map(str, ids[i:j])) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]),
            }

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], type=t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["xa", "xb", "ends_sha256"])

        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("xa", "xb", "ids")), strict=True):
                if (a, b) == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node:
                    done.append((*node, sha.hexdigest()))
                node, sha = (a, b), hashlib.sha256(ids.encode())
            if done:
                yield out(done)
        if node:
            yield out([(*node, sha.hexdigest())])

    runs = laid(lasts, ["ka", "kb", "conv"], ["ka", "kb", "conv"], joined, "xa long, xb long, first long, ids string")
    return runs.repartition("xa", "xb").sortWithinPartitions("xa", "xb", "first").select("xa", "xb", "ids").mapInArrow(hashed, "xa long, xb long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the conversations whose turns are given (conv, n from 1 up, digest, bytes), the root for all of `convs` (conv)."""
    rows = keyed(turns, scratch)
    nodes = scratch.cut(linked(rows, convs, scratch))
    out = intervals(pathed(nodes, rows), scratch)
    out = out.join(endings(rows, convs), (F.col("ka") == F.col("xa")) & (F.col("kb") == F.col("xb")), "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"), "start", "end")


def prefixes(conversations: DataFrame, shared: bool = True) -> DataFrame:
    """The nodes of the trie of all conversations, after their rebuilding if `shared`; saved_tokens counts UTF-8 bytes."""
    with Scratch(conversations.sparkSession) as scratch:
        turns = ordered(conversations, scratch)
        convs = scratch.cut(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("turns")))
        return cut(trie(rebuilt(turns, convs) if shared else turns, convs, scratch))
