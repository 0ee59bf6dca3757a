"""Byte-level BPE encoding and decoding over documents.

Each match of the split pattern is encoded by itself. A segment tree over the byte positions of the piece holds, for
every live position, the rank of the pair that starts there; its root is the leftmost pair of least rank. A merge
updates three leaves (the pair itself, the live neighbour before it, the position that goes), each in logarithmic time,
so a piece of n bytes takes O(n log n) however long it is.

Defined cases: a null text counts as empty and has no ids; whole texts are encoded, of any length; special tokens are
ordinary text; repeated rows give repeated results; an empty table gives an empty result; other input columns are
ignored, so their names can't clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versed.llm.common import bounded_batches, whole_text

#: Pieces (none longer than LONGEST bytes) whose ids a worker keeps; the cache starts anew beyond that, which bounds memory and changes no result.
CACHE = 400_000
#: Longest piece in bytes that shares arrays with others and is kept; longer ones get a tree of their own.
LONGEST = 64
#: Texts whose pieces a worker holds at once.
AT_ONCE = 128
NONE = 1 << 62


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the leftmost pair of least rank until none is left; a piece that is a token itself stays whole."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    get = ranks.get
    after = list(range(1, n + 1))  # start of the next live token
    before = list(range(-1, n))  # start of the live token before
    size = 1 << max(0, n - 2).bit_length()
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        if (rank := get(piece[i : i + 2])) is not None:
            tree[size + i] = rank << 32 | i  # the position breaks ties to the left
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    while (least := tree[1]) != NONE:
        i = least & 0xFFFFFFFF
        gone = after[i]
        end = after[gone]
        after[i] = end
        if end < n:
            before[end] = i
        changed = [(i, NONE)]
        if end < n and (rank := get(piece[i : after[end]])) is not None:
            changed = [(i, rank << 32 | i)]
        if gone < n - 1:
            changed.append((gone, NONE))
        if (back := before[i]) >= 0:
            rank = get(piece[back:end])
            changed.append((back, NONE if rank is None else rank << 32 | back))
        for at, value in changed:
            k = size + at
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Merges:
    """Pair ranks as arrays, and the segment trees of many short pieces side by side: one numpy row for each piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.base = max(ranks.values(), default=0) + 1
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    pairs[a * self.base + b] = rank
        self.keys = np.array(sorted(pairs) or [-1], dtype=np.int64)
        self.values = np.array([pairs.get(k, 0) for k in self.keys.tolist()], dtype=np.int64)
        self.bytes = np.array([ranks[bytes([x])] for x in range(256)], dtype=np.int64)

    def leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank and position of the pairs of ids, or NONE."""
        keys = left * self.base + right
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[found] == keys, self.values[found] << 8 | at, NONE)

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as int32 bytes."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(piece) > LONGEST:
                out[k] = np.array(merge_piece(piece, self.ranks), dtype="<i4").tobytes()
            else:
                classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(k)
        for width, members in classes.items():
            for first in range(0, len(members), 8192):
                some = members[first : first + 8192]
                for k, ids in zip(some, self.side_by_side([pieces[k] for k in some], width), strict=True):
                    out[k] = ids
        return out

    def side_by_side(self, pieces: list[bytes], width: int) -> list[bytes]:
        count, steps = len(pieces), width.bit_length() - 1
        n = np.array([len(x) for x in pieces], dtype=np.int64)
        at = np.arange(width, dtype=np.int64)
        ids = self.bytes[np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), dtype=np.uint8).reshape(count, width)]
        after = np.broadcast_to(np.arange(1, width + 2), (count, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (count, width + 1)).copy()
        live = at < n[:, None]
        tree = np.full((count, 2 * width), NONE, dtype=np.int64)
        tree[:, width:-1] = np.where(live[:, 1:], self.leaf(ids[:, :-1], ids[:, 1:], at[:-1]), NONE)
        low = width
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            least = tree[rows, 1]
            i = least & 255
            gone = after[rows, i]
            end = after[rows, gone]
            merged = least >> 8
            ids[rows, i] = merged
            after[rows, i] = end
            before[rows, end] = i
            live[rows, gone] = False
            back = before[rows, i]
            inner, first = end < n[rows], back < 0
            back = np.where(first, i, back)
            right = np.where(inner, self.leaf(merged, ids[rows, np.minimum(end, width - 1)], i), NONE)
            left = np.where(first, right, self.leaf(ids[rows, back], merged, back))
            leaves = np.concatenate([gone, i, back]) + width
            thrice = np.concatenate([rows, rows, rows])
            tree[thrice, leaves] = np.concatenate([np.full(len(rows), NONE), right, left])
            for _ in range(steps):
                leaves >>= 1
                tree[thrice, leaves] = np.minimum(tree[thrice, 2 * leaves], tree[thrice, 2 * leaves + 1])
            rows = rows[tree[rows, 1] != NONE]
        flat, ends = ids[live].astype("<i4").tobytes(), np.cumsum(live.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


#: The cache of this Python worker, by vocabulary; workers serve many tasks.
KNOWN: dict[tuple[int, str], tuple[Merges, dict[str, bytes]]] = {}


def encoder(data: Broadcast, pattern: str):
    """A function from texts to their ids as int32 bytes, with a cache of pieces."""
    name = (hash(data.value), pattern)
    if name not in KNOWN:
        KNOWN.clear()
        KNOWN[name] = Merges(read_ranks(data.value)), {}
    (merges, cache), split = KNOWN[name], regex.compile(pattern).findall

    def encode(texts: list[str]) -> list[bytes]:
        if len(cache) > CACHE:
            cache.clear()
        pieces = [split(text) for text in texts]
        known = [list(map(cache.get, words)) for words in pieces]
        if new := list({x for words, ids in zip(pieces, known, strict=True) if None in ids for x in compress(words, map(is_, ids, repeat(None)))}):
            data = [x.encode() for x in new]
            made = dict(zip(new, merges.many(data), strict=True))
            known = [[made[x] if i is None else i for x, i in zip(words, ids, strict=True)] if None in ids else ids for words, ids in zip(pieces, known, strict=True)]
            cache.update((x, made[x]) for x, d in zip(new, data, strict=True) if len(d) <= LONGEST)
        return [b"".join(ids) for ids in known]

    return encode


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and ids array<int> of every row; `ranks` is the content of a rank file (its size is that of a vocabulary)."""
    bounded_batches(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(data, pattern)
        for batch in batches:
            some = batch.column("text").to_pylist()
            ids = [x for k in range(0, len(some), AT_ONCE) for x in of(some[k : k + AT_ONCE])]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64)
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), type=pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`id_col`, ids and the decoded bytes of every row; an id that the vocabulary doesn't have decodes to nothing."""
    bounded_batches(encoded.sparkSession)
    data = encoded.sparkSession.sparkContext.broadcast(ranks)
    rows = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = {rank: token for token, rank in read_ranks(data.value).items()}
        tokens = [vocabulary.get(i, b"") for i in range(max(vocabulary, default=-1) + 1)]
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *(len(x) for x in lists)])
            inside = len(flat) == 0 or (flat.min() >= 0 and flat.max() < len(tokens))
            out = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                ids = flat[a:b].tolist()
                out.append(b"".join([tokens[i] for i in ids] if inside else [vocabulary.get(i, b"") for i in ids]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(out, type=pa.binary())], names=["id", "ids", "decoded"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)
