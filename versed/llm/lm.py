"""LM scoring by cross-entropy difference.

A target model (of chosen documents) and a background model (of all documents) are bigram models over one shared
vocabulary: all tokens of the corpus, with one class for numbers. The models are matched: same order, same smoothing, and
background counts scaled to the target's size, so that smoothing weighs alike. A document's score is its mean loss per
token under the target less that under the background: the lower, the more it resembles the target.

Every bigram, context and token of the corpus counts, however rare, so what is gathered grows with the input:
 1. `held` turns each task's documents into chunks of about CHUNK tokens: numbers of tokens and the hashes of the words.
 2. `sent` gives the counts of each chunk's distinct bigrams, contexts and tokens by hash, in ranges of the hash. Hashes
    have SPARE bits more than the number of tokens, 64 at most: one in 2 ** SPARE / 3 keys shares its counts with another.
 3. `answered` sums the counts of a range over all chunks and answers each chunk in the order in which it asked; of the
    background, with what the other chunks have, which is nothing for most rare keys.
 4. `scored` has, for each chunk, the counts of all that occurs in it, and works out its documents' losses.
A chunk sends a key once, so a frequent bigram has at most as many rows as there are chunks. The driver sees the number of
tokens, of the target's tokens and of distinct tokens, and nothing is broadcast.

Defined cases: a null text counts as empty; an empty text has no tokens and zeros for losses and score; whole texts count;
target documents that no row has are left out; without target documents the target model is uniform; repeated rows
count and are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versed.llm.common import bounded_batches, cut, named, number, texts, whole_text
from versed.llm.neardup import mix

#: Weights (in tokens) of the unigram model behind a bigram and of uniform behind that.
BEHIND, UNIFORM = 20.0, 0.5
#: What stands before a document's first token, its number, and the class of numbers.
BEGIN, START, NUMBER = "<start>", 0, "<number>"
#: Tokens from which a chunk is full, and keys of one range of hashes, about.
CHUNK, RANGE = 1 << 20, 1 << 19
SPARE = 22

TOKEN = re.compile(r"\w+|[^\w\s]").findall


def tokens(text: str) -> list[str]:
    return TOKEN(text.lower())


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, those of like weight side by side, which compresses well."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplaned(some: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(some, dtype=np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def packed(x: np.ndarray) -> bytes:
    return len(x).to_bytes(4, "little") + pa.compress(planes(x), codec="zstd", asbytes=True)


def unpacked(some: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(some[:4], "little") * np.dtype(kind).itemsize
    return unplaned(pa.decompress(some[4:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", kind)


class Numbers(dict):
    """Numbers of a chunk's tokens; `words` has the distinct tokens by number, and tokens that are numbers are one."""

    def __init__(self):
        super().__init__()
        self.words = [BEGIN]

    def __missing__(self, token: str) -> int:
        if token.isdecimal():
            number = self[NUMBER]
        else:
            number = len(self.words)
            self.words.append(token)
        self[token] = number
        return number


def held(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk, ids, lengths (tokens by document), words (hashes of the distinct tokens by number) and flat (numbers of all tokens, START before each document)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, flat, lengths, numbers = [], [], [], Numbers()

        def chunk() -> pa.RecordBatch:
            some = pa.concat_arrays(ids)
            ends = pa.array([0, len(some)], type=pa.int32())
            words = np.fromiter(map(xxhash.xxh64_intdigest, numbers.words), dtype=np.uint64, count=len(numbers.words))
            return pa.RecordBatch.from_arrays([
                pa.array([number], type=pa.int64()), pa.ListArray.from_arrays(ends, some), pa.ListArray.from_arrays(ends, pa.array(lengths, type=pa.int64())),
                pa.array([words.tobytes()]), pa.array([packed(np.concatenate(flat))]),
            ], names=["chunk", "ids", "lengths", "words", "flat"])

        for batch, some in texts(batches):
            ids.append(batch.column("id"))
            for text in some:
                found = [START, *map(numbers.__getitem__, tokens(text))]
                flat.append(np.array(found, dtype=np.int32))
                lengths.append(len(found) - 1)
            if sum(lengths) >= CHUNK:
                yield chunk()
                number += 1
                ids, flat, lengths, numbers = [], [], [], Numbers()
        if ids:
            yield chunk()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"chunk long, ids array<{kind}>, lengths array<long>, words binary, flat binary")


class Chunk:
    """Distinct bigrams, contexts and tokens of a chunk, with their hashes in order."""

    def __init__(self, lengths: list[int], words: bytes, flat: bytes, bits: int):
        self.lengths, words = np.array(lengths, dtype=np.int64), np.frombuffer(words, dtype=np.uint64)
        numbers = unpacked(flat, np.int32).astype(np.int64)
        inside = np.ones(max(len(numbers) - 1, 0), dtype=bool)
        inside[np.cumsum(self.lengths[:-1] + 1) - 1] = False  # where one text ends and the next starts
        pairs = (numbers[:-1] * len(words) + numbers[1:])[inside]
        distinct, self.at = np.unique(pairs, return_inverse=True)
        self.first, self.second = distinct // len(words), distinct % len(words)
        self.contexts, self.context_at = np.unique(self.first, return_inverse=True)
        self.tokens, self.token_at = np.unique(self.second, return_inverse=True)
        one, two = mix(words + np.uint64(0x9E3779B97F4A7C15)), mix(words + np.uint64(0x3C6EF372FE94F82A))
        odd = np.uint64(1)  # the lowest bit tells tokens from the others
        hashes = [mix(one[self.first] * np.uint64(0x9E3779B97F4A7C15) + two[self.second]), one[self.contexts], two[self.tokens]]
        hashes = [x >> np.uint64(64 - bits) | odd for x in hashes]
        hashes = np.concatenate([hashes[0] ^ odd, hashes[1] ^ odd, hashes[2]])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers in order of the hashes, as those of bigrams, contexts and tokens."""
        back = np.empty(len(x), dtype=x.dtype)
        back[self.order] = x
        a, b = len(self.first), len(self.first) + len(self.contexts)
        return back[:a], back[a:b], back[b:]

    def counted(self, weights: np.ndarray | None = None) -> np.ndarray:
        """Counts in order of the hashes; `weights` by document, else 1."""
        n = np.bincount(self.at, None if weights is None else np.repeat(weights, self.lengths), minlength=len(self.first))
        sums = [np.bincount(at, n, minlength=len(of)) for at, of in ((self.context_at, self.contexts), (self.token_at, self.tokens))]
        return np.concatenate([n, *sums]).astype(np.int64)[self.order]


def flagged(chunks: DataFrame, target: DataFrame) -> DataFrame:
    """chunk, mine (places of its documents whose id is in `target`) and n (their tokens), of the chunks that have any."""
    chosen = target.select(number(named(target.columns[0])).alias("id")).where("id is not null").distinct().hint("merge")  # one plan at every size: the target grows with the corpus
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "lengths")).alias("place", "of"))
    rows = rows.select("chunk", "place", number(F.col("of.ids")).alias("id"), F.col("of.lengths").alias("n"))
    return rows.join(chosen, "id", "left_semi").groupBy("chunk").agg(F.collect_list("place").alias("mine"), F.sum("n").alias("n"))


def sent(chunks: DataFrame, mine: DataFrame, ranges: int, bits: int) -> DataFrame:
    """range, chunk and the hashes with counts n (of all documents) and m (of the target's) in that range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["lengths"], row["words"], row["flat"], bits)
                weights = np.zeros(len(chunk.lengths))  # null: none of its documents is in the target
                weights[row["mine"] or []] = 1
                n, m = chunk.counted(), chunk.counted(weights)
                of = ((chunk.hashes << np.uint64(64 - bits) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, dtype=np.int64)
                spans = list(zip(starts, np.append(starts, len(of))[1:], strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(of[starts]), pa.array([row["chunk"]] * len(spans), type=pa.int64()),
                    pa.array([packed(np.diff(chunk.hashes[i:j], prepend=np.uint64(0))) for i, j in spans], type=pa.binary()),
                    *(pa.array([packed(x[i:j]) for i, j in spans], type=pa.binary()) for x in (n, m)),
                ], names=["range", "chunk", "hashes", "n", "m"])

    rows = chunks.select("chunk", "lengths", "words", "flat").join(mine.select("chunk", "mine").hint("merge"), "chunk", "left")
    return rows.mapInArrow(run, "range long, chunk long, hashes binary, n binary, m binary")


def answered(keys: DataFrame) -> DataFrame:
    """chunk, range, n (sums over all other chunks, in the order of the chunk's hashes), m (sums over all) and types (distinct tokens, in one row of each range)."""

    def run(rows: pa.Table) -> pa.Table:
        some = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in rows["hashes"].to_pylist()]
        distinct, at = np.unique(np.concatenate(some), return_inverse=True)
        ends = np.cumsum([len(x) for x in some])
        own = [np.concatenate([unpacked(x, np.int64) for x in rows[c].to_pylist()]) for c in ("n", "m")]
        n, m = (np.bincount(at, x).astype(np.int64)[at] for x in own)
        types = np.zeros(len(some), dtype=np.int64)
        types[0] = (distinct & np.uint64(1)).sum()
        return pa.table({"chunk": rows["chunk"], "range": rows["range"], **{c: pa.array([packed(y) for y in np.split(x, ends[:-1])], type=pa.binary()) for c, x in (("n", n - own[0]), ("m", m))}, "types": types})

    return keys.groupBy("range").applyInArrow(run, "chunk long, range long, n binary, m binary, types long")


def scored(chunks: DataFrame, answers: DataFrame, total: int, mine: int, types: int, bits: int, id_col: str = "doc_id") -> DataFrame:
    """`id_col`, n_tokens, target_loss and background_loss (means per token, nats) and score, their difference, of every row."""
    scale = mine / total if mine and total else 1.0

    def loss(pairs: np.ndarray, contexts: np.ndarray, ones: np.ndarray, whole: float) -> np.ndarray:
        return -np.log((pairs + BEHIND * (ones + UNIFORM) / (whole + UNIFORM * types)) / (contexts + BEHIND))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("range")
        out = []
        for row in left.select(["lengths", "words", "flat"]).to_pylist():
            chunk = Chunk(*row.values(), bits)
            own, means = np.repeat(np.arange(len(chunk.lengths)), chunk.lengths), []
            for c, by, whole in (("m", 1.0, mine), ("n", scale, total * scale)):
                found = np.concatenate([unpacked(x, np.int64) for x in right[c].to_pylist()] or [np.empty(0, dtype=np.int64)])
                if c == "n":
                    found += chunk.counted()
                pairs, contexts, ones = (x * by for x in chunk.parts(found))
                table = loss(pairs, contexts[chunk.context_at], ones[chunk.token_at], whole)
                means.append(np.bincount(own, table[chunk.at], minlength=len(chunk.lengths)) / np.maximum(chunk.lengths, 1))
            out.append((chunk.lengths, *means, means[0] - means[1]))
        return pa.table({id_col: pc.list_flatten(left["ids"]), **{name: np.concatenate(x) for name, x in zip(("n_tokens", "target_loss", "background_loss", "score"), zip(*out, strict=True), strict=True)}})

    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, f"{id_col} {kind}, n_tokens long, target_loss double, background_loss double, score double")


def difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The scores of every row of `docs` against the documents whose id is in `target`, over all tokens of the corpus."""
    chunks = cut(held(docs, id_col, text_col))
    mine = cut(flagged(chunks, target))
    total = chunks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    bits = min(64, SPARE + int(total).bit_length())
    answers = cut(answered(sent(chunks, mine, max(1, total // RANGE), bits)))
    sums = [df.agg(F.sum(c)).first()[0] or 0 for df, c in ((mine, "n"), (answers, "types"))]
    return scored(chunks, answers, total, *sums, bits, id_col)
