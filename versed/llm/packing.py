"""Hierarchical packing of documents into context windows of several sizes.

Every document is its ids and one closing id. Windows of TIERS sizes are filled:
 1. Routing: a document gives whole windows of the largest size while it can; what is left of it goes to the smallest tier
    that holds it.
 2. Packing, from the largest tier down: the longest rest of a tier opens a window of its size.
 3. Filling: the gap takes the longest rest that fits whole, again and again; these are of shorter tiers, since a rest fills
    more than half of its own window. When none fits, the least that is too long is cut at the gap, and what remains of it
    goes back to its tier. So a window is always full, and few documents are cut.
 4. What is too little for a window waits for the task's next documents; at the task's end it becomes windows of smaller
    powers of two, which need no padding either.
 5. Step groups: the windows of each size are dealt evenly over steps of about STEP ids, so that steps are of equal length
    (but for one window of each size) and of equal mixture.
A task packs the documents that it reads, at most BLOCK ids at once, and passes only the list of pieces on: nothing is
shuffled but counts of windows by task and size. The pieces are written before windows are numbered, so a task that runs
again with its rows in another order harms nothing.

Ids are those of the tokenizers library for a byte-level BPE vocabulary. A text without special tokens is encoded by the
same vocabulary's rank file with tiktoken, which is four times as fast and gives equal ids (tested over all code points);
one that holds a special token's string goes through tokenizers itself.

Defined cases: a null text counts as empty, which leaves the closing id; repeated rows are documents each; documents
without an id are packed too; a document of any length is cut as it must; an empty table gives no pieces; other columns
are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from versed.llm.common import bounded_batches, cut, whole_text

#: Window sizes, powers of two, the largest first; ids of a step; ids that a task holds before it packs; texts encoded at once.
TIERS, STEP, BLOCK, AT_ONCE = (1024, 512, 256, 128, 64), 1 << 18, 1 << 22, 64
END = 0
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, size long, number long, offset long"

#: Encoders of this Python worker, by vocabulary; workers serve many tasks.
KNOWN: dict[tuple[int, int], Callable[[str], np.ndarray]] = {}


def encoder(vocabulary: bytes, ranks: bytes, pattern: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids and END; `vocabulary` is a tokenizer file (JSON), `ranks` the same vocabulary as ranks."""
    name = (hash(vocabulary), hash(ranks))
    if name not in KNOWN:
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_str(vocabulary.decode())
        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
        special = [t.content for t in exact.get_added_tokens_decoder().values()]

        def encode(text: str) -> np.ndarray:
            ids = exact.encode(text, add_special_tokens=False).ids if any(s in text for s in special) else fast.encode_ordinary(text)
            ids.append(END)
            return np.array(ids, dtype="<u4")

        KNOWN.clear()
        KNOWN[name] = encode
    return KNOWN[name]


class Packer:
    """Packs documents of one task; `pieces` are those of full windows so far: document, start, length, size and number of the window, offset."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.most = tiers, tiers[0]
        self.rests: dict[int, list[tuple[int, int]]] = {}  # by length: document and start
        self.lengths = 0  # a bit for each length that there is
        self.waiting = 0
        self.numbers: dict[int, int] = {}
        self.pieces: list[tuple[int, int, int, int, int, int]] = []

    def put(self, doc: int, start: int, length: int) -> None:
        self.rests.setdefault(length, []).append((doc, start))
        self.lengths |= 1 << length
        self.waiting += length

    def take(self, length: int) -> tuple[int, int]:
        some = self.rests[length]
        found = some.pop()
        if not some:
            self.lengths ^= 1 << length
        self.waiting -= length
        return found

    def add(self, doc: int, length: int) -> None:
        """Whole windows of the largest size, and the rest to its tier."""
        for start in range(0, length - length % self.most, self.most):
            self.close(self.most, [(doc, start, self.most)])
        if rest := length % self.most:
            self.put(doc, length - rest, rest)

    def close(self, size: int, inside: list[tuple[int, int, int]]) -> None:
        number, offset = self.numbers.get(size, 0), 0
        self.numbers[size] = number + 1
        for doc, start, length in inside:
            self.pieces.append((doc, start, length, size, number, offset))
            offset += length

    def fill(self, size: int) -> None:
        """One full window; there must be that many ids."""
        gap, inside = size, []
        while gap:
            if fits := self.lengths & ((2 << gap) - 1):
                length = fits.bit_length() - 1
                doc, start = self.take(length)
            else:
                over = self.lengths >> gap
                whole = gap + (over & -over).bit_length() - 1
                doc, start = self.take(whole)
                length = gap
                self.put(doc, start + gap, whole - gap)
            inside.append((doc, start, length))
            gap -= length
        self.close(size, inside)

    def pack(self, last: bool = False) -> None:
        """Windows of each tier while it has rests and all waiting ids fill them; all that waits if it is the `last` time."""
        for size, below in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while self.waiting >= size and self.lengths >> (below + 1):
                self.fill(size)
        while last and self.waiting:
            self.fill(1 << (self.waiting.bit_length() - 1))


def pieces(docs: DataFrame, encode: Callable[[], Callable[[str], np.ndarray]], id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, with_ids: bool = False) -> DataFrame:
    """The pieces of all windows, by task: id, start, length, ids_crc32, doc_tokens, size and number of the window, offset in it, part (the task), and the piece's ids (binary, little-endian 32-bit) if asked for."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    schema = StructType().add(rows.schema["id"])
    for field in StructType.fromDDL(f"{PIECES}, part long" + ", ids binary" * with_ids):
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, packer, part = encode(), Packer(tiers), TaskContext.get().partitionId()
        held: dict[int, tuple[pa.Scalar, np.ndarray]] = {}
        count = tokens = 0

        def passed() -> Iterator[pa.RecordBatch]:
            done, packer.pieces = packer.pieces, []
            for k in range(0, len(done), 1 << 14):
                some = done[k : k + (1 << 14)]
                parts = [held[doc][1][start : start + length].tobytes() for doc, start, length, *_ in some]
                _, start, length, size, number, offset = (pa.array(x, type=pa.int64()) for x in zip(*some, strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array([held[doc][0].as_py() for doc, *_ in some], type=kind), start, length, pa.array([zlib.crc32(x) for x in parts], type=pa.int64()),
                    pa.array([len(held[doc][1]) for doc, *_ in some], type=pa.int64()), size, number, offset, pa.array(np.full(len(some), part, dtype=np.int64)), *([pa.array(parts, type=pa.binary())] * with_ids),
                ], names=schema.names)
            waiting = {doc for some in packer.rests.values() for doc, _ in some}
            for doc in [d for d in held if d not in waiting]:
                del held[doc]

        kind = pa.null()
        for batch in batches:
            kind, names = batch.column("id").type, batch.column("id")
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = of(text)
                held[count] = names[k], ids
                packer.add(count, len(ids))
                count, tokens = count + 1, tokens + len(ids)
                if tokens >= BLOCK:
                    packer.pack()
                    yield from passed()
                    tokens = packer.waiting
        packer.pack(last=True)
        if packer.pieces:
            yield from passed()

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def numbered(packed: DataFrame, step: int = STEP) -> DataFrame:
    """Pieces with sequence_id (0 up over all windows, larger ones first) and step, its step group."""
    ends = packed.groupBy("part", "size").agg((F.max("number") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ends.select(F.col("part").alias("of"), F.col("size").alias("as"), before.alias("before"))  # one row for each task and size
    sizes = {r["size"]: r["n"] for r in ends.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    steps = max(1, -(-sum(k * n for k, n in sizes.items()) // step))
    first, at = {}, 0
    for size in sorted(sizes, reverse=True):
        first[size] = at
        at += sizes[size]
    rows = packed.join(starts, (F.col("part") == F.col("of")) & (F.col("size") == F.col("as"))).withColumn("own", F.col("before") + F.col("number"))

    def by_size(values: dict[int, float]):
        return F.coalesce(*(F.when(F.col("size") == k, F.lit(v)) for k, v in values.items()), F.lit(0).cast("long"))

    spread = F.floor(F.col("own") * by_size({k: steps / n for k, n in sizes.items()}))
    rows = rows.withColumn("sequence_id", (F.col("own") + by_size(first)).cast("long")).withColumn("step", F.least(spread, F.lit(steps - 1)).cast("long"))
    return rows.drop("of", "as", "before", "own", "number", "part")


def pack(docs: DataFrame, vocabulary: bytes, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step: int = STEP, with_ids: bool = False) -> DataFrame:
    """`id_col`, start, length, ids_crc32, doc_tokens, sequence_id, offset, size of the window, step, and ids if asked for, of every piece."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, ranks, pattern))
    return numbered(cut(pieces(docs, lambda: encoder(*sent.value), id_col, text_col, tiers, with_ids)), step)
