"""Media columns: telephony audio.

A payload is kept as 8-bit mu-law samples in a WAV file (8 kHz, one channel); whatever its bytes are, they come back
unchanged. Reading expands mu-law and A-law by lookup tables, decodes IMA ADPCM blocks of 64 bytes with numpy across all
blocks of a batch at once, and resamples the mu-law signal to 16 kHz linear PCM, which is stored as a column of its own.

Documents are decoded in frames of FRAME bytes, so that working memory is bounded however long a document is; the last
samples go over into the next frame, and results don't depend on where frames end.

Defined cases: a null text counts as empty and is 64 zero bytes; whole texts are stored; media that is null or is no such
file reads as null; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versed.llm.common import bounded_batches, texts, whole_text

BLOCK, FRAME, AT_ONCE = 64, 1 << 16, 1 << 21
RATE, RESAMPLED, MULAW, PCM = 8000, 16000, 7, 1

# Fixed values of IMA ADPCM: step sizes, and moves of the step index by the nibble's three low bits.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)


def expand_mulaw(code: int) -> int:
    code = ~code & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return -size if code & 0x80 else size


def expand_alaw(code: int) -> int:
    code ^= 0x55
    power, size = code >> 4 & 7, (code & 0x0F) << 4
    size = size + 8 if not power else size + 0x108 << power - 1
    return size if code & 0x80 else -size


MULAW_TABLE = np.array([expand_mulaw(x) for x in range(256)], dtype=np.int16)
ALAW_TABLE = np.array([expand_alaw(x) for x in range(256)], dtype=np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """At 16 x step index + nibble: what the nibble adds, and 16 x the next step index."""
    adds, nexts = [], []
    for index, step in enumerate(STEPS):
        for nibble in range(16):
            add = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
            adds.append(-add if nibble & 8 else add)
            nexts.append(16 * min(88, max(0, index + MOVES[nibble & 7])))
    return np.array(adds, dtype=np.int32), np.array(nexts, dtype=np.int32)


ADDS, NEXTS = adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 121) of n blocks of 64 bytes: a little-endian first sample, a step index, a spare byte, 120 nibbles, low ones first."""
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    at = 16 * np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((2 * (BLOCK - 4) + 1, len(blocks)), dtype=np.int16)
    out[0] = sample
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(BLOCK - 4):
        for half, nibble in enumerate((codes[k] & 15, codes[k] >> 4)):
            cell = at + nibble
            sample += ADDS[cell]
            np.clip(sample, -32768, 32767, out=sample)
            at = NEXTS[cell]
            out[2 * k + 1 + half] = sample
    return out.T


def compress(pcm: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The codes of a table that are nearest to the samples."""
    order = np.argsort(table, kind="stable")
    values = table[order].astype(np.int32)
    right = np.clip(np.searchsorted(values, pcm), 1, 255)
    nearer = np.abs(values[right - 1] - pcm) <= np.abs(values[right] - pcm)
    return order[right - nearer].astype(np.uint8)


def resample(pcm: np.ndarray, ends: np.ndarray, after: int) -> np.ndarray:
    """Twice the rate: means between neighbours; the last sample of a document (at `ends`) repeats. after: the sample that follows the last of all."""
    following = np.append(pcm[1:], np.int16(after))
    following[ends] = pcm[ends]
    out = np.empty(2 * len(pcm), dtype="<i2")
    out[::2] = pcm
    out[1::2] = (pcm.astype(np.int32) + following) >> 1
    return out


def wav(samples: bytes, kind: int, rate: int, width: int) -> bytes:
    """A RIFF file of one channel."""
    form = struct.pack("<HHIIHHH", kind, 1, rate, rate * width, width, 8 * width, 0)
    chunks = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, len(samples) // width) + b"data" + struct.pack("<I", len(samples)) + samples
    return b"RIFF" + struct.pack("<I", len(chunks)) + chunks


def unwav(media: bytes | None, kind: int = MULAW) -> bytes | None:
    """The samples of a file of that kind; None if it is none."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, right = 12, False
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            right = int.from_bytes(media[at + 8 : at + 10], "little") == kind
        elif name == b"data":
            return media[at + 8 : at + 8 + size] if right else None
        at += 8 + size + size % 2
    return None


def padded(data: bytes) -> bytes:
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0")


class Sums:
    """Squares, samples and zero crossings of one decoding of each document."""

    def __init__(self, n: int):
        self.squares, self.samples, self.crossings = (np.zeros(n, dtype=np.int64) for _ in range(3))
        self.last = 0  # sample of all so far

    def add(self, pcm: np.ndarray, starts: np.ndarray, own: np.ndarray, begins: np.ndarray) -> None:
        """starts: of the frames; begins: of those frames, which are the first of their documents."""
        wide = pcm.astype(np.int64)
        np.add.at(self.squares, own, np.add.reduceat(wide * wide, starts))
        below = np.append(self.last < 0, pcm < 0)
        crossed = below[1:] != below[:-1]
        crossed[starts[begins]] = False
        np.add.at(self.crossings, own, np.add.reduceat(crossed.astype(np.int64), starts))
        np.add.at(self.samples, own, np.diff(np.append(starts, len(pcm))))
        self.last = int(pcm[-1])

    def said(self, k: int) -> str:
        return f"{isqrt(int(self.squares[k]) // max(1, int(self.samples[k])))}/{self.crossings[k]}"


def listen(payloads: list[bytes], keep: bool = False) -> tuple[list[str], list[bytes]]:
    """Feature of each payload (a multiple of 64 bytes): rms/zero crossings as mu-law, A-law and ADPCM, and the crc32 of the resampled PCM; and that PCM itself if it is to be kept."""
    laws, blocks = {"ulaw": (Sums(len(payloads)), MULAW_TABLE), "alaw": (Sums(len(payloads)), ALAW_TABLE)}, Sums(len(payloads))
    crc, pcm_of = [0] * len(payloads), [[] for _ in payloads]
    frames = [(k, i, p[i : i + FRAME]) for k, p in enumerate(payloads) for i in range(0, len(p), FRAME)]
    first = 0
    while first < len(frames):
        last, size = first, 0
        while last < len(frames) and (last == first or size + len(frames[last][2]) <= AT_ONCE):
            size += len(frames[last][2])
            last += 1
        some, first = frames[first:last], last
        own, begins = np.array([k for k, _, _ in some]), np.array([i == 0 for _, i, _ in some])
        starts = np.cumsum([0, *(len(f) for _, _, f in some[:-1])])
        data = np.frombuffer(b"".join(f for _, _, f in some), dtype=np.uint8)
        goes_on = last < len(frames) and frames[last][1] > 0
        ends = np.append(starts[1:][begins[1:]] - 1, [] if goes_on else [len(data) - 1]).astype(np.int64)
        for name, (sums, table) in laws.items():
            pcm = table[data]
            sums.add(pcm, starts, own, begins)
            if name == "ulaw":
                wide = resample(pcm, ends, table[frames[last][2][0]] if goes_on else 0).tobytes()
                for k, a, b in zip(own.tolist(), (4 * starts).tolist(), [*(4 * starts[1:]).tolist(), len(wide)], strict=True):
                    crc[k] = zlib.crc32(wide[a:b], crc[k])
                    if keep:
                        pcm_of[k].append(wide[a:b])
        decoded = decode_adpcm(data.reshape(-1, BLOCK))
        blocks.add(decoded.reshape(-1), starts // BLOCK * decoded.shape[1], own, begins)
    said = [";".join([*(f"{name}={sums.said(k)}" for name, (sums, _) in laws.items()), f"adpcm={blocks.said(k)}", f"pcm16k={crc[k]:08x}"]) for k in range(len(payloads))]
    return said, [b"".join(x) for x in pcm_of]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_bytes (of the text) and media, the WAV file that holds it, of every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in texts(batches):
            data = [x.encode() for x in some]
            media = pa.array((wav(padded(x), MULAW, RATE, 1) for x in data), type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, data), type=pa.int64()), media], names=["id", "n_bytes", "media"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read(stored: DataFrame, id_col: str = "doc_id", keep_pcm: bool = True) -> DataFrame:
    """`id_col`, n_bytes, media, payload, feature and pcm (the resampled signal as a 16 kHz PCM file; null without keep_pcm) of stored rows."""
    bounded_batches(stored.sparkSession)
    rows = stored.select(F.col(id_col).alias("id"), "n_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [unwav(x) for x in batch.column("media").to_pylist()]
            said, pcm = listen([padded(x or b"") for x in payloads], keep_pcm)
            said = [None if p is None else s for p, s in zip(payloads, said, strict=True)]
            files = [wav(x, PCM, RESAMPLED, 2) if keep_pcm and p is not None else None for p, x in zip(payloads, pcm, strict=True)]
            columns = [*batch.columns, pa.array(payloads, type=pa.binary()), pa.array(said, type=pa.string()), pa.array(files, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "media", "payload", "feature", "pcm"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary, payload binary, feature string, pcm binary").withColumnRenamed("id", id_col)
