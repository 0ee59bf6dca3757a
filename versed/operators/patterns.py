"""Many patterns at once in whole texts: an automaton with failure links, made once for a worker, instead of a test for each pattern.

Patterns go out in blocks of at most BLOCK characters, so what is broadcast is bounded; a further block is a further pass over
the texts, whose result is written before the next one starts. No pairs are tried: a text's own matches are all that is made.

For quotes that may be altered, the patterns are seeds. A quote of n characters is near a text if they have a block of
`needed(n)` characters in common; every stretch of that length in the quote holds a whole seed, since seeds are half as long
and stand side by side. So each near text has a seed, and the longest common block is found by going on from its seeds in
both directions: nothing is lost, whatever the length of quote or text.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versed.functions.python import QUOTE_LEAST, flat, judged_quote, normal, plain
from versed.plans.session import workspace
from versed.sources.documents import landed

#: Characters of one block of patterns. A common block of a quote has SHARE of it and LEAST characters at least.
BLOCK, SHARE, LEAST = 1 << 24, 0.25, 8

#: Automata of this Python worker; workers serve many tasks.
KNOWN: dict[int, tuple] = {}


def kept(sent, make: Callable):
    """make(sent.value), once for a worker."""
    if sent.value[0] not in KNOWN:
        KNOWN.clear()
        KNOWN[sent.value[0]] = make(sent.value[1])
    return KNOWN[sent.value[0]]


def automaton(patterns: list[tuple[object, str]]) -> ahocorasick.Automaton:
    """From each pattern to its names and its length."""
    names: dict[str, list] = {}
    for name, pattern in patterns:
        names.setdefault(pattern, []).append(name)
    out = ahocorasick.Automaton()
    for pattern, some in names.items():
        out.add_word(pattern, (some, len(pattern)))
    out.make_automaton()
    return out


def in_blocks(patterns: DataFrame, name: str, pattern: str, one: Callable[[list[tuple], int], DataFrame], block: int = BLOCK) -> DataFrame | None:
    """What `one` makes of each block of patterns and its number, together; none without patterns."""
    rows = patterns.where(F.col(name).isNotNull() & (F.length(pattern) > 0)).select(F.col(name).alias("name"), F.col(pattern).alias("pattern")).distinct()
    blocks = -(-(rows.agg(F.sum(F.length("pattern"))).first()[0] or 0) // block)
    out = None
    for b in range(blocks):
        some = [(r["name"], r["pattern"]) for r in rows.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b).collect()]
        if some:
            made = one(some, b)
            made = landed(made, workspace(made.sparkSession)) if blocks > 1 else made
            out = made if out is None else out.unionByName(made)
    return out


def broadcast(df: DataFrame, value: list):
    """The value under a name that workers keep what they make of it by."""
    return df.sparkSession.sparkContext.broadcast((uuid.uuid4().int, value))


def matches(docs: DataFrame, key: str, text: str, patterns: DataFrame, name: str, pattern: str, prepared: Callable[[str], str] | None = None, block: int = BLOCK) -> DataFrame:
    """key, name, position (from 1) of the first and number n of all occurrences (they may overlap) of each pattern that a text holds.

    `prepared` is applied to texts and patterns alike. Null and empty patterns and null texts match nothing; a name that
    stands for several patterns has a row for each.
    """
    kind = patterns.schema[name].dataType.simpleString()

    def one(some: list[tuple], _: int) -> DataFrame:
        sent = broadcast(docs, [(n, prepared(p) if prepared else p) for n, p in some])

        def found(body: str | None) -> list[tuple]:
            machine, at = kept(sent, automaton), {}
            body = (prepared(body) if prepared else body) if body else ""
            if body and len(machine):
                for end, (names, size) in machine.iter(body):
                    first, n, _ = at.get((size, id(names)), (end - size + 2, 0, None))
                    at[size, id(names)] = first, n + 1, names
            return [(x, first, n) for first, n, names in at.values() for x in names]

        return flat(docs, [key], [text], f"name {kind}, position long, n long", found)

    out = in_blocks(patterns, name, pattern, one, block)
    return out if out is not None else docs.select(key, F.lit(None).cast(kind).alias("name"), F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("n")).where("false")


def needed(n: int) -> int:
    """Characters of the common block that makes a text near a quote of n characters (the whole quote, if it has fewer than LEAST)."""
    return min(n, max(LEAST, math.ceil(n * SHARE)))


def seeds(quote: str) -> list[tuple[int, str]]:
    """Places and seeds of a normalised quote: half as long as a common block must be, side by side."""
    size = max(1, (needed(len(quote)) + 1) // 2)
    return [(k, quote[k : k + size]) for k in range(0, len(quote) - size + 1, size)]


class Quotes:
    """Quotes by number, normalised, and the automaton of their seeds."""

    def __init__(self, quotes: list[tuple[object, str]]):
        self.quotes = [(name, quote, plain(quote)) for name, quote in quotes if len(quote.strip()) >= QUOTE_LEAST]
        self.machine = automaton([((k, at), seed) for k, (_, _, nq) in enumerate(self.quotes) for at, seed in seeds(nq)])

    def blocks(self, text: str) -> dict[int, tuple[int, int, int]]:
        """The longest common block of each quote that is near a normalised text: its place there, its place in the quote, its length; the first of equals."""
        best: dict[int, tuple[int, int, int]] = {}
        if not text or not len(self.machine):
            return {}
        for end, (names, size) in self.machine.iter(text):
            for k, at in names:
                nq, a, b = self.quotes[k][2], end - size + 1, at
                old = best.get(k)
                if old and old[0] <= a < old[0] + old[2] and a - old[0] == b - old[1]:
                    continue  # inside the best block, on its line
                i, j = a + size, b + size
                while i < len(text) and j < len(nq) and text[i] == nq[j]:
                    i, j = i + 1, j + 1
                while a and b and text[a - 1] == nq[b - 1]:
                    a, b = a - 1, b - 1
                if old is None or (i - a, -a, -b) > (old[2], -old[0], -old[1]):
                    best[k] = a, b, i - a
        return {k: x for k, x in best.items() if x[2] >= needed(len(self.quotes[k][2]))}

    def near(self, text: str | None) -> list[tuple]:
        """(name, status, start, length, rules, diff, block) of each quote that is near a text."""
        text = text or ""
        found, out = self.blocks(plain(text)), []
        if found:
            nt, places = normal(text)
            for k, block in found.items():
                name, quote, nq = self.quotes[k]
                out.append((name, *judged_quote(text, quote, nt, places, nq, block)[:5], block[2]))
        return out


def near_quotes(docs: DataFrame, key: str, text: str, quotes: DataFrame, name: str, quote: str, block: int = BLOCK) -> DataFrame:
    """key, name, status (exact, normalized, mismatch), start and len of the quote or of the window nearest to it, rules, diff, and block, the length of the longest common block, of every text that is near a quote.

    Quotes that are too short to verify (QUOTE_LEAST characters) are near nothing.
    """
    kind = quotes.schema[name].dataType.simpleString()

    def one(some: list[tuple], _: int) -> DataFrame:
        sent = broadcast(docs, some)
        return flat(docs, [key], [text], f"name {kind}, status string, start long, len long, rules string, diff string, block long", lambda body: kept(sent, Quotes).near(body))

    out = in_blocks(quotes, name, quote, one, block)
    if out is not None:
        return out
    none = F.lit(None).cast("string")
    return docs.select(key, F.lit(None).cast(kind).alias("name"), none.alias("status"), *(F.lit(0).cast("long").alias(c) for c in ("start", "len")), none.alias("rules"), none.alias("diff"), F.lit(0).cast("long").alias("block")).where("false")

