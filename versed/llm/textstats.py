"""Counts of one text that the quality operators share; each takes time in proportion to the text's length."""

from __future__ import annotations

import re

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
BLANK = " \t\n\x0b\x0c\r"

#: Frequent words of the languages expected.
STOP = frozenset("""
the of and to in is that it was for on are as with be at by this have from or an not but
der die das und ist nicht mit den von sich ein eine des auf für im dem zu
le la les de des et est un une que pour dans qui du en sur au
el los las y es un una que para con del por se no su
""".split())

#: Names of the counts, in the order of stats().
NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_stop", "n_upper",
    "n_letters", "n_digits", "n_exclaim", "n_stopped", "n_runs", "n_longest_run",
)


def repeated(ids: np.ndarray, width: int = 3) -> int:
    """Words in `width`-word windows that occur twice or more."""
    if len(ids) < width + 1:
        return 0
    keys = ids[: len(ids) - width + 1].astype(np.int64)
    top = int(ids.max()) + 1
    for k in range(1, width):
        if keys.max() >= (1 << 62) // top:
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * top + ids[k : len(ids) - width + 1 + k]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(width):
        covered[k : len(ids) - width + 1 + k] |= twice
    return int(covered.sum())


def stats(text: str) -> tuple[int, ...]:
    """The counts of NAMES."""
    words = WORDS(text)
    n = len(words)
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    stop = sum(map(STOP.__contains__, text.lower().split()))
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    ascii_ = codes[codes < 256]
    kinds = np.bincount(ascii_, minlength=256)
    upper = int(kinds[65:91].sum() + kinds[192:223].sum())
    lower = int(kinds[97:123].sum() + kinds[223:256].sum())
    same = np.flatnonzero(np.append(ids[1:] != ids[:-1], True)) if n else np.empty(0, dtype=np.int64)
    lengths = np.diff(same, prepend=-1)
    return (
        n, sum(map(len, words)), int(kinds[[35, 36, 37, 38, 42, 60, 62, 124]].sum()), len(lines) - len(set(lines)), repeated(ids),
        len(lines), len(numbers), stop, upper, upper + lower, int(kinds[48:58].sum()), int(kinds[33]),
        int(kinds[46] + kinds[44]), len(lengths), int(lengths.max(initial=0)),
    )
