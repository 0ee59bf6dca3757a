"""Quotes against texts: alignment, windows, patterns and near quotes, each against brute force."""

import difflib
import os
import random

import pytest

from versed.functions import python as P
from versed.functions.text import QUOTE_RULES
from versed.operators import patterns
from versed.plans import catalog

SF = "/root/testdata/sf0.001"


def test_plain_equals_the_normalised_text():
    r = random.Random(1)
    chars = "ab «»'’—-­​  \t\n\x0b\x1c\u0085　 "
    for _ in range(2000):
        text = "".join(r.choice(chars) for _ in range(r.randint(0, 25)))
        assert P.plain(text) == P.normal(text)[0]
        on = tuple(x for x in QUOTE_RULES if r.random() < 0.5)
        assert P.plain(text, on) == P.normal(text, frozenset(QUOTE_RULES) - set(on))[0]


def test_longest_common_block_is_the_first_of_the_longest():
    r = random.Random(2)
    for _ in range(1500):
        text, quote = ("".join(r.choice("abc") for _ in range(r.randint(0, n))) for n in (40, 12))
        block = difflib.SequenceMatcher(None, text, quote, autojunk=False).find_longest_match()
        assert P.longest_common(text, quote) == ((block.a, block.b, block.size) if block.size else (0, 0, 0))


def slow_match(text, quote):
    """The rule as it reads: exact, normalised, or the window of the quote's length around the longest common block."""
    if len(quote.strip()) < 15:
        return ("refused", None, None)
    if quote in text:
        return ("exact", text.index(quote), len(quote))
    (nt, places), (nq, _) = P.normal(text), P.normal(quote)
    if nq and nq in nt:
        a = nt.index(nq)
        return ("normalized", places[a], places[a + len(nq) - 1] + 1 - places[a])
    block = difflib.SequenceMatcher(None, nt, nq, autojunk=False).find_longest_match()
    if not nt or block.size < min(4, len(nq)):
        return ("mismatch", None, None)
    a = max(0, min(block.a - block.b, max(0, len(nt) - len(nq))))
    end = places[min(a + len(nq), len(nt)) - 1] + 1
    return ("mismatch", places[a], end - places[a])


def test_match_equals_the_rule():
    r = random.Random(3)
    for _ in range(800):
        words = [r.choice(["сторони", "дійшли", "згоди", "—", "не", " ", "«акт»", "\n"]) for _ in range(r.randint(0, 14))]
        text, k = " ".join(words), r.randint(0, 6)
        quote = " ".join(r.choice([w, w, w, "інше"]) for w in words[k : k + 6]) or "немає такого речення"
        assert P.match_quote(text, quote)[0][:3] == slow_match(text, quote), (text, quote)


def test_windows_keep_their_length_at_the_end_of_a_text():
    text, quote = "початок тексту і ще трохи слів: спільна частина", "спільна частина та ще багато чого за нею"
    status, start, size, _, diff, reason = P.match_quote(text, quote)[0]
    assert (status, start + size, size, reason) == ("mismatch", len(text), len(quote), None) and "{+" in diff


def test_exact_quotes_keep_their_blanks():
    assert P.match_quote("перше слово друге слово", " слово друге слово")[0][:3] == ("exact", 5, 18)
    assert P.match_quote("x" * 10, "   коротка     ")[0] == ("refused", None, None, None, None, "too_short")


def test_long_texts_are_searched():
    text = "інший текст " * 40_000 + "суд постановив відмовити у задоволенні позову" + " кінець" * 50_000
    status, start, size, _, diff, reason = P.match_quote(text, "суд постановив відмовити в задоволенні позову")[0]
    assert status == "mismatch" and text[start : start + size].startswith("суд постановив") and "{+в+}" in diff and reason is None


def needed_by_definition(n):
    return min(n, max(8, -(-n // 4)))


def slow_near(texts, quotes):
    out = set()
    for i, q in quotes.items():
        for d, t in texts.items():
            nt, nq = P.normal(t or "")[0], P.normal(q)[0]
            block = difflib.SequenceMatcher(None, nt, nq, autojunk=False).find_longest_match().size
            if len(q.strip()) >= 15 and block >= needed_by_definition(len(nq)):
                out.add((i, d, *slow_match(t or "", q), block))
    return out


def near(spark, texts, quotes, **options):
    docs = spark.createDataFrame(list(texts.items()), "doc long, text string")
    asked = spark.createDataFrame(list(quotes.items()), "item long, quote string")
    rows = patterns.near_quotes(docs, "doc", "text", asked, "item", "quote", **options).collect()
    assert len({(r["name"], r["doc"]) for r in rows}) == len(rows)
    return {(r["name"], r["doc"], r["status"], r["start"], r["len"], r["block"]) for r in rows}


def test_near_quotes_of_three_words_up(spark):
    r = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma", "delta", "lorem", "ipsum", "—", "«x»"]
    quotes = {k: " ".join(r.choice(vocabulary) for _ in range(r.randint(3, 9))) for k in range(40)}
    texts = {k: " ".join(r.choice([*vocabulary, f"w{r.randint(0, 99)}"]) for _ in range(r.randint(0, 60))) for k in range(60)}
    texts[100] = "words before " + quotes[3] + " words after"
    texts[101] = " ".join(w if k != 2 else "changed" for k, w in enumerate("one two three four five six".split()))
    quotes[101] = "one two three four five six"
    quotes[102], texts[102] = "alpha beta gamma", "x" * 250_000 + " alpha beta gamma " + "y" * 250_000
    texts[103], quotes[103], quotes[104] = None, "", "too short"
    want = slow_near({k: t for k, t in texts.items() if k != 102}, quotes)
    got = near(spark, texts, quotes)
    assert {x for x in got if x[1] != 102} == want and (101, 101) in {x[:2] for x in got}
    assert {x[:3] for x in got if x[0] == 102 and x[1] == 102} == {(102, 102, "exact")}
    assert near(spark, texts, quotes, block=200) == got  # many passes
    assert near(spark, texts, {}) == near(spark, {}, quotes) == set()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_quote_nearest_equals_brute_force_over_all_pairs(spark):
    """Every pair of the smallest tables is tried; texts by quick bounds first, since the plain alignment takes seconds a pair."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["item_id"], r["doc_id"]): r for r in catalog.quote_nearest(spark, SF).collect()}
    for i, q in items.items():
        nq = P.normal(q)[0]
        n = needed_by_definition(len(nq))
        grams = {nq[k : k + n] for k in range(len(nq) - n + 1)}
        for d, t in docs.items():
            nt = P.normal(t or "")[0]
            assert ((i, d) in got) == (len(q.strip()) >= 15 and any(g in nt for g in grams))
    for (i, d), r in list(got.items())[:40]:
        assert (r["status"], r["start"], r["len"]) == P.match_quote(docs[d], items[i])[0][:3]


def test_patterns_equal_a_test_for_each(spark):
    r = random.Random(5)
    names = {k: "".join(r.choice("ab ") for _ in range(r.randint(0, 4))) for k in range(30)}
    texts = {k: "".join(r.choice("ab ") for _ in range(r.randint(0, 30))) for k in range(50)}
    texts[99] = None
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc long, text string, name string")
    asked = spark.createDataFrame([*names.items(), (50, None), (None, "a")], "item long, pattern string")
    want = {(i, d, t.index(p) + 1, sum(t.startswith(p, k) for k in range(len(t)))) for i, p in names.items() if p for d, t in texts.items() if t and p in t}
    for block in (1 << 20, 10):
        rows = patterns.matches(docs.drop("name"), "doc", "text", asked, "item", "pattern", block=block).collect()
        assert {(x["name"], x["doc"], x["position"], x["n"]) for x in rows} == want and len(rows) == len(want)
    assert patterns.matches(docs.drop("name"), "doc", "text", asked.where("false"), "item", "pattern").count() == 0
