"""Product codes, prefix trie and packing against brute force, and their defined cases: nulls, empty and long texts, ties, repeats, clashes, no rows."""

import hashlib
import math
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from versed.llm import codes, packing, trie
from versed.llm.queries import QUERIES, ranks_and_pattern

SF = "/root/testdata/sf0.001"

# --- vector codes ---


def slow_codes(rows, parts=16, entries=64, rounds=2):
    """The contract's words: (id, vector, label) rows to code, error, label error by id, and the codebooks' digest."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = {i: [math.floor(256 * x) for x in v] for i, v, _ in kept}
    width = len(kept[0][1]) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v in whole.items()}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            used = defaultdict(list)
            for v in cut.values():
                used[best(p, v[p])[1]].append(v[p])
            for k, some in used.items():
                books[p][k] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    found = {i: [best(p, v[p]) for p in range(parts)] for i, v in cut.items()}
    by_label = defaultdict(int)
    for i, _, lab in kept:
        by_label[lab] += sum(d for d, _ in found[i])
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in found[i]), sum(d for d, _ in found[i]), by_label[lab], digest) for i, _, lab in kept}


VECTORS = "vec_id long, embedding array<float>, label int, vector string, kept string, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y", "z") for i, v, lab in rows], VECTORS)


def coded(frame):
    return {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in codes.compressed(frame).collect()}


@pytest.mark.parametrize("step", [0.37, 0.004])  # coarse: ties everywhere; fine: hardly any
def test_codes_equal_brute_force(spark, step):
    r = random.Random(5)
    rows = [(3 * i + 7, [float(np.float32(round(r.gauss(0, 1) / step) * step)) for _ in range(32)], r.choice([None, 1, 2])) for i in range(230)]
    rows[10] = (rows[10][0], rows[11][1], 1)
    rows += [(1, None, 1), (2, [0.5] * 31 + [None], 1), (3, [0.5] * 31 + [float("nan")], 1), (4, [float("-inf")] + [0.5] * 31, 2)]
    r.shuffle(rows)
    assert coded(vectors(spark, rows)) == slow_codes(rows)


@pytest.mark.parametrize("n", [1, 7, 64])
def test_nearest_keeps_the_lower_index_of_equals(n):
    r = np.random.default_rng(n)
    entries = r.integers(-3, 4, (n, 3))
    points = r.integers(-4, 5, (500, 3))
    index, d = codes.nearest(codes.grow(entries), points)
    slow = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == slow.argmin(axis=1)).all() and (d == slow.min(axis=1)).all()


def test_codes_of_odd_tables(spark):
    assert codes.compressed(vectors(spark, [])).count() == 0
    assert codes.compressed(vectors(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    one = coded(vectors(spark, [(1, [0.25] * 16, None)]))
    assert one[1][:3] == ("00" * 16, 0, 0)
    huge = coded(vectors(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.1] * 16, 1)]))
    assert set(huge) == {1, 2, 3}
    ragged = coded(vectors(spark, [(1, [0.5] * 17, 1), (2, [0.25] * 17, 1), (3, [0.5] * 16, 1), (None, [0.5] * 17, 1)]))
    assert set(ragged) == {1, 2, None} and ragged[None][0] == ragged[1][0]


def test_codes_decode(spark):
    frame = vectors(spark, [(i, [i / 4 + k / 64 for k in range(17)], 1) for i in range(20)])
    books = codes.learn(frame)
    out = {r["vec_id"]: r["approximation"] for r in codes.decode(codes.encode(frame, books), books).collect()}
    assert all(len(v) == 17 and max(abs(x - i / 4 - k / 64) for k, x in enumerate(v)) <= 1 / 256 for i, v in out.items())


# --- prefix trie ---


def slow_trie(rows):
    """The contract's words, over (conv, turn, role, text); equal turns must not differ."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    whole = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + s[h:])  # the sign of c, as in SQL
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = set()
    for k, convs in members.items():
        below = [v for v in members if v[: len(k)] == k]
        leaves = [v for v in below if not any(len(u) == len(v) + 1 and u[:-1] == v for u in below)]
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v)
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(k))
        children = sum(len(v) == len(k) + 1 for v in below)
        out.add((min(convs), len(k), min(members[k[:-1]]) if k else None, len(convs), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn long, role string, text string, n string, part string, depth string"


def talks(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)


def nodes(frame, **options):
    return [tuple(r)[:8] for r in trie.prefixes(frame, **options).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(60), 40):
        n = r.choice([1, 2, 5, 9, 14]) if c != 35 else 120
        rows += [(c, None if k == 0 and r.random() < 0.3 else k, r.choice(["user", None]), r.choice(["é", "a", "a", None])) for k in range(n)]
    rows += [(None, 1, "user", "a")]
    r.shuffle(rows)
    got = nodes(talks(spark, rows).repartition(7))
    assert len(got) == len(set(got)) and set(got) == slow_trie(rows)


def test_trie_across_many_ranges(spark):
    """One conversation with most of the rows, and many equal ones, over more ranges than conversations."""
    rows = [(0, k, "u", f"t{k % 3}") for k in range(400)] + [(c, k, "u", "same") for c in range(100, 140) for k in range(3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 29)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = nodes(talks(spark, rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(set(got)) and set(got) == slow_trie(rows)


def test_trie_intervals_nest(spark):
    r = random.Random(9)
    rows = [(c, k, "u", r.choice("ab")) for c in range(0, 200, 5) for k in range(r.randint(1, 6))]
    out = trie.prefixes(talks(spark, rows), shared=False).collect()
    assert sorted(x["start"] for x in out) == list(range(len(out)))
    at = {x["start"]: x for x in out}
    for x in out:
        inside = [at[k] for k in range(x["start"] + 1, x["end"] + 1)]
        assert all(y["depth"] > x["depth"] and y["end"] <= x["end"] for y in inside)
        assert sum(y["depth"] == x["depth"] + 1 for y in inside) == x["n_children"]
        assert sum(y["n_children"] == 0 for y in [x, *inside]) == x["n_leaves"]
        assert x["end"] + 1 == len(out) or at[x["end"] + 1]["depth"] <= x["depth"]


def test_trie_of_odd_tables(spark):
    assert nodes(talks(spark, [])) == [] and nodes(talks(spark, [(None, 1, "u", "a")])) == []
    lone = [(7, 0, None, None)]  # fewer turns than it takes from a conversation that isn't there
    assert set(nodes(talks(spark, lone))) == slow_trie(lone)
    long = [(5, 0, "u", "x" * 300_000), (5, 0, "u", "x" * 300_000), (6, 1, "u", "y")]
    assert set(nodes(talks(spark, long))) == slow_trie(long)
    below = [(c, k, "u", f"{c % 2}{k}") for c in range(-9, 7) for k in range(9)] + [(-(2**63), 0, "u", "a"), (2**63 - 1, 0, "u", "a")]
    assert set(nodes(talks(spark, below))) == slow_trie(below)


# --- packing ---


def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return (f.read(), *ranks_and_pattern("byte_bpe_50k.tiktoken"))


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "a", "b", "c") for k, t in enumerate(texts)], "doc_id long, text string, start string, size string, ids string")


def checked(out, texts, tiers=packing.TIERS):
    """Every id of every document in one piece; windows without gaps, full, of stated sizes but for the last of each task."""
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: [*exact.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append(r)
        some = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert r["ids_crc32"] == zlib.crc32(some.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert set(by_doc) == set(ids)
    for k, some in by_doc.items():
        some.sort(key=lambda r: r["start"])
        assert [r["start"] for r in some] == [sum(r["length"] for r in some[:i]) for i in range(len(some))]
        assert sum(r["length"] for r in some) == len(ids[k])
    assert sorted(by_window) == list(range(len(by_window)))
    steps = defaultdict(int)
    for some in by_window.values():
        some.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in some] == [sum(r["length"] for r in some[:i]) for i in range(len(some))]
        size = sum(r["length"] for r in some)
        assert {r["size"] for r in some} == {size} and size & (size - 1) == 0 and size <= tiers[0] and len({r["step"] for r in some}) == 1
        steps[some[0]["step"]] += size
    return steps


def test_packing_keeps_every_id_once(spark):
    r = random.Random(2)
    texts = [None, "", "a<|endoftext|>b", "x" * 9000, "the cat " * 3000, "日本語 🙂"] + [" ".join(r.choice(["alpha", "beta", "gamma delta"]) for _ in range(r.randint(1, 900))) for _ in range(120)]
    docs = docs_of(spark, texts).repartition(3)
    steps = checked(packing.pack(docs, *vocabulary(), step=8192).collect(), texts)
    assert len(steps) > 3 and max(steps.values()) - min(steps.values()) <= 2 * sum(packing.TIERS)
    with_ids = packing.pack(docs, *vocabulary(), with_ids=True).collect()
    assert all(zlib.crc32(bytes(x["ids"])) == x["ids_crc32"] and len(x["ids"]) == 4 * x["length"] for x in with_ids)


def test_packing_packs_again_when_a_block_is_full(spark, monkeypatch):
    texts = [f"word {k} " * (k % 40 + 1) for k in range(300)]
    monkeypatch.setattr(packing, "BLOCK", 3000)
    packer = packing.Packer()
    for k in range(300):
        packer.add(k, k % 70 + 1)
        if packer.waiting > 500:
            packer.pack()
    packer.pack(last=True)
    total = defaultdict(int)
    for doc, _, length, *_ in packer.pieces:
        total[doc] += length
    assert total == {k: k % 70 + 1 for k in range(300)} and packer.waiting == 0
    checked(packing.pack(docs_of(spark, texts).coalesce(1), *vocabulary()).collect(), texts)


def test_packing_cuts_few_documents(spark):
    r = random.Random(4)
    packer, lengths = packing.Packer(), [r.randint(1, 1024) for _ in range(3000)]
    for k, n in enumerate(lengths):
        packer.add(k, n)
    packer.pack(last=True)
    assert len(packer.pieces) < 1.4 * len(lengths)  # cutting a stream at every 1024 ids would give about 1.5
    sizes = {size for *_, size, _, _ in packer.pieces}
    assert {1024, 512} <= sizes


def test_packing_of_odd_tables(spark):
    assert packing.pack(docs_of(spark, []), *vocabulary()).count() == 0
    out = packing.pack(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string"), *vocabulary()).collect()
    assert sum(r["length"] for r in out) == 6 and {r["doc_id"] for r in out} == {None}


def test_encoder_equals_tokenizers_at_all_code_points():
    exact, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(*vocabulary())
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for k in range(0, len(chars), 20_000):
        some = [f"a{c}b1{c}2.{c}! {c} {c}{c}  {c}\n {c}  " for c in chars[k : k + 20_000]]
        want = exact.encode_batch_fast(some, add_special_tokens=False)
        assert all(w.ids == fast(t)[:-1].tolist() for w, t in zip(want, some, strict=True))


# --- contracts ---


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize(("name", "types"), [
    ("op11_vector_codes", {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}),
    ("op12_prefix_trie", {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"}),
    ("op13_packing", {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}),
])
def test_contract(spark, name, types):
    out = QUERIES[name](spark, SF)
    assert {k: dict(out.dtypes)[k] for k in types} == types
    if name == "op13_packing":
        docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        order = sorted(docs)
        places = {d: k for k, d in enumerate(order)}
        checked([{**r.asDict(), "doc_id": places[r["doc_id"]]} for r in out.collect()], [docs[d] for d in order])
