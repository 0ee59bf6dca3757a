"""The registered queries over the smallest tables: contracts, held-out accuracy, and the pipeline against its stages by hand."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from versed.llm import neardup, rules, secrets
from versed.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize(("name", "types"), [
    ("op1_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
    ("op2_quality_rules", {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}),
    ("op3_secrets", {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}),
    ("op4_audio", {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}),
    ("op5_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    ("op8_near_duplicates", {"doc_id": "bigint", "class_id": "bigint"}),
    ("op10_quality_gam", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
])
def test_contract(spark, docs, name, types):
    out = QUERIES[name](spark, SF)
    assert {k: dict(out.dtypes)[k] for k in types} == types
    got = out.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    if name == "op1_bpe":
        assert all(r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest() for r in got)


def test_urls_contract(spark):
    out = QUERIES["op9_urls"](spark, SF)
    assert out.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert {r["verdict"] for r in out.collect()} == {"allow", "block"}


def test_pipeline_equals_its_stages_by_hand(spark, docs):
    out = corpus_pipeline.run(spark, SF)
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in rules.judge(frame).where("kept").collect()}
    classes = {r["doc_id"]: r["class_id"] for r in neardup.classes(frame.where(F.col("doc_id").isin(*kept))).collect()}
    first = {k for k, c in classes.items() if k == c}
    got = out.collect()
    assert all(r["round_trip"] for r in got) and {r["doc_id"] for r in got} <= first
    assert len(got) > 0.5 * len(first)
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(frame, secrets.train(secrets.samples(spark))).collect()}
    import public_tokenizers as P
    import tiktoken

    from versed.llm.bpe import read_ranks

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    assert all(r["ids"] == enc.encode_ordinary(masked[r["doc_id"]]) for r in got)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "secret scans", "source weights", "byte-level BPE"]
