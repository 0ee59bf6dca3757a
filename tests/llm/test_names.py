"""Operators that pass rows through: columns with odd names, maps, ids that are no numbers."""

import pytest
from pyspark.sql import functions as F

from versed.llm import lm, mixing, neardup, rules, secrets, toxicity

WORDS = " ".join(f"word{k} the of" for k in range(40)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(str(k) if k % 5 else f"no-{k}", f"{WORDS} {' '.join(f'x{k}y{j}' for j in range(200))}" if k % 4 else WORDS, "en", f"s{k % 3}", 9, "a", "b", "c", {"k": str(k)}) for k in range(20)]
    return spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long, `my col` string, `a.b` string, `meta:x` string, tags map<string,string>")


def test_rows_pass_through_with_any_columns(spark, docs):
    kept = rules.keep(docs)
    assert kept.schema == docs.schema and kept.count() == 20
    one = neardup.keep_one(docs)
    assert one.columns == docs.columns and one.count() == 16
    again = neardup.keep_one(docs.unionByName(docs.withColumn("tags", F.create_map(F.lit("z"), F.lit("z")))))
    assert again.count() == 16
    many = mixing.replicate(docs)
    assert many.columns == [*docs.columns, "copy_no", "n_copies", "shuffle_key"] and many.where("`a.b` = 'b' and tags is not null").count() == many.count() > 0
    hidden = secrets.redact(docs.withColumn("text", F.lit("password: hunter22")), secrets.train(secrets.samples(spark)))
    assert hidden.columns == docs.columns and {r["text"] for r in hidden.collect()} == {"[SECRET]"}


def test_ids_that_are_no_numbers_count_as_absent(spark, docs):
    out = neardup.classes(docs).collect()
    assert len(out) == 20 and sum(r["doc_id"] is None for r in out) == 4
    target = spark.createDataFrame([("1",), ("no-5",), ("2",)], "doc_id string")
    scores = lm.difference(docs, target).collect()
    assert len(scores) == 20 and {r["doc_id"] for r in scores} == {r["doc_id"] for r in docs.collect()}


def test_absent_and_long_documents_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(k, "x" * (50_000 if k % 2 else 20)) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(2000)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, "toxic", 60, 16_384).collect()
    assert len(got) == 60 and all(r["doc_id"] < 200 and r["doc_id"] % 2 == 0 for r in got)
