"""The queries of the operators, by name; each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versed.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def ranks_and_pattern(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    """The content of an installed rank file, read where the job starts, and its split pattern."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes."""
    from versed.llm import bpe

    ranks, pattern = ranks_and_pattern()
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern)
    return bpe.decode(ids, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the fixed patterns' spans, and all spans."""
    from versed.llm import secrets

    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.samples(spark)))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
    )


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents replicated to equal shares of all sources, in global shuffle order."""
    from versed.llm import mixing

    out = mixing.replicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "lang", "source", "n_chars", F.col("copy_no").cast("long").alias("copy_no"), F.col("n_copies").cast("long").alias("n_copies"), "shuffle_key")


ORACLE_SQL["op6_mixing"] = """
WITH RECURSIVE counts AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
sums AS (SELECT sum(n) AS all_n, count(*)::DOUBLE AS all_weight FROM counts),
rate AS (SELECT source, 1.0::DOUBLE / all_weight * all_n / n AS rate FROM counts, sums),
part AS (SELECT source, greatest(1, ceil(rate / 8.0::DOUBLE))::BIGINT AS parts, rate / greatest(1, ceil(rate / 8.0::DOUBLE))::DOUBLE AS mu FROM rate),
cdf AS (
  SELECT source, mu, 0::BIGINT AS k, exp(-mu) AS p, exp(-mu) AS c FROM part
  UNION ALL
  SELECT source, mu, k + 1, p * mu / (k + 1), c + p * mu / (k + 1) FROM cdf WHERE k < 60),
lists AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
draws AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.cs, unnest(range(1, p.parts + 1)) AS i
  FROM documents d JOIN part p ON d.source IS NOT DISTINCT FROM p.source JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
numbers AS (
  SELECT *, (('0x' || substr(md5('17:n:' || coalesce(doc_id::VARCHAR, md5(text), '') || ':' || i::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM draws),
copies AS (
  SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(cs, lambda c: c < u)))::BIGINT AS n_copies
  FROM numbers GROUP BY doc_id, text, lang, source, n_chars),
rows AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM copies)
SELECT doc_id, text, lang, source, n_chars, copy_no, n_copies,
  ('0x' || substr(md5('17:at:' || coalesce(doc_id::VARCHAR, md5(text), '') || ':' || copy_no::VARCHAR), 1, 15))::BIGINT AS shuffle_key
FROM rows
"""


@query
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score."""
    from versed.llm import urls

    return urls.judge(table(spark, sf_dir, "pages"), *urls.train(urls.labelled(spark)))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of each document, whether it fails the base rules, and the label model's verdict."""
    from versed.llm import rules

    out = rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "pattern")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; labels of the held-out fold are not learned from."""
    from versed.llm import toxicity
    from versed.llm.common import fold

    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", toxicity.verdict(0.5))


@query
def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; labels of the held-out fold are not learned from."""
    from versed.llm import gam
    from versed.llm.common import fold
    from versed.llm.toxicity import verdict

    docs = table(spark, sf_dir, "documents")
    out = gam.score(docs, gam.learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", verdict(0.3))


@query
def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's payload as read back from its stored form, of that form and of the resampled PCM file, and audio features."""
    from versed.llm import audio

    out = audio.read(audio.store(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"),
    )


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document: near-duplicates share the least doc_id among them."""
    from versed.llm import neardup

    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("is_first"))


@query
def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document between good documents (by label) and all."""
    from versed.llm import lm
    from versed.llm.common import fold

    docs = table(spark, sf_dir, "documents")
    target = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & (fold() != 0)).select("doc_id")
    return lm.difference(docs, target)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over `documents`."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors, their errors, the errors by label, and the codebooks' digest."""
    from versed.llm import codes

    return codes.compressed(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op11_vector_codes"] = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS p FROM (SELECT vec_id, v, unnest(range(16)) AS part FROM kept)),
book0 AS MATERIALIZED (SELECT part, rank - 1 AS e, p AS b FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rank FROM parts) WHERE rank <= 64),
near0 AS MATERIALIZED (SELECT vec_id, part, any_value(p) AS p, min({'d': list_sum(list_transform(list_zip(p, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}) AS best FROM parts JOIN book0 USING (part) GROUP BY vec_id, part),
sums0 AS (SELECT part, e, list(floor(s / n)::BIGINT ORDER BY i) AS b FROM (SELECT part, best.e AS e, i, sum(x)::DOUBLE AS s, count(*) AS n FROM (SELECT part, best, unnest(p) AS x, unnest(range(len(p))) AS i FROM near0) GROUP BY part, best.e, i) GROUP BY part, e),
book1 AS MATERIALIZED (SELECT part, e, coalesce(s.b, o.b) AS b FROM book0 o LEFT JOIN sums0 s USING (part, e)),
near1 AS MATERIALIZED (SELECT vec_id, part, any_value(p) AS p, min({'d': list_sum(list_transform(list_zip(p, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}) AS best FROM parts JOIN book1 USING (part) GROUP BY vec_id, part),
sums1 AS (SELECT part, e, list(floor(s / n)::BIGINT ORDER BY i) AS b FROM (SELECT part, best.e AS e, i, sum(x)::DOUBLE AS s, count(*) AS n FROM (SELECT part, best, unnest(p) AS x, unnest(range(len(p))) AS i FROM near1) GROUP BY part, best.e, i) GROUP BY part, e),
book2 AS MATERIALIZED (SELECT part, e, coalesce(s.b, o.b) AS b FROM book1 o LEFT JOIN sums1 s USING (part, e)),
near2 AS (SELECT vec_id, part, min({'d': list_sum(list_transform(list_zip(p, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}) AS best FROM parts JOIN book2 USING (part) GROUP BY vec_id, part),
coded AS (SELECT vec_id, string_agg(lpad(printf('%x', best.e), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY part, e)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    from versed.llm import trie

    return trie.prefixes(table(spark, sf_dir, "conversations")).drop("start", "end")


ORACLE_SQL["op12_prefix_trie"] = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT conv_id, list({'r': r, 'x': x} ORDER BY n) AS s FROM t GROUP BY conv_id),
shares AS (
  SELECT conv_id, s, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, k: xor(v // 2, 3988292384 * (v % 2))))) % 9 AS h FROM own),
rebuilt AS MATERIALIZED (
  SELECT c.conv_id, list_concat(coalesce(b.s, [])[1 : c.h], c.s[c.h + 1 :]) AS s FROM shares c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
heads AS MATERIALIZED (SELECT conv_id, d, s[1 : d] AS k, len(s) AS own_length FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce((count(*) - 1) * strlen(k[-1].x), 0) AS saving,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (own_length = d), '')) AS ends_sha256 FROM heads GROUP BY k, d),
children AS (SELECT k[1 : d - 1] AS k, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
shaped AS MATERIALIZED (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (k, d)),
sums AS (SELECT k[1 : a] AS k, a AS d, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saving)::BIGINT AS saved_tokens FROM (SELECT k, n_children, saving, unnest(range(d + 1)) AS a FROM shaped) GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM shaped v JOIN sums s USING (k, d) LEFT JOIN nodes p ON p.d = v.d - 1 AND p.k = v.k[1 : v.d - 1]
"""


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of up to 1024 ids, with the windows' sizes and step groups."""
    import public_tokenizers

    from versed.llm import packing

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        vocabulary = f.read()
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary, *ranks_and_pattern("byte_bpe_50k.tiktoken"))
