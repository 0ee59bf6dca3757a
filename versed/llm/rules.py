"""Quality rules as weak supervision.

Each rule votes for a text (1), against it (-1) or abstains (0). The votes of all documents are counted by pattern (at
most 3 to the number of rules), and expectation-maximisation over the patterns estimates how often each rule is right
about good and about bad texts, and the share of good texts. A document's quality is its posterior probability given its
pattern, in place of a filter that all rules must pass.

Counts of a text are made once, in Arrow batches, and written to the shared folder; votes, patterns and posteriors are
SQL expressions on those few numbers, and the posteriors join by broadcast. Nothing but the pattern counts reaches the
driver.

Defined cases: a null text has no words; an empty text makes every rule abstain but base_failed holds; whole texts count;
repeated rows are judged each; an empty table gives an empty result; other columns are ignored by judge() and kept by
keep(); of rows that share a doc_id, keep() keeps those whose own text passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from versed.llm.common import bounded_batches, cut, texts, whole_row, whole_text
from versed.llm.textstats import NAMES, stats

#: name, share (a ratio of counts), bounds: a vote against from `bad` on, a vote for up to `good`, else none.
#: Where bad < good, the other way round.
RULES = (
    ("symbols", "n_symbols / n_words", 0.25, 0.03),
    ("symbol_share", "n_symbols / word_chars", 0.04, 0.01),
    ("repeated_windows", "n_repeat_words / n_words", 0.35, 0.10),
    ("repeated_lines", "n_dup_lines / n_lines", 0.30, 0.05),
    ("shouting", "n_upper / n_letters", 0.40, 0.12),
    ("exclaiming", "n_exclaim / n_words", 0.20, 0.02),
    ("variety", "n_distinct / n_words", 0.15, 0.30),
    ("stop_words", "n_stop / n_words", 0.005, 0.08),
    ("runs", "n_longest_run / n_words", 0.05, 0.02),
    ("word_length", "word_chars / n_words", 15.0, 9.0),
)

#: Patterns of votes at most: what is collected and broadcast is bounded by it.
PATTERNS = 3**11

#: Steps of expectation-maximisation, and the weight of the prior counts that keep every rate inside (0, 1).
STEPS, PRIOR = 60, 2.0


def counted(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row, as a struct named row, and the counts of its text."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(whole_row(docs, list(keep)), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in texts(batches):
            columns = np.array([stats(x) for x in some], dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, columns)], names=["row", *NAMES])

    schema = StructType([rows.schema["row"]])
    for name in NAMES:
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema)


def vote(share: str, bad: float, good: float) -> Column:
    up, down = share.split(" / ")
    value = F.col(up) / F.nullif(F.col(down), F.lit(0))
    against, support = (value >= bad, value <= good) if bad > good else (value <= bad, value >= good)
    return F.when(against, -1).when(support, 1).otherwise(0)


def pattern(rules=RULES) -> Column:
    """The votes as one string of the characters - 0 +."""
    return F.concat(*(F.when(vote(*r[1:]) > 0, "+").when(vote(*r[1:]) < 0, "-").otherwise("0") for r in rules))


def fit(counts: dict[str, int], rules=RULES) -> dict[str, float]:
    """Posterior probability of good for each pattern of votes, from how often the patterns occur."""
    if not counts:
        return {}
    names = sorted(counts)
    votes = np.array([[{"-": -1, "0": 0, "+": 1}[x] for x in name] for name in names])
    weight = np.array([counts[x] for x in names], dtype=float)
    voted, support = votes != 0, votes > 0
    good = np.where((votes < 0).any(axis=1), 0.2, 0.95)  # a start: doubt what any rule votes against
    for _ in range(STEPS):
        share = (good @ weight + 9 * PRIOR) / (weight.sum() + 10 * PRIOR)
        w1, w0 = good * weight, (1 - good) * weight
        # rates of a vote for, given good and bad and that the rule votes; priors hold rules to be right more often than not
        for_good = (w1 @ support + 9 * PRIOR) / (w1 @ voted + 10 * PRIOR)
        for_bad = (w0 @ support + 5 * PRIOR) / (w0 @ voted + 10 * PRIOR)
        for_bad = np.minimum(for_bad, for_good)  # no rule counts against its own vote
        step = np.where(support, np.log(for_good / for_bad), np.where(voted, np.log((1 - for_good) / (1 - for_bad)), 0.0))
        logit = np.log(share / (1 - share)) + step.sum(axis=1)
        good = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
    return dict(zip(names, good.tolist(), strict=True))


def judged(counts: DataFrame, rules=RULES) -> DataFrame:
    """`counts` with pattern, quality (posterior), base_failed and kept; `counts` must be cheap to read twice."""
    if 3 ** len(rules) > PATTERNS:
        raise ValueError(f"{len(rules)} rules have more than {PATTERNS} patterns of votes")
    rows = counts.withColumn("pattern", pattern(rules))
    found = {r["pattern"]: r["count"] for r in rows.groupBy("pattern").count().collect()}  # at most PATTERNS rows
    posterior = counts.sparkSession.createDataFrame(list(fit(found, rules).items()), "pattern string, quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.join(F.broadcast(posterior), "pattern", "left").withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """`id_col`, the counts, pattern, quality, base_failed and kept of every row."""
    rows = judged(cut(counted(docs, text_col, (id_col,))), rules)
    return rows.select(F.col("row").getField(id_col).alias(id_col), *(c for c in rows.columns if c != "row"))


def keep(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of `docs`, all columns, that are kept. Rows pass through the count with their text, so no join finds them again."""
    return judged(cut(counted(docs, text_col, tuple(docs.columns))), rules).where("kept").select("row.*")
