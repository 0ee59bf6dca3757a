"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted on the logistic loss, one feature after another in turn, and summed into one lookup table for
each feature; then the pairs of features that lower the loss most get a table each in the same way. A score is the sum
of table entries at a text's bins, added for whole batches at once.

The model is fitted on a bounded sample of labelled rows (SAMPLE, the least hashes of doc_id); every document is counted
and scored whole, in bounded Arrow batches, in one pass without a shuffle.

Defined cases: a null text counts as empty, and an empty text has zeros for all features; of several labels of a doc_id
the larger counts, and of several texts the least is learned from; with no labels, or one kind, the score is that share (0 without any); features that never vary
get one bin; repeated rows get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versed.llm.common import bounded_batches, texts, whole_text
from versed.llm.textstats import NAMES, stats
from versed.llm.toxicity import sample

#: Labelled rows to learn from at most.
SAMPLE = 20_000
#: Bins of a feature, and of each side of a pair; rounds over all features and pairs; step; leaves; pairs; floor of a leaf's curvature.
BINS, PAIR_BINS, ROUNDS, STEP, LEAVES, PAIRS, FLOOR = 32, 12, 60, 0.2, 3, 6, 1.0

#: Features: a count alone, or a ratio of two.
FEATURES = (
    "n_words", "word_chars / n_words", "n_symbols / n_words", "n_symbols / word_chars", "n_dup_lines / n_lines", "n_repeat_words / n_words",
    "n_words / n_lines", "n_distinct / n_words", "n_stop / n_words", "n_upper / n_letters", "n_digits / word_chars", "n_exclaim / n_words",
    "n_stopped / n_words", "n_runs / n_words", "n_longest_run / n_words",
)


def features(counts: np.ndarray) -> np.ndarray:
    """Rows of counts to rows of features."""
    at = {n: counts[:, k].astype(float) for k, n in enumerate(NAMES)}
    out = []
    for f in FEATURES:
        up, _, down = f.partition(" / ")
        out.append(at[up] / np.maximum(at[down], 1) if down else at[up])
    return np.stack(out, axis=1)


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    bias: float
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # by feature, the pair bin of each bin

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def logit(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.bias)
        for k, table in enumerate(self.tables):
            total += table[bins[:, k]]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[self.coarse[a][bins[:, a]], self.coarse[b][bins[:, b]]]
        return total

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.bins(features(counts))), -30, 30)))


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values by bin of a tree of LEAVES leaves: each split is the one that gains most."""
    cg, ch = np.append(0.0, np.cumsum(g)), np.append(0.0, np.cumsum(h))
    cuts = [0, len(g)]

    def worth(a, b):
        return (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + FLOOR)

    for _ in range(LEAVES - 1):
        best, where = 1e-9, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = worth(a, c) + worth(c, b) - worth(a, b)
                if gain.max() > best:
                    best, where = gain.max(), int(c[gain.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + FLOOR)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both sides of a grid once."""

    def four(x):
        c = x.cumsum(0).cumsum(1)
        ll = c[:-1, :-1]
        lr, rl = c[:-1, -1:] - ll, c[-1:, :-1] - ll
        return np.stack([ll, lr, rl, c[-1, -1] - ll - lr - rl])

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    fg, fh = four(g), four(h)
    gain = (fg**2 / (fh + FLOOR)).sum(0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    v = fg[:, i, j] / (fh[:, i, j] + FLOOR)
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def train(counts: np.ndarray, labels: np.ndarray) -> Model | None:
    """Fit; None if the labels are of one kind."""
    y = np.asarray(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    x = features(counts)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], float(np.log(y.mean() / (1 - y.mean()))))
    model.coarse = [np.arange(len(t)) * PAIR_BINS // max(len(t), PAIR_BINS) for t in model.tables]
    bins = model.bins(x)
    total = model.logit(bins)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step = STEP * tree(np.bincount(bins[:, k], g, len(table)), np.bincount(bins[:, k], h, len(table)))
            table += step
            total += step[bins[:, k]]
    wide = [int(c[-1]) + 1 for c in model.coarse]
    cells = [c[bins[:, k]] for k, c in enumerate(model.coarse)]

    def grid(a, b, v):
        return np.bincount(cells[a] * wide[b] + cells[b], v, wide[a] * wide[b]).reshape(wide[a], wide[b])

    g, h = slopes()
    gains = sorted(((quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(len(wide)) for b in range(a + 1, len(wide))), reverse=True)
    model.pairs = [(a, b) for gain, a, b in gains[:PAIRS] if gain > 0]
    model.grids = [np.zeros((wide[a], wide[b])) for a, b in model.pairs]
    for _ in range(ROUNDS // 2):
        for (a, b), own in zip(model.pairs, model.grids, strict=True):
            g, h = slopes()
            step = STEP * quadrants(grid(a, b, g), grid(a, b, h))[1]
            own += step
            total += step[cells[a], cells[b]]
    return model


def counted(some: list[str]) -> np.ndarray:
    return np.array([stats(x) for x in some], dtype=np.int64).reshape(-1, len(NAMES))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model | float:
    """The model, or the share of label 1 where there is only one kind; texts are counted on the executors."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in texts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *map(pa.array, counted(some).T)], names=["doc_id", "label", *NAMES])

    found = sample(docs, labels, "quality", rows).mapInArrow(run, "doc_id long, label int, " + ", ".join(f"{n} long" for n in NAMES)).toPandas()
    found = found.sort_values(list(found.columns))
    model = train(found[list(NAMES)].to_numpy(), found["label"].to_numpy())
    return model if model else float(found["label"].mean()) if len(found) else 0.0


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and score (0 to 1) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    if isinstance(model, float):
        return rows.select(F.col("id").alias(id_col), F.lit(model).alias("score"))
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch, some in texts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.scores(counted(some)))], names=["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
