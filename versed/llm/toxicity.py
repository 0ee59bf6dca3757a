"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of learned vectors at three hashes: two of the word and one of its first letters. Filters
of widths 1 to 3 slide over a document, each is pooled by its maximum, and a linear layer gives the logit. Vectors of
buckets that few training documents have stay zero, so that chance collisions of rare words don't count. Thresholds are
calibrated by language, which is told from the text's own frequent words, and scores are rescaled so that 0.5 is the
language's threshold.

The classifier is fitted on the driver on a bounded sample: SAMPLE labelled documents at most, those with the least hashes
of doc_id, of which texts of more than LONGEST bytes aren't learned from, so that the driver gets SAMPLE x LONGEST bytes at
most. Every document is scored whole, in bounded Arrow batches, in one pass without a shuffle.

Defined cases: a null text counts as empty; a text without words pools to nothing and gets the score of the bias alone;
of several labels of a doc_id the larger counts, and of several texts the least is learned from; with no labels, or one kind, the score is that share (0 without any);
repeated rows get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versed.llm.common import bounded_batches, fold, number, texts, unique_labels, whole_text

#: Labelled documents to learn from at most, and the bytes of a text that is learned from.
SAMPLE, LONGEST = 8_000, 16_384
#: Buckets, size of a vector, filters of each width, widths, training documents that a bucket needs, letters of a beginning.
BUCKETS, SIZE, FILTERS, WIDTHS, LEAST, LETTERS = 1 << 20, 8, 6, (1, 2, 3), 3, 4
#: Steps of learning, texts in a step, rate; kept texts of label 1 that a language's own threshold needs.
EPOCHS, GROUP, RATE = 8, 64, 0.15
FEW = 8

WORD = re.compile(r"[^\W\d_]+").findall
#: Frequent words by which a text's language is told.
LANGUAGES = {
    "en": frozenset("the of and to is that it was for on are as with be at by this have from".split()),
    "de": frozenset("der die das und ist nicht mit den von sich ein eine auf im dem zu".split()),
    "fr": frozenset("le les des et est une que pour dans qui du au sur un la en".split()),
    "es": frozenset("el los las y es una del con para por se no su lo que de".split()),
}


def hashes(word: str) -> tuple[int, int, int]:
    data = word.encode()
    whole = zlib.crc32(data)
    return whole % BUCKETS, zlib.crc32(data, 0x9E3779B9) % BUCKETS, zlib.crc32(word[:LETTERS].encode(), 0x51ED270B) % BUCKETS


class Numbers(dict):
    """Words and their numbers in order of appearance; 0 is the gap between texts."""

    def __init__(self):
        super().__init__({"": 0})

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


@dataclass
class Batch:
    """Texts as numbers of their distinct words, with room after each text that no window may start in."""

    ids: np.ndarray
    starts: np.ndarray
    pad: np.ndarray
    numbers: Numbers
    languages: list[str]  # of each text, the one most of whose frequent words occur; the first of them if none does

    @classmethod
    def of(cls, some: list[str], numbers: Numbers | None = None) -> Batch:
        numbers = Numbers() if numbers is None else numbers
        ids, starts, gap = [], [], [0] * max(WIDTHS)
        for text in some:
            starts.append(len(ids))
            ids += map(numbers.__getitem__, WORD(text.lower()))
            ids += gap
        flat, begin = np.array(ids, dtype=np.int64), np.array(starts, dtype=np.int64)
        most, names = np.zeros((len(LANGUAGES), len(begin))), list(LANGUAGES)
        for k, name in enumerate(names):
            own = np.zeros(len(numbers), dtype=np.int32)
            own[[numbers[w] for w in LANGUAGES[name] if w in numbers]] = 1
            most[k] = np.add.reduceat(own[flat], begin)
        return cls(flat, begin, flat == 0, numbers, [names[k] for k in most.argmax(axis=0)])


@dataclass
class Model:
    rows: np.ndarray  # of a bucket, its row in vectors; 0 is none
    vectors: np.ndarray
    filters: list[np.ndarray]  # by width: (width, SIZE, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float]

    def places(self, words: list[str]) -> np.ndarray:
        return self.rows[np.array([hashes(w) for w in words], dtype=np.int64).reshape(-1, 3)]

    def responses(self, vectors: np.ndarray) -> list[list[np.ndarray]]:
        """What each word adds to the filters, by width and place in the window."""
        return [[vectors @ part for part in parts] for parts in self.filters]

    def pooled(self, batch: Batch, responses: list[list[np.ndarray]], keep: list | None = None) -> np.ndarray:
        """By text, the filters' maxima (0 at least); keep gets all responses."""
        out = np.zeros((len(batch.starts), FILTERS * len(WIDTHS)), dtype=np.float32)
        for k, width in enumerate(WIDTHS):
            z = responses[k][0][batch.ids]
            for step in range(1, width):
                z[:-step] += responses[k][step][batch.ids[step:]]
            z += self.biases[k]
            z[batch.pad] = -1e9
            out[:, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(z, batch.starts, axis=0)
            if keep is not None:
                keep.append(z)
        return np.maximum(out, 0)

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((pooled @ self.out + self.bias).astype(np.float64), -30, 30)))

    def scores(self, some: list[str], words: Words | None = None) -> tuple[np.ndarray, list[str]]:
        """Scores before calibration, and languages."""
        words = words or Words(self)
        batch = words.batch(some)
        return self.raw(self.pooled(batch, words.responses)), batch.languages

    def calibrated(self, some: list[str], words: Words | None = None) -> np.ndarray:
        score, languages = self.scores(some, words)
        t = np.array([self.thresholds.get(x, 0.5) for x in languages])
        return np.where(score < t, 0.5 * score / t, 0.5 + 0.5 * (score - t) / (1 - t))


class Words:
    """Numbers and responses of the words that a worker has met; anew beyond MOST, which bounds memory and changes no score."""

    MOST = 200_000

    def __init__(self, model: Model):
        self.model, self.numbers = model, Numbers()
        self.responses = model.responses(np.zeros((1, SIZE), dtype=np.float32))

    def batch(self, some: list[str]) -> Batch:
        if len(self.numbers) > self.MOST:
            self.__init__(self.model)
        have = len(self.responses[0][0])
        batch = Batch.of(some, self.numbers)
        if len(self.numbers) > have:
            new = self.model.vectors[self.model.places(list(self.numbers)[have:])].sum(axis=1)
            added = self.model.responses(new)
            self.responses = [[np.concatenate([x, y]) for x, y in zip(a, b, strict=True)] for a, b in zip(self.responses, added, strict=True)]
        return batch


def known(some: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the buckets that enough of the texts have, and by row the smoothed log-odds of label 1, where learning starts."""
    count = np.zeros((2, BUCKETS), dtype=np.int32)
    for text, y in zip(some, labels, strict=True):
        count[int(y), np.unique(np.array([hashes(w) for w in set(WORD(text.lower()))] or [()], dtype=np.int64))] += 1
    rows = np.zeros(BUCKETS, dtype=np.int32)
    found = np.flatnonzero(count.sum(axis=0) >= LEAST)
    rows[found] = np.arange(1, len(found) + 1)
    share = labels.mean()
    odds = np.log((count[1, found] + 4 * share) / (count[0, found] + 4 * (1 - share))) - np.log(share / (1 - share))
    return rows, np.append(0.0, odds)


def gradients(model: Model, batch: Batch, at: np.ndarray, y: np.ndarray, rise: float) -> tuple[dict, float, tuple[np.ndarray, np.ndarray]]:
    """Slopes of the mean logistic loss, where label 1 weighs `rise`: of the arrays (o, and by width f and c), the bias, and the vectors (rows and slopes). at: rows of the words' vectors."""
    vectors, kept = model.vectors[at].sum(axis=1), []
    h = model.pooled(batch, model.responses(vectors), kept)
    p = 1 / (1 + np.exp(-np.clip(h @ model.out + model.bias, -30, 30)))
    d = ((p - y) * np.where(y > 0, rise, 1) / len(y)).astype(np.float32)
    slopes = {"o": h.T @ d}
    back = d[:, None] * model.out * (h > 0)
    moved = np.zeros_like(vectors)
    own = np.repeat(np.arange(len(batch.starts)), np.diff(np.append(batch.starts, len(batch.ids))))
    for k, width in enumerate(WIDTHS):
        z, part = kept[k], back[:, k * FILTERS : (k + 1) * FILTERS]
        top = h[:, k * FILTERS : (k + 1) * FILTERS]
        texts_, which = np.nonzero(part)
        slopes["f", k], slopes["c", k], grad = np.zeros_like(model.filters[k]), part.sum(axis=0), part[texts_, which]
        best = np.full((len(batch.starts), FILTERS), -1, dtype=np.int64)
        where, f = np.nonzero((z > 0) & (z == top[own]))
        best[own[where[::-1]], f[::-1]] = where[::-1]  # of places with the maximum, the first
        spot = best[texts_, which]
        for step in range(width):
            word = batch.ids[spot + step]
            np.add.at(slopes["f", k][step].T, which, grad[:, None] * vectors[word])
            np.add.at(moved, word, grad[:, None] * model.filters[k][step][:, which].T)
    words = np.flatnonzero(moved.any(axis=1))
    rows, inverse = np.unique(at[words], return_inverse=True)
    total = np.zeros((len(rows), SIZE), dtype=np.float32)
    np.add.at(total, inverse.ravel(), np.repeat(moved[words], 3, axis=0))
    return slopes, float(d.sum()), (rows, total)


def train(some: list[str], labels: np.ndarray, seed: int = 5) -> Model | None:
    """Fit by Adagrad; a fifth of the texts is kept to set the thresholds. None if the labels are of one kind."""
    labels = np.asarray(labels, dtype=np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    held = np.arange(len(some)) % 5 == 4
    use = np.flatnonzero(~held)
    rows, odds = known([some[i] for i in use], labels[use])
    f32 = np.float32
    model = Model(
        rows, rng.normal(0, 0.1, (int(rows.max()) + 1, SIZE)).astype(f32), [rng.normal(0, 0.4, (w, SIZE, FILTERS)).astype(f32) for w in WIDTHS],
        [np.zeros(FILTERS, dtype=f32) for _ in WIDTHS], np.abs(rng.normal(0.5, 0.2, FILTERS * len(WIDTHS))).astype(f32), -2.0, {},
    )
    model.vectors[:, 0] = 0.3 * odds
    model.vectors[0] = 0
    for x in model.filters:
        x[0, 0] = np.abs(x[0, 0])
    arrays = {"o": model.out} | {("f", k): x for k, x in enumerate(model.filters)} | {("c", k): x for k, x in enumerate(model.biases)}
    squares = {name: np.full(x.shape, 1e-3, dtype=f32) for name, x in (arrays | {"v": model.vectors}).items()} | {"b": 1e-3}
    rise = float(np.sqrt((labels[use] == 0).sum() / max(1, labels[use].sum())))
    use = use[np.argsort([len(some[i]) for i in use], kind="stable")]
    groups = [Batch.of([some[i] for i in use[k : k + GROUP]]) for k in range(0, len(use), GROUP)]
    targets = [labels[use[k : k + GROUP]] for k in range(0, len(use), GROUP)]
    places = [np.concatenate([np.zeros((1, 3), dtype=np.int32), model.places(list(b.numbers)[1:])]) for b in groups]
    for _ in range(EPOCHS):
        for g in rng.permutation(len(groups)):
            slopes, bias, (rows_, total) = gradients(model, groups[g], places[g], targets[g], rise)
            for name, slope in slopes.items():
                squares[name] += slope**2
                arrays[name] -= RATE * slope / np.sqrt(squares[name])
            squares["b"] += bias**2
            model.bias -= RATE * bias / squares["b"] ** 0.5
            squares["v"][rows_] += total**2
            model.vectors[rows_] -= RATE * total / np.sqrt(squares["v"][rows_])
            model.vectors[0] = 0
    model.thresholds = thresholds(model, [some[i] for i in np.flatnonzero(held)], labels[held])
    return model


def thresholds(model: Model, some: list[str], labels: np.ndarray) -> dict[str, float]:
    """By language, of the thresholds that give the best F1 on the kept texts, the one nearest to 0.5; all texts count together where a language has few of label 1."""
    score, languages = [], []
    for k in range(0, len(some), 256):
        s, found = model.scores(some[k : k + 256])
        score += s.tolist()
        languages += found
    score, own, toxic = np.array(score), np.array(languages), labels > 0

    def best(s: np.ndarray, y: np.ndarray) -> float:
        cuts = np.unique(np.concatenate([[0.0, 0.5, 1.0], s]))
        cuts = np.append((cuts[1:] + cuts[:-1]) / 2, 0.5)
        f1 = np.array([2 * (y & (s >= c)).sum() / max(1, y.sum() + (s >= c).sum()) for c in cuts])
        cuts = cuts[f1 >= f1.max() - 1e-9]
        return float(np.clip(cuts[np.abs(cuts - 0.5).argmin()], 0.2, 0.8))

    overall = best(score, toxic) if toxic.any() else 0.5
    return {k: best(score[own == k], toxic[own == k]) if toxic[own == k].sum() >= FEW else overall for k in LANGUAGES}


def sample(docs: DataFrame, labels: DataFrame, name: str, rows: int = SAMPLE, longest: int | None = None) -> DataFrame:
    """doc_id, text and label of at most `rows` labelled documents outside the held-out fold, those with the least hashes of doc_id, one row each; without texts of more than `longest` bytes."""
    own = docs.select(number(F.col("doc_id")).alias("doc_id"), whole_text().alias("text"))
    if longest is not None:
        own = own.where(F.octet_length("text") <= longest)
    there = own.select("doc_id").distinct()  # ids alone are shuffled; documents that are absent or too long take no place in the sample
    chosen = unique_labels(labels, name).where(fold() != 0).join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))  # at most `rows` rows are broadcast


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, longest: int = LONGEST) -> Model | float:
    """The classifier, or the share of label 1 where there is only one kind."""
    found = sample(docs, labels, "toxic", rows, longest).toPandas().sort_values("doc_id")
    model = train(found["text"].tolist(), found["label"].to_numpy())
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
        words = Words(own)
        for batch, some in texts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.calibrated(some, words))], names=["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def verdict(at: float) -> Column:
    return F.when(F.col("score") >= at, 1).otherwise(0).alias("predicted")
