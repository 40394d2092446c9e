"""Quality scores from naive Bayes support vectors.

Features are indicators of n-grams: byte trigrams (hashed) and repeats of a
word by the next. Each is scaled by its log-count ratio between the classes;
a linear hinge-loss model is fitted on them by dual coordinate descent and
drawn towards the ratios' mean weight, and a logistic curve, fitted on labelled
rows kept out of that fit, turns margins into scores.

Labels come only from rows whose crc32(doc_id) mod 5 is not 0, and from at most
``sample`` of these, chosen by a hash of doc_id; every document is scored.
Defined results: null text counts as empty and is scored like it; without
labelled rows of both classes every score is the share of label 1; repeated
rows each give a row; a doc_id with several labels counts as its lowest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import each_text, utf8

BITS = 18
_SIZE = 1 << BITS
_REPEATS = 4


def features(text: bytes) -> np.ndarray:
    """Sorted distinct feature numbers of a text; number 0 stands for none of its own and is always there."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    marks = np.zeros(_SIZE + _REPEATS + 1, bool)
    marks[0] = True
    if len(b) >= 3:
        grams = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        marks[(grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    words = text.split()
    if len(words) > 1:
        same = sum(map(bytes.__eq__, words, words[1:])) / (len(words) - 1)
        for i, share in enumerate((0.0, 0.05, 0.2, 0.5)):
            marks[_SIZE + i] = same > share
    return np.flatnonzero(marks).astype(np.int32)


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(t) for t in each_text(b)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "quality", "features"])


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    up, down = (np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == k]), minlength=_SIZE + _REPEATS + 1) + 1.0 for k in (1, -1))
    return np.log(up / up.sum()) - np.log(down / down.sum())


def fit_hinge(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, *, cost: float, rounds: int, seed: int = 0) -> np.ndarray:
    """Weights of the L2-regularised squared hinge loss, by dual coordinate descent (Hsieh et al. 2008)."""
    values = [ratio[r] / np.sqrt(len(r)) for r in rows]
    norms = np.array([v @ v for v in values]) + 0.5 / cost
    w, alpha, rng = np.zeros(len(ratio)), np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            gradient = labels[i] * (w[rows[i]] @ values[i]) - 1 + 0.5 * alpha[i] / cost
            new = max(0.0, alpha[i] - gradient / norms[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * labels[i] * values[i]
                alpha[i] = new
    return w


def fit_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets (Platt)."""
    up, down = (labels > 0).sum(), (labels < 0).sum()
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, np.log((up + 1) / (down + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, p * (1 - p) + 1e-9
        grad = np.array([(g * margins).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(a, 1e-6), b


class Model:
    def __init__(self, weights: np.ndarray, a: float, b: float):
        self.weights, self.a, self.b = weights, a, b

    def margin(self, row: np.ndarray) -> float:
        return float(self.weights[row].sum() / np.sqrt(len(row)))

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(features(text)) + self.b, -30, 30))))


def fit(rows: list[np.ndarray], quality: np.ndarray, *, cost: float = 1.0, rounds: int = 20, blend: float = 0.5) -> Model:
    labels = np.where(quality > 0, 1, -1)
    size = _SIZE + _REPEATS + 1
    if len(set(labels)) < 2:
        up = (labels > 0).sum()
        return Model(np.zeros(size), 1.0, float(np.log((up + 1) / (len(labels) - up + 1))))
    aside = np.arange(len(rows)) % 4 == 0
    if len(set(labels[~aside])) < 2 or len(set(labels[aside])) < 2:
        aside = np.zeros(len(rows), bool)
    train = [r for r, out in zip(rows, aside, strict=True) if not out]
    ratio = log_ratios(train, labels[~aside])
    w = fit_hinge(train, labels[~aside], ratio, cost=cost, rounds=rounds)
    w = (1 - blend) * np.abs(w[w != 0]).mean() * (w != 0) + blend * w
    model = Model(w * ratio, 1.0, 0.0)
    use = aside if aside.any() else ~aside
    margins = np.array([model.margin(r) for r, u in zip(rows, use, strict=True) if u])
    model.a, model.b = fit_curve(margins, labels[use])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 6000) -> Model:
    """The model; at most ``sample`` labelled documents leave the executors, each as the distinct numbers of its features (BITS bounds them).

    Rows that share a doc_id count once, with the smallest of their texts.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = marked.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    picked = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # the sample bounds both
    rows = picked.mapInArrow(_extract, "doc_id long, quality int, features array<int>")
    held = rows.select("doc_id", "quality", "features").toArrow()
    order = np.argsort(held.column("doc_id").to_numpy(), kind="stable")
    quality = held.column("quality").to_numpy()[order]
    lists = [c.values.to_numpy()[i:j] for c in held.column("features").chunks for i, j in pairwise(c.offsets.to_numpy())]
    return fit([lists[i] for i in order], quality)


def _scorer(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(t) for t in each_text(b)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), pa.array(scores, pa.float64())], [*(c for c in b.schema.names if c != "text"), "score"])

    return run


def score_quality(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), utf8(F.col("text")).alias("text"))
    scored = rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _keeper(model: Model, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [model.score((x.as_py() or "").encode()) >= threshold for x in b.column("text")]
            yield b.filter(pa.array(good, pa.bool_()))

    return run


def keep_good(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    return docs.mapInArrow(_keeper(model, threshold), docs.schema)
