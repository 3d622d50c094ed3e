"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence in a text of a character n-gram of a word. Its value is
the log ratio of its smoothed shares among toxic and other labelled texts; a
logistic regression is fitted on these values. Only features seen in several
labelled texts and with a ratio away from zero are kept, so a text's score hangs
on few sums. The fit is a shrunken one, whose sums are too close to zero: slope and
intercept of the final score are fitted to sums of texts that were left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytespans as B
from . import subwords as S
from .tables import texts, written

LOW, HIGH, BUCKETS = 3, 6, 1 << 20


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, toxic`` and the distinct buckets of each text."""
    for part, data, offs in B.blocks(batches):
        words = S.Words(data, offs)
        pair = np.unique(words.doc * max(words.n, 1) + words.word)
        entry, bucket = S.expanded(pair % max(words.n, 1), *_by_word(words))
        both = np.unique((pair // max(words.n, 1))[entry] * BUCKETS + bucket)
        cut = np.searchsorted(both // BUCKETS, np.arange(part.num_rows + 1))
        found = (both % BUCKETS).astype("<i4")
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array([found[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], names=["doc_id", "toxic", "buckets"])


def _by_word(words: S.Words) -> tuple[np.ndarray, int, np.ndarray]:
    owner, bucket = words.grams(LOW, HIGH, BUCKETS)
    return owner, words.n, bucket


class Model:
    """Weights by feature (0: not used), and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def __reduce__(self):
        """Only features that are used are sent."""
        used = np.flatnonzero(self.weights).astype(np.int32)
        return _model, (used, self.weights[used], self.intercept)


def _model(features: np.ndarray, values: np.ndarray, intercept: float) -> Model:
    weights = np.zeros(BUCKETS, np.float32)
    weights[features] = values
    return Model(weights, intercept)


def fit(rows: list[tuple[int, bytes]], rounds: int = 300, ridge: float = 5.0, least: int = 4, ratio: float = 0.7) -> Model:
    """Fit on ``(label, buckets)``."""
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(max(rate, 1e-6) / (1 - rate))) if rate < 1 else 14.0)
    x = [np.frombuffer(r[1], "<i4") for r in rows]
    one, zero = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for label, own in zip(y, x, strict=True):  # the buckets of a text are distinct
        (one if label else zero)[own] += 1
    # Presence in texts: shares of the texts of each class.
    names = np.flatnonzero(one + zero >= least)
    scale = np.log((one[names] + 1) / (y.sum() + 2)) - np.log((zero[names] + 1) / ((1 - y).sum() + 2))
    use = np.abs(scale) >= ratio
    names, scale = names[use], scale[use]
    place = np.full(BUCKETS, -1, np.int32)
    place[names] = np.arange(len(names))
    x = [place[own][place[own] >= 0] for own in x]
    row, col = np.repeat(np.arange(len(x)), [len(own) for own in x]), np.concatenate(x)
    value = scale[col]
    w, b = np.zeros(len(names)), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[col] * value, minlength=len(y)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(col, weights=error[row] * value, minlength=len(w)) + ridge * w / len(y)
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.02 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v) + 1e-12)
        b -= rate * mb / (np.sqrt(vb) + 1e-12)
    return _model(names, w * scale, float(b))


def line(z: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of the logistic fit of labels ``y`` to sums ``z``, by Newton's method; a prior of one text of each label on either side keeps them finite."""
    edge = 1 + np.abs(z).max(initial=0)
    z, y = np.r_[z, edge, edge, -edge, -edge], np.r_[y, 1, 0, 1, 0]
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]], [((p - y) * z).sum(), (p - y).sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def sums(model: Model, rows: list[tuple[int, bytes]]) -> np.ndarray:
    return np.array([float(model.weights[np.frombuffer(b, "<i4")].sum()) for _, b in rows]) + model.intercept


def calibrated(rows: list[tuple[int, bytes]], share: float | None = None, folds: int = 4) -> Model:
    """The fit on all rows, on the scale that sums have for rows that were left out (every ``folds``-th of each label).

    ``share`` is that of label 1 where the rows are drawn from, if it differs from theirs.
    """
    model, y = fit(rows), np.array([r[0] for r in rows], float)
    if min(y.sum(), len(y) - y.sum()) < 2 * folds:
        return model
    fold = np.zeros(len(y), int)
    for label in (0, 1):
        fold[y == label] = np.arange(int((y == label).sum())) % folds
    z = np.zeros(len(y))
    for k in range(folds):
        z[fold == k] = sums(fit([r for r, f in zip(rows, fold, strict=True) if f != k]), [r for r, f in zip(rows, fold, strict=True) if f == k])
    slope, intercept = line(z, y)
    if slope <= 0:
        return model
    if share is not None:
        intercept += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return Model((model.weights * slope).astype(np.float32), model.intercept * slope + intercept)


def _fitted(batches: Iterator[pa.RecordBatch], share: float | None) -> pa.RecordBatch:
    """``feature, weight`` of the fit on all rows of ``toxic, buckets``; the intercept has feature -1."""
    rows = [(y, bag) for batch in batches for y, bag in zip(batch.column("toxic").to_pylist(), batch.column("buckets").to_pylist(), strict=True)]
    model = calibrated(rows, share)
    used = np.flatnonzero(model.weights)
    return pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used].astype(np.int32)), pa.array(np.r_[model.intercept, model.weights[used].astype(float)])], names=["feature", "weight"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, parts: int = 5) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class, those with the least hash of their id.

    Labels count only where the remainder of the id's crc32 by ``parts`` is not 0.
    A document with several labels is toxic if one of them says so. One task fits,
    on rows in order of their ids, so that only the weights pass through the driver.
    """
    known = written(
        labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % parts != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = None
    for label in (0, 1):
        own = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = own if drawn is None else drawn.unionByName(own)
    # At most twice ``per_class`` ids: bounded, whatever the size of the tables.
    sample = docs.join(F.broadcast(drawn), "doc_id")
    bags = sample.mapInArrow(_features, "doc_id long, toxic int, buckets binary").repartition(1).sortWithinPartitions("doc_id", "toxic", "buckets").select("toxic", "buckets")
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total and 0 < counts.get(1, 0) < total else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _fitted(batches, share)

    found = bags.mapInArrow(run, "feature int, weight double").toArrow()
    feature, weight = (found.column(c).to_numpy() for c in ("feature", "weight"))
    # A plan without rows may have no task.
    return _model(feature[feature >= 0], weight[feature >= 0], float(weight[feature < 0][0])) if len(feature) else fit([])


def _score(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    words = S.Words(data, offs)
    owner, n, bucket = _by_word(words)
    used = model.weights[bucket] != 0
    owner, bucket = owner[used], bucket[used]
    telling = np.zeros(max(n, 1), bool)
    telling[owner] = True
    at = telling[words.word] if n else np.zeros(0, bool)
    entry, found = S.expanded(words.word[at], owner, n, bucket)
    both = np.unique(words.doc[at][entry] * BUCKETS + found)
    z = np.bincount(both // BUCKETS, weights=model.weights[both % BUCKETS], minlength=len(offs) - 1) + model.intercept
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``doc_id, text``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in B.blocks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_score(sent.value, data, offs))], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) whose score is below ``limit``; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(train(texts(docs, text_col=text_col), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in B.blocks(batches, text_col):
            yield part.filter(pa.array(_score(sent.value, data, offs) < limit))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 3000, parts: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    ``held_out`` rows give no labels to learn from (a null id counts as held out).
    Null and empty texts get the score of a text without features; equal rows get
    equal scores; without labels, or with one class only, all scores are its
    smoothed rate; an empty table gives no rows; other columns are ignored.
    """
    docs = texts(docs, id_col, text_col)
    out = scores(docs, train(docs, labels, per_class, parts))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
