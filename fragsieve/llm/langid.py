"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's vector is the mean of the embeddings of the hashed character n-grams of
all its words; a softmax layer gives the languages. Both are trained together by
stochastic gradient descent. As the model is linear after the mean, scoring needs
one row of class values for each bucket. Temperature and rejection thresholds are
set on a part of the labelled rows that the descent does not see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytespans as B
from . import subwords as S
from .tables import texts

LOW, HIGH, BUCKETS, WIDTH = 2, 4, 1 << 16, 16


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Language, and the buckets of a text with their shares."""
    for part, data, offs in B.blocks(batches):
        words = S.Words(data, offs)
        owner, bucket = words.grams(LOW, HIGH, BUCKETS)
        entry, found = S.expanded(words.word, owner, words.n, bucket)
        both, count = np.unique(words.doc[entry] * BUCKETS + found, return_counts=True)
        cut = np.searchsorted(both // BUCKETS, np.arange(part.num_rows + 1))
        ids, share = (both % BUCKETS).astype("<i4"), count.astype("<f4")
        pieces = list(zip(cut, cut[1:], strict=False))
        yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([ids[a:b].tobytes() for a, b in pieces], pa.binary()), pa.array([share[a:b].tobytes() for a, b in pieces], pa.binary())], names=["lang", "buckets", "counts"])


class Model:
    """Class values by bucket, bias, languages, temperature, and the score that each language's predictions need."""

    def __init__(self, values: np.ndarray, bias: np.ndarray, langs: list[str], temperature: float = 1.0, needed: np.ndarray | None = None):
        self.values, self.bias, self.langs, self.temperature = values, bias, langs, temperature
        self.needed = np.zeros(len(langs)) if needed is None else needed


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, bytes, bytes]], epochs: int = 12, rate: float = 0.5, seed: int = 7, risk: float = 0.01) -> Model:
    """Descend on four fifths of the rows (in an order fixed by ``seed``), calibrate on the rest.

    ``risk``: a language's threshold is the least score above which at most this share of its calibration predictions is wrong.
    """
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model(np.zeros((BUCKETS, 0), np.float32), np.zeros(0), [])
    bags = [(langs.index(lang), np.frombuffer(b, "<i4"), np.frombuffer(c, "<f4")) for lang, b, c in rows]
    bags = [(y, b, c / c.sum()) for y, b, c in bags if len(b)]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    held, seen = order[: len(order) // 5], order[len(order) // 5 :]
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (WIDTH, len(langs))), np.zeros(len(langs))
    steps, done = max(1, epochs * len(seen)), 0
    for _ in range(epochs):
        for i in rng.permutation(seen):
            y, ids, share = bags[i]
            vector = share @ table[ids]
            error = _softmax(vector @ out + bias)
            error[y] -= 1
            step = rate * (1 - done / steps)
            back = out @ error
            out -= step * np.outer(vector, error)
            bias -= 0.1 * step * error
            # The mean's gradient is spread over a bag's rows in proportion to their shares; scaled up, as shares are small.
            table[ids] -= (step * min(len(ids), 200) * share[:, None] * back).astype(np.float32)
            done += 1
    model = Model((table @ out).astype(np.float32), bias, langs)
    if len(held):
        y = np.array([bags[i][0] for i in held])
        z = np.array([bags[i][2] @ model.values[bags[i][1]] + bias for i in held])
        loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 40), key=loss))
        p = _softmax(z / model.temperature)
        guess, score = p.argmax(axis=1), p.max(axis=1)
        for k in range(len(langs)):
            own = np.argsort(-score[guess == k])
            wrong = np.cumsum((y != guess)[guess == k][own]) / np.arange(1, len(own) + 1)
            fine = np.flatnonzero(wrong <= risk)
            model.needed[k] = score[guess == k][own][fine[-1]] if len(fine) else (1.0 if len(own) else 0.0)
    return model


def train(docs: DataFrame, per_lang: int = 800, parts: int = 3, held: int = 1, bound: int = 1_000_000) -> Model:
    """Fit on at most ``per_lang`` documents of each language (those with the least hash of their id) outside the held-out part."""
    known = docs.where(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % parts != held))
    # First by slices of a language, so that a frequent language isn't ranked in one task.
    key = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = known.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("slice"))
    for group in (["lang", "slice"], ["lang"]):
        drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*key))).where(F.col("nth") <= per_lang)
    drawn = drawn.select("doc_id").distinct()
    # A few hundred ids of each language; with very many languages the join is a shuffle.
    few = drawn.count() <= bound
    sample = known.join(F.broadcast(drawn) if few else drawn, "doc_id", "left_semi").select("lang", "text")
    return fit([(r["lang"], bytes(r["buckets"]), bytes(r["counts"])) for r in sample.mapInArrow(_bags, "lang string, buckets binary, counts binary").toLocalIterator()])


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` of every row of ``doc_id, text``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part, data, offs in B.blocks(batches):
            n = part.num_rows
            words = S.Words(data, offs)
            owner, bucket = words.grams(LOW, HIGH, BUCKETS)
            size = np.bincount(owner, minlength=max(words.n, 1))
            total = np.bincount(words.doc, weights=size[words.word], minlength=n)
            z = np.empty((n, len(m.langs)))
            for k in range(len(m.langs)):
                value = np.bincount(owner, weights=m.values[bucket, k], minlength=max(words.n, 1))
                z[:, k] = np.bincount(words.doc, weights=value[words.word], minlength=n) / np.maximum(total, 1) + m.bias[k]
            letters = np.zeros(n, bool)
            letters[np.searchsorted(offs, np.flatnonzero(S.ASCII_LETTERS[data]), "right") - 1] = True
            for i in np.flatnonzero(~letters):
                letters[i] = any(map(str.isalpha, part.column("text")[int(i)].as_py() or ""))
            if m.langs:
                p = _softmax(z / m.temperature)
                guess, score = p.argmax(axis=1), p.max(axis=1)
                accepted = letters & (score >= m.needed[guess])
                names = np.array(m.langs, object)[guess]
            else:
                letters[:] = False
                names, score, accepted = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.where(letters, names, "und"), pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(accepted)], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def languages(docs: DataFrame, per_lang: int = 800, parts: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` for every row of ``docs``.

    Held-out rows (a null id counts as one) are not learned from. Null texts and
    texts without a letter, and all texts where nothing could be learned, are
    ``und`` with score 0. ``accepted`` is the calibrated rejection: the score
    reaches what the language's predictions need. Equal rows get equal results;
    an empty table gives no rows; other columns are ignored.
    """
    wanted = texts(docs, id_col, text_col)
    with_lang = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    out = predictions(wanted, train(with_lang, per_lang, parts, held))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held, F.lit(True))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")
