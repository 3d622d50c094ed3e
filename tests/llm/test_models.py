import math
import pickle
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragsieve.llm import bytespans as B
from fragsieve.llm import langid, toxicity

LANGS = {"xx": "ba da ga lo mi", "yy": "stra krü plö ßen sch", "zz": "ñez ción asa oie uel"}


def corpus(spark, n=600, seed=5):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(sorted(LANGS))
        w = ["".join(rng.choice(LANGS[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([8, 40, 150]))]
        toxic = int(rng.random() < 0.3)
        for _ in range(rng.randint(2, 5) * toxic):
            w[rng.randrange(len(w))] = rng.choice(["nastyword", "Vileness", "grumpfool"])
        docs.append((i, " ".join(w), lang if rng.random() < 0.9 else None, "s", toxic))
        if rng.random() < 0.8:
            labels.append((i, toxic, 1))
    docs += [(n, None, None, "s", 0), (n + 1, "", "xx", "s", 0), (n + 2, "12 34 !!", "xx", "s", 0), (n + 3, "ba da " * 20000, "xx", "s", 0), (5, docs[5][1], docs[5][2], "s", docs[5][4])]
    labels += [(3, None, 1), (None, 1, 1), (4, labels[0][1], 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string, truth int").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int, text int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    truth = {r.doc_id: r.truth for r in docs.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in rows if not r.predicted)


def test_toxicity_is_fitted_in_a_task_whatever_the_order_of_rows(spark, monkeypatch):
    docs, labels = corpus(spark)

    def in_driver(*_):
        raise AssertionError("fitted in the driver")

    monkeypatch.setattr(toxicity, "fit", in_driver)
    monkeypatch.setattr(toxicity, "calibrated", in_driver)
    one, other = (toxicity.train(rows.select("doc_id", "text"), labels) for rows in (docs, docs.repartition(7, "doc_id")))
    assert np.count_nonzero(one.weights) and np.array_equal(one.weights, other.weights) and one.intercept == other.intercept
    sent = pickle.dumps(one)
    assert len(sent) < 10_000 + 20 * np.count_nonzero(one.weights)
    again = pickle.loads(sent)
    assert np.array_equal(again.weights, one.weights) and again.intercept == one.intercept


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = corpus(spark, 20)
    assert {r.predicted for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0}
    assert len(toxicity.toxicity(docs, labels.where("toxic = 1")).collect()) == docs.count()
    assert toxicity.toxicity(docs.where("false"), labels).collect() == []


def test_languages_on_held_out_rows(spark):
    docs, _ = corpus(spark)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.languages(docs).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and truth[r.doc_id] and r.doc_id < 600]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert {r.lang_pred for r in rows if r.doc_id in (600, 601, 602)} == {"und"}
    assert sum(r.accepted for r in rows) > 0.8 * len(rows)


def test_languages_without_any(spark):
    docs, _ = corpus(spark, 20)
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.languages(none).collect()} == {("und", 0.0)}
    assert langid.languages(docs.where("false")).collect() == []


def plain_grams(text, low, high, buckets):
    """Buckets of all character n-grams of all words of a text, one at a time."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    for word in re.findall(rb"['0-9A-Za-z\x80-\xff]+", raw):
        chars = [0x110000, *map(ord, word.decode()), 0x110000]
        for n in range(low, high + 1):
            for i in range(len(chars) - n + 1):
                yield int(B.gram_hashes(np.array(chars[i : i + n], np.uint64), n)[0]) % buckets


TEXTS = [None, "", "12 !!", "Das ist ein kürzerer Text's mit Wörtern", "plain words here, plain words there", "日本 語", "a", "Same TEXT", "same text", "ñ" * 300]


def test_scores_equal_a_plain_scorer(spark):
    rng = np.random.default_rng(1)
    model = toxicity.Model(np.where(rng.random(toxicity.BUCKETS) < 0.5, rng.normal(0, 0.1, toxicity.BUCKETS), 0).astype(np.float32), -0.3)
    df = spark.createDataFrame([(i, t or "") for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in toxicity.scores(df, model).collect():
        z = -0.3 + sum(float(model.weights[b]) for b in set(plain_grams(TEXTS[r.doc_id], toxicity.LOW, toxicity.HIGH, toxicity.BUCKETS)))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_predictions_equal_a_plain_scorer(spark):
    rng = np.random.default_rng(2)
    langs = ["aa", "bb", "cc"]
    model = langid.Model(rng.normal(0, 3, (langid.BUCKETS, 3)).astype(np.float32), np.array([0.1, -0.2, 0.0]), langs, 0.7, np.array([0.4, 0.6, 0.5]))
    df = spark.createDataFrame([(i, t or "") for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in langid.predictions(df, model).collect():
        if not re.search(r"[^\W\d_]", TEXTS[r.doc_id] or ""):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        count = Counter(plain_grams(TEXTS[r.doc_id], langid.LOW, langid.HIGH, langid.BUCKETS))
        z = [sum(c * float(model.values[b, k]) for b, c in count.items()) / count.total() + model.bias[k] for k in range(3)]
        e = [math.exp((v - max(z)) / 0.7) for v in z]
        best = max(range(3), key=lambda k: e[k])
        assert r.lang_pred == langs[best] and r.score == pytest.approx(e[best] / sum(e), abs=1e-6) and r.accepted == (r.score >= model.needed[best])


def test_rows_without_an_id_are_held_out(spark):
    docs = spark.createDataFrame([(None, "ba da ga", "xx"), (1, "stra krü", "yy")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r.doc_id: r.held_out for r in toxicity.toxicity(docs, labels).collect()}[None] is True
    assert {r.doc_id: r.held_out for r in langid.languages(docs).collect()}[None] is True


def test_calibration_is_that_of_texts_left_out():
    rng = np.random.default_rng(3)
    z = rng.normal(0, 1, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(3 * z - 1)))).astype(float)
    slope, intercept = toxicity.line(z, y)
    assert slope == pytest.approx(3, abs=0.4) and intercept == pytest.approx(-1, abs=0.3)
    assert all(map(math.isfinite, toxicity.line(np.array([-1.0, 1.0]), np.array([0.0, 1.0]))))
