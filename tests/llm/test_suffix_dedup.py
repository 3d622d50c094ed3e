import hashlib
import random

import numpy as np
import pytest

from fragsieve.llm import suffix_dedup as D


def brute(docs, length):
    seen = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for _, b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for d, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs, **more):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, name string, key int")
    return sorted(map(tuple, D.remove_repeats(df.repartition(3), **more).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [some(n) for n in (39, 40, 41, 60, 90, 150)]
    docs = [some(rng.randint(0, 80)) + rng.choice(passages) + some(rng.randint(0, 60)) + rng.choice(passages)[: rng.randint(30, 150)] + some(10) for _ in range(60)]
    base = some(400)
    for _ in range(15):
        v = list(base)
        for _ in range(rng.randint(1, 6)):
            v[rng.randrange(len(v))] = rng.choice("xyz")
        docs.append("".join(v))
    docs += [None, "", "a" * 39, "a" * 300, "ab" * 100, base, base, passages[2] * 3, some(20), passages[1], "q" * 40, "q" * 41]
    return list(enumerate(docs)) + [(7, base), (None, passages[3])]


@pytest.mark.parametrize(("most", "share", "bound"), [(20_000, 2_000, 200_000), (3, 50, 0)])
def test_equals_brute_force(spark, most, share, bound):
    for seed in (1, 2)[: 2 if most > 3 else 1]:
        docs = corpus(seed)
        assert run(spark, docs, length=40, gram=12, most=most, share=share, bound=bound) == brute(docs, 40)


def test_production_length_and_no_rows(spark):
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p = some(260)
    docs = [(1, some(50) + p + some(700)), (2, some(500) + p[:200] + some(90)), (3, some(30) + p[30:229] + some(30)), (4, some(5000)), (5, "z" * 900)]
    assert run(spark, docs) == brute(docs, 200)
    assert run(spark, []) == []
    assert [r[:4] for r in run(spark, [(1, None)])] == [(1, 0, 0, 0)]


@pytest.mark.parametrize("bound", [0, 200_000])
def test_copies_are_judged_once_and_other_texts_stay(spark, bound):
    """A third of the rows are one text, and most of the others have nothing to remove; no shuffle to the results carries a text."""
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    copied, passage = some(900), some(90)
    docs = [(i, copied if i % 3 == 0 else some(30) + passage + some(30) if i % 30 == 1 else some(150)) for i in range(300)]
    assert run(spark, docs, length=40, gram=12, bound=bound) == brute(docs, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = D.remove_repeats(df, length=40, gram=12, bound=bound)._jdf.queryExecution().optimizedPlan().children().head().children().head()
    assert {left.output().apply(i).name() for i in range(left.output().size())} == {"doc_id", "name", "n_bytes", "whole"}


def test_suffix_order_is_lexicographic():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    start = np.arange(300)
    end = np.minimum(start + rng.integers(1, 90, 300), 400)
    raw = data.tobytes()
    got = D.Suffixes(data, start, end).order().tolist()
    assert got == sorted(range(300), key=lambda i: (raw[start[i] : end[i]], i))


def test_a_wrong_order_is_seen_and_mended(monkeypatch):
    data = np.frombuffer(b"abracadabra" * 3, np.uint8)
    start, end = np.arange(30), np.full(30, 33)
    whole = D.Suffixes(data, start, end)
    want = whole.order()
    assert whole.verified(want) and not whole.verified(want[::-1])
    monkeypatch.setattr(D.B, "span_hashes", lambda prefix, a, b: np.zeros(len(a), np.uint64))  # all spans collide
    assert (D.Suffixes(data, start, end).order() == want).all()
