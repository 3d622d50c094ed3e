import numpy as np

from fragsieve.llm.additive_ann import search


def brute(rows, every, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good.items():
        if q % every == 0:
            near = sorted((-float(v @ w), i) for i, w in good.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, rank string, score int")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 32))
    x = (centers[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 32))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = brute(rows, 20, 20), {}
    for r in search(table(spark, rows), sample=1500, short=120).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        assert abs(r.score - float(x[r.query_id].astype(float) @ x[r.vec_id].astype(float))) < 1e-9
    assert sorted(got) == sorted(want) and all(sorted(v) == list(range(1, 21)) for v in got.values())
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q].values()}) / 20 for q in want]) >= 0.95


def test_ties_copies_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5]) for i in range(70)] + [(100 + i, [1.0, float(i % 4)]) for i in range(30)]
    rows += [(200, None), (201, [0.0, 0.0]), (202, [1.0, nan]), (203, [inf, 1.0]), (204, [1.0, None]), (None, [1.0, 1.0]), (0, [1.0, 0.5]), (205, [1.0])]
    want = brute([r for r in rows if r[0] != 205], 20, 20)
    got = {}
    for r in search(table(spark, rows), every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_few_or_no_rows(spark):
    assert search(table(spark, [(0, [1.0])]).where("false")).collect() == []
    assert search(table(spark, [(0, [1.0, 2.0])])).collect() == []
    assert [tuple(r) for r in search(table(spark, [(0, [1.0, 2.0]), (1, [3.0, 1.0])])).collect()] == [(0, 1, 1, 5.0)]


def test_each_dimension_is_searched_by_itself(spark):
    two, three = [(i, [float(i + 1), 1.0]) for i in range(40)], [(100 + i, [1.0, float(i), 2.0]) for i in range(30)]
    got = {}
    for r in search(table(spark, two + three)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(two, 20, 20) | brute(three, 20, 20) and len(got) == 4


def _recall(spark, x):
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = brute(rows, 20, 20), {}
    for r in search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return [len({i for i, _ in want[q]} & got[q]) / 20 for q in want]


def test_recall_at_any_magnitude(spark):
    """With the query's own parameters, at two sizes: all vectors scaled alike, one much longer, and all by different powers of ten."""
    rng = np.random.default_rng(4)
    for n, d in ((1500, 64), (4000, 32)):
        x = rng.normal(size=(n, d)).astype(np.float32).astype(float)
        one = x.copy()
        one[77] *= 1e25
        mixed = x * 10.0 ** rng.integers(-25, 26, n)[:, None]
        for y in (x, x * 1e-25, x * 1e25, one, mixed, x * 1e-150) if n == 1500 else (x, one):
            assert np.mean(_recall(spark, y)) >= 0.9


def test_a_negative_neighbour_beside_longer_vectors(spark):
    """The 20 nearest of a query that all long vectors point away from are short ones."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    x[:300] = -abs(x[:300]) * 1e30
    x[300:] = abs(x[300:])
    x[0] = abs(x[0])
    assert min(_recall(spark, x)) >= 0.9
