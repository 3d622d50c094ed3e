import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fragsieve.llm import ngram_join as module
from fragsieve.llm.ngram_join import forest, ngram_join, products


def brute(docs, size=4, percent=85):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def run(spark, docs):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, key string")
    return sorted(map(tuple, ngram_join(df.repartition(3)).collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["É", "Ä b"]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passage, docs = some(60), []
    for _ in range(12):
        base = some(rng.choice([3, 8, 30, 80, 150]))
        for _ in range(rng.randint(1, 8)):
            v = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                v[rng.randrange(len(v))] = rng.choice(words)
            docs.append(" ".join(v) if rng.random() < 0.7 else "\t\n".join(v).upper())
    chain = some(120)
    for i in range(25):  # neighbours are similar, ends aren't
        docs.append(" ".join(chain[i : i + 90]))
    docs += [" ".join(some(20) + passage + some(20)) for _ in range(40)] + [None, "", " \n", "a", "A", "a b", "b a", "same text here today", "same text here today"]
    rng.shuffle(docs)
    rows = [(i * 3, t) for i, t in enumerate(docs)] + [(7, "long " * 9000), (8, "long " * 9001), (8, "long " * 9001), (None, "only me here with null"), (None, "a b")]
    assert run(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1)]


def test_words_that_hash_alike_modulo_powers_of_two(spark):
    rows = []
    for n in (1024, 2048, 4096):
        rows += ["".join("ab"[(bin(i).count("1") + k) % 2] for i in range(n)) for k in (0, 1)]
    rows = list(enumerate(rows))
    assert run(spark, rows) == brute(rows) == [(i, 1, i) for i, _ in rows]


def test_many_documents_just_below_the_threshold(spark):
    """1,100 texts that share most of their columns, all but a few pairs of them not similar enough: several tiles meet."""
    rng = random.Random(8)
    base, docs = [f"w{i}" for i in range(200)], []
    for i in range(1100):
        v = list(base)
        for k in rng.sample(range(0, 200, 5), 5):  # two of these share about 160 of 234 shingles or more
            v[k] = f"own{i}x{k}"
        docs.append(" ".join(v))
    near = docs[77].split()
    near[100] = "changed"
    rows = list(enumerate([*docs, " ".join(near)]))
    assert run(spark, rows) == brute(rows)


def links_of(sets_a, sets_b, percent):
    return np.array([[100 * len(a & b) >= percent * len(a | b) for b in sets_b] for a in sets_a], bool).reshape(len(sets_a), len(sets_b))


_SETS = st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(_SETS, _SETS, st.sampled_from([50, 80, 85, 100]), st.sampled_from([3, 7, 4096]))
def test_products_and_forest(sets_a, sets_b, percent, columns):
    entries = lambda sets: (np.array([i for i, s in enumerate(sets) for _ in s]), np.array([v for s in sets for v in sorted(s)]))
    sizes = tuple(np.array([len(s) for s in sets]) for sets in (sets_a, sets_b))
    expected, old, module.COLUMNS = links_of(sets_a, sets_b, percent), module.COLUMNS, columns
    try:
        got = products(entries(sets_a), entries(sets_b), sizes, np.ones(expected.shape, bool), percent)
    finally:
        module.COLUMNS = old
    assert (got == expected).all()
    x, y = forest(got)
    assert got[x, y].all() and len(x) <= sum(got.shape)
    label = list(range(sum(got.shape)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        label[find(i)] = find(len(sets_a) + j)
    assert all(find(i) == find(len(sets_a) + j) for i, j in zip(*np.nonzero(got), strict=True))
