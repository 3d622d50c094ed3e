import hashlib
import random
import re

import pytest

from fragsieve.llm.winnowing import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        w, hit, got = words(text), set(), []
        for item_id, item in items:
            v = words(item)
            n = min(window, len(v))
            own = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            places = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in own] if n else []
            hit |= {i + k for i in places for k in range(n)}
            if places:
                got.append(str(item_id))
        digest = hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(got), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, key string, row int")
    b = spark.createDataFrame([(*r, 7) for r in items], "item_id long, text string, item_row int")
    return sorted(map(tuple, decontaminate(d.repartition(3), b, **more).collect()), key=str)


@pytest.mark.parametrize("bound", [0, 10**8])
def test_equals_brute_force(spark, bound):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "Über", "x1"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 5, 12, 13, 14, 20, 40]))) for i in range(25)] + [(100, None), (101, "..."), (102, "unique " * 15), (3, "unique " * 15)]
    docs = [(i, some(rng.choice([0, 3, 12, 13, 30, 200]))) for i in range(30)]
    docs += [(1000 + i, f"{some(20)} zz {items[i % 25][1].upper()}! yy, {some(9)}") for i in range(40)]
    docs += [(2000, None), (2001, ""), (2002, "unique-unique," * 9), (2002, "unique-unique," * 9), (2003, "unique " * 5000), (2004, "lone " * 400 + "unique " * 13), (None, "alpha beta")]
    assert run(spark, docs, items, bound=bound) == brute(docs, items)


def test_long_items_only(spark):
    rng = random.Random(6)
    text = [f"w{i}" for i in range(300)]
    items = [(1, " ".join(text[50:90])), (2, " ".join(text[100:113])), (3, " ".join(text[200:212] + ["other"]))]
    docs = [(i, " ".join(text[a : a + rng.randint(5, 120)])) for i, a in enumerate(rng.sample(range(250), 60))] + [(99, " ".join(text))]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])
    assert run(spark, [], [(1, "a b")]) == []


def test_words_that_hash_alike_modulo_powers_of_two(spark):
    a, b = ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in (0, 1))
    items = [(1, a), (2, f"one two {a} " + "six " * 12)]
    docs = [(1, b), (2, a), (3, f"one two {b} " + "six " * 12), (4, f"zero one two {a} " + "six " * 12)]
    assert run(spark, docs, items) == brute(docs, items)
