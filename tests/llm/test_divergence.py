import re
from collections import Counter, defaultdict

import numpy as np

from fragsieve.llm import divergence
from fragsieve.llm.divergence import audit, share


def brute(docs, least=10, top=10):
    """From the contract's words, in Python's integers."""
    rows = [((t or "").translate({c: c + 32 for c in range(65, 91)}), lang or "", source or "") for t, lang, source in docs]
    occ, have, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        occ[lang, source].update(terms)
        have[lang].update(set(terms))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in have[lang].items() if n >= least)
        counts = {s: {t: occ[lang, s][t] for t in kept} for s in sources} | {None: {t: sum(occ[lang, s][t] for s in sources) for t in kept}}
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in counts.items()}
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-apart(p[s][t], p[None][t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)}
    return out


def got(spark, docs, **more):
    rows = spark.createDataFrame([(t, lang, s, 1, "x") for t, lang, s in docs], "text string, lang string, source string, value int, term string")
    found = [tuple(r) for r in audit(rows, **more).collect()]
    assert len(found) == len(set(found))
    return set(found)


def documents(n, seed=1):
    rng = np.random.default_rng(seed)
    stock = ["the", "The", "été", "Été", "ÉTÉ", "straße", "naïve", "x", "日本語", "one-two", "a1b", "it's", " ", "😀😀", "q" * 300] + [f"w{c}" for c in "abcdefghijklmno"]
    out = []
    for _ in range(n):
        lang, source = ["en", "de", None][rng.integers(3)], ["s1", "s2", "é", "Z", None, ""][rng.integers(6)]
        text = " ".join(stock[i] for i in np.minimum(rng.geometric(0.12, rng.integers(0, 30)) - 1, len(stock) - 1))
        out.append((None if rng.random() < 0.05 else text, lang, source))
    return out


def test_against_brute_force(spark):
    docs = documents(400) + [("the the only one", "fr", "alone"), ("few words", "es", "s1"), ("few words", "es", "s2"), (None, "it", None), ("long " * 60_000 + "end", "en", "s1")]
    want = brute(docs)
    assert got(spark, docs) == want
    assert got(spark, docs, block=300, terms=3, tile=2) == want
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "es" and r[4] == 0 for r in want)


def test_repeated_rows_and_no_rows(spark):
    docs = [("same words here", "en", "big")] * 300 + [("other words there", "en", "small")] * 12
    assert got(spark, docs) == brute(docs)
    assert got(spark, [("a", "en", "s")][:0]) == set()


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda b: len(b) % 2)
    data = np.frombuffer("aa bb aa cc b a bb b".encode(), np.uint8)
    start, end, _ = divergence.words(data, np.array([0, len(data)]), divergence.TERM)
    group, first = divergence._groups(data, start, end)
    text = [data[a:b].tobytes() for a, b in zip(start, end)]
    assert [text[first[g]] for g in group] == text and len(first) == len(set(text))


def test_share_is_exact_for_large_counts():
    rng = np.random.default_rng(2)
    total = rng.integers(1, 2 * 10**14, 1000)
    count = (total * rng.random(1000)).astype(np.int64) - 2
    assert share(count, total).tolist() == [1 + 10**9 * (c + 2) // n for c, n in zip(count.tolist(), total.tolist())]
