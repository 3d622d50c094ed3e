import random

import pytest

from fragsieve.plans import queries as Q

from .test_search import brute


def pieces(x, size, least=5):
    cuts = list(range(0, max((len(x) + size - least) // size, 1) * size, size))
    return [x[i : i + size] if i != cuts[-1] else x[i:] for i in cuts]


def substituted(i, w):
    if len(w) < 11 or i % 3 == 0:
        return w
    w = w[:3] + "X" + w[4:]
    return w if i % 3 == 1 else w[:10] + "Z" + w[11:]


def edited(i, w):
    if len(w) < 9 or i % 3 == 0:
        return w
    return w[:7] + w[8:] if i % 3 == 1 else w[:6] + "X" + w[6:]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("ACDEFGHIK") for _ in range(n))
    items = [some(n) for n in (0, 3, 9, 15, 20, 33, 37, 64, 130)]
    docs = [some(300) + items[8][61:] + some(20), items[7] + some(5) + items[6][15:], some(240) + items[5][:], items[4] + items[2] + some(40), ""]
    sf = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, x[:4].lower() + " " + x[4:]) for i, x in enumerate(items)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(docs, 1)), "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    return sf, items, docs


def cut(items, size, least, change=lambda i, w: w):
    return {(i, n): change(i + n, w) for i, x in enumerate(items) for n, w in enumerate(pieces(x, size, least))}


def got(df):
    return sorted(((r.item_id, r.piece), r.protein_num, r.st, r.matched, r.edits) for r in df.collect())


def want(docs, qs, k, most):
    keys = list(qs)
    return sorted((keys[r], *rest) for r, *rest in brute(docs, list(qs.values()), k, most))


def test_pieces_hold_all_letters(spark, tables):
    sf, items, _ = tables
    rows = sorted((tuple(r.qrow), r.query_id, r.seq) for r in Q._pieces(spark, sf, "w", 15).collect())
    assert rows == [(q, str(q[0]), w) for q, w in cut(items, 15, 5).items()]
    for i, x in enumerate(items):
        assert "".join(w for _, item, w in rows if item == str(i)) == x


def test_searches_of_whole_items(spark, tables):
    sf, items, docs = tables
    plain, changed = cut(items, 15, 5), cut(items, 15, 5, substituted)
    every = sorted((q, p, st, w, 0) for q, w in plain.items() if w for p, d in enumerate(docs, 1) for st in range(len(d)) if d.startswith(w, st))
    for query in (Q.exact_search, Q.exact_search_whole, Q.exact_scan):
        assert got(query(spark, sf)) == every
    late = {q for q, *_ in every if q[1] > 1}
    assert late and {q[0] for q, *_ in every} >= {2, 7, 8}
    for query in (Q.mismatch_search, Q.mismatch_search_whole):
        assert got(query(spark, sf)) == want(docs, changed, 5, 2)
    for query in (Q.mismatch_search_seed_bound, Q.mismatch_search_seed_bound_whole):
        assert got(query(spark, sf)) == want(docs, cut(items, 15, 7, substituted), 7, 6)
    counted = {(r["Query ID"], r["Query Sequence"]): r["Count"] for r in Q.exact_counts(spark, sf).collect()}
    assert counted == {(str(i), plain[i, n]): sum(plain[q[0], q[1]] == plain[i, n] and q[0] == i for q, *_ in every) for (i, n), *_ in every if len(plain[i, n]) >= 5}
    missed = Q.exact_search_with_misses_whole(spark, sf)
    assert {((r.item_id, r.piece), r.seq) for r in missed.collect()} == set(changed.items())


def test_indels_of_whole_items(spark, tables):
    sf, items, docs = tables
    found = set()
    for q, w in cut(items, 16, 8, edited).items():
        n = len(w)
        for p, d in enumerate(docs, 1) if n >= 4 else ():
            for st in range(len(d)):
                for size in (n - 1, n, n + 1):
                    v = d[st : st + size]
                    a, b = (v, w) if size < n else (w, v)
                    last = n - 1 if size < n else n
                    if len(v) == size and (v == w if size == n else any(b[:i] + b[i + 1 :] == a for i in range(1, last))):
                        found.add((q, p, st, v, abs(size - n)))
    short = {(i, 0) for i, x in enumerate(items) if len(x) < 4}
    for query in (Q.indel_search, Q.indel_search_whole):
        assert [r for r in got(query(spark, sf)) if r[0] not in short] == sorted(found)


def test_other_queries_take_whole_items(spark, tables):
    sf, items, docs = tables
    offs = {((r.item_id, r.piece), r.off, r.kmer) for r in Q.queries()["seeds_block_whole"](spark, sf).collect()}
    assert offs == {(q, o, w[o : o + 5]) for q, w in cut(items, 15, 5).items() for o in (range(0, len(w) - 4, 5) if len(w) % 5 == 0 else range(len(w) - 4))}
    assert max(len(r.seq) for r in Q.clean_query_anti(spark, sf).collect()) == len(items[8]) + 1
    hits = want(docs, cut(items, 15, 5, substituted), 5, 2)
    assert sum(r["Count"] for r in Q.counts_only_whole(spark, sf).collect()) == len(hits)
    both = sum(1 for q, _, _, w, e in hits if e == 0)
    assert Q.recall_whole(spark, sf).first()[0] == pytest.approx(100 * both / len(hits), abs=1e-5)


def test_kmer_counts_of_long_texts(spark, tables):
    sf, _, docs = tables
    places = {}
    for p, d in enumerate(docs):
        for i in range(len(d) - 2):
            places.setdefault(d[i : i + 3], []).append(p)
    assert max(map(len, docs)) > 256
    assert {r.kmer: (r.n, r.n_sequences) for r in Q.kmer_counts_whole(spark, sf).collect()} == {k: (len(v), len(set(v))) for k, v in places.items()}
