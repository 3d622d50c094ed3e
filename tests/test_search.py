import random

import pytest

from fragsieve.operators import best_match, search
from fragsieve.operators import kmers as K


def corpus(spark, seqs):
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(seqs)], "protein_num long, sequence string").repartition(3)


def queries(spark, seqs):
    return spark.createDataFrame([(i, str(i), s) for i, s in enumerate(seqs)], "qrow long, query_id string, seq string")


def hamming(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def brute(seqs, qs, k, most):
    out = set()
    for r, q in enumerate(qs):
        n = len(q)
        for p, s in enumerate(seqs):
            for st in range(len(s) - n + 1) if n >= k else ():
                w = s[st : st + n]
                offs = range(0, n - k + 1, k) if n % k == 0 else range(n - k + 1)
                if hamming(q, w) <= most and any(w[i : i + k] == q[i : i + k] for i in offs):
                    out.add((r, p + 1, st, w, hamming(q, w)))
    return out


def rows(df):
    got = [(r.qrow, r.protein_num, r.st, r.matched, r.edits) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("k,most", [(2, 0), (5, 0), (2, 1), (3, 2), (4, 3)])
def test_search_equals_the_definition(spark, k, most):
    rng = random.Random(k * 10 + most)
    some = lambda n: "".join(rng.choice("ACDE") for _ in range(n))
    seqs = [some(rng.choice([0, 3, 20, 255, 256, 257, 600])) for _ in range(12)]
    qs = [some(rng.randint(1, 12)) for _ in range(15)] + [seqs[-1][250:262] or "ACDEACDE"]
    assert rows(search.search(corpus(spark, seqs), queries(spark, qs), k, most)) == brute(seqs, qs, k, most)


@pytest.mark.parametrize("letters,least,most", [("ACD", 4, 9), ("AB", 4, 9), ("AB", 9, 24)])
def test_indels_equal_the_definition(spark, letters, least, most):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    seqs = [some(n) for n in (30, 250, 300, 5, 4, 520)]
    # Some queries are cut from the sequences, so that long ones have hits at both ends and across blocks.
    qs = [some(rng.randint(least, most)) for _ in range(25)] + [s[i : i + most] for s in seqs for i in (0, 245, 250, len(s) - most) if len(s[i : i + most]) == most]
    want = set()
    for r, q in enumerate(qs):
        n = len(q)
        for p, s in enumerate(seqs):
            for st in range(len(s)):
                if s[st : st + n] == q:
                    want.add((r, p + 1, st, q, 0))
                w = s[st : st + n - 1]
                if len(w) == n - 1 and any(q[:d] + q[d + 1 :] == w for d in range(1, n - 1)):
                    want.add((r, p + 1, st, w, 1))
                w = s[st : st + n + 1]
                if len(w) == n + 1 and any(w[:i] + w[i + 1 :] == q for i in range(1, n)):
                    want.add((r, p + 1, st, w, 1))
    assert rows(search.indel_search(corpus(spark, seqs), queries(spark, qs))) == want


def test_known_indel_cases(spark):
    seqs = ["ACDEFG", "XYABCE", "XNALVEATRFC", "NALVEATRFCX", "LPDGVWEESS", "MKVNALVETRFCGHI", "MKVNALVEXATRFCGHI"]
    qs = ["ABCDE", "NALVEATRFC", "LPDGVWEES", "A"]
    got = rows(search.indel_search(corpus(spark, seqs), queries(spark, qs)))
    assert {(r, p, m, e) for r, p, _, m, e in got} == {(0, 1, "ACDE", 1), (0, 2, "ABCE", 1), (1, 3, "NALVEATRFC", 0), (1, 4, "NALVEATRFC", 0), (2, 5, "LPDGVWEES", 0), (2, 5, "LPDGVWEESS", 1), (1, 6, "NALVETRFC", 1), (1, 7, "NALVEXATRFC", 1)}


@pytest.mark.parametrize("most", [0, 1, 3])
def test_discontinuous(spark, most):
    seqs = ["ABCDEF", "ABXDEF", "AB", "", "BBCDEFGH"]
    qs = ["A1, C3, F6", "B2, H8", "A12", "B1, B2, C3", "PLAIN", "A1,B2"]
    anchored, linear = search.discontinuous_queries(queries(spark, qs))
    assert sorted(r.seq for r in linear.collect()) == ["A1,B2", "PLAIN"]
    want = set()
    for r, q in enumerate(qs[:4]):
        pairs = [(x[0], int(x[1:])) for x in q.split(", ")]
        for p, s in enumerate(seqs):
            if all(1 <= at <= len(s) for _, at in pairs):
                wrong = sum(s[at - 1] != c for c, at in pairs)
                if wrong <= most:
                    want.add((r, p + 1, pairs[0][1] - 1, ", ".join(f"{s[at - 1]}{at}" for _, at in pairs), wrong))
    assert rows(search.discontinuous_search(corpus(spark, seqs), anchored, most)) == want


def test_counts_equal_grouped_hits(spark):
    rng = random.Random(8)
    seqs = ["".join(rng.choice("AC") for _ in range(80)) for _ in range(5)]
    qs = ["ACACAC", "AAAA", "GGGGGG"]
    q = queries(spark, qs)
    hits = search.search(corpus(spark, seqs), q, 2, 2)
    got = {(r["Query ID"], r["Mismatches"]): r["Count"] for r in search.counts(hits, q).collect()}
    want = {}
    for r, *_, e in brute(seqs, qs, 2, 2):
        want[str(r), e] = want.get((str(r), e), 0) + 1
    assert got == want


def test_best_hits_have_the_fewest_edits(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACDEFGHIK") for _ in range(120)) for _ in range(4)]
    qs = [seqs[0][5:17], seqs[1][40:46] + "LL" + seqs[1][48:52], "LMLMLMLMLM", "MNPQRSTVWY"]
    found = best_match.best_hits(corpus(spark, seqs), queries(spark, qs)).groupBy("qrow").min("edits").collect()
    got = {r[0]: r[1] for r in found}
    assert got[0] == 0 and got[1] == min(hamming(qs[1], s[i : i + 12]) for s in seqs for i in range(109))
    assert 2 not in got and 3 not in got


def _one_budget_at_a_time(corpus_rows, query_rows):
    """The definition: stages by seed length, then budgets that grow by one."""
    left, found = dict(enumerate(query_rows)), {}

    def stage(k, most):
        hits = brute(corpus_rows, list(left.values()), k, most)
        keys = list(left)
        for r in {h[0] for h in hits}:
            found[keys[r]] = min((h[4] for h in hits if h[0] == r))
        for q in found:
            left.pop(q, None)

    for k in best_match.stages(min(map(len, query_rows))):
        if left:
            stage(k, max(min(map(len, left.values())) // k - 1, 0))
    most = min(map(len, left.values()), default=0) // 2
    while left and most < min(map(len, left.values())):
        most += 1
        stage(2, most)
    return found


def test_one_frontier_equals_growing_budgets(spark):
    rng = random.Random(11)
    for n in range(3):
        seqs = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randint(10, 60))) for _ in range(5)]
        qs = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWYX") for _ in range(rng.choice([6, 7, 9, 12, 15][n:]))) for _ in range(14)] + [seqs[0][2:9], "XXXXXXXXXXXX"]
        found = best_match.best_hits(corpus(spark, seqs), queries(spark, qs)).groupBy("qrow").min("edits").collect()
        assert {r[0]: r[1] for r in found} == _one_budget_at_a_time(seqs, qs)


def test_seed_offsets(spark):
    q = queries(spark, ["ABCDEFGHIJ", "ABC"])
    offs = lambda k, how: sorted(r.off for r in K.seeds(q.where("qrow = 0"), k, how).collect())
    assert offs(5, "mismatch") == [0, 5] and offs(4, "mismatch") == list(range(7)) and offs(4, "coverage") == [0, 4, 6] and offs(4, "anchor") == [0]
    assert K.seeds(q, 5, "mismatch").where("qrow = 1").count() == 0


@pytest.mark.parametrize("most", [0, 1, 3])
def test_discontinuous_without_a_shuffle(spark, monkeypatch, most):
    """Equal positions listed twice, positions beyond a sequence, and records without a number or with one number."""
    from pyspark.sql import functions as F

    seqs = ["ACDE", "AC", "", "CCDE", "AADE"]
    texts = corpus(spark, seqs).withColumn("protein_num", F.when(F.col("protein_num") < 4, F.lit(7)).otherwise(F.col("protein_num")))
    qs = ["A1, A1, D3", "C2, A1", "E4, D3, C2, A1", "A1, C2, E9", "A0, C2"]
    anchored, _ = search.discontinuous_queries(queries(spark, qs))
    found = search.discontinuous_search(texts, anchored, most)
    got = sorted((r["qrow"], r["protein_num"], r["st"], r["matched"], r["edits"], r["mutated"]) for r in found.collect())
    want = []
    for n, q in zip([r["qrow"] for r in sorted(anchored.collect(), key=lambda r: r["qrow"])], qs, strict=True):
        parts = [(p[0], int(p[1:])) for p in q.split(", ")]
        for num, s in zip([7, 7, 7, 4, 5], seqs, strict=True):
            wrong = [p for c, p in parts if 1 <= p <= len(s) and s[p - 1] != c]
            if all(1 <= p <= len(s) for _, p in parts) and len(wrong) <= most:
                want.append((n, num, parts[0][1] - 1, ", ".join(s[p - 1] + str(p) for _, p in parts), len(wrong), str(wrong)))
    assert got == sorted(want) and got
    # The texts are read once; they were joined with the hits before.
    texts = spark.range(9).select(F.col("id").alias("protein_num"), F.lit("ACDE").alias("sequence"))
    assert search.discontinuous_search(texts, anchored, most)._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_begin_of_a_text_holds_all_that_position_queries_see(spark):
    from pyspark.sql import functions as F

    from fragsieve.plans.queries import FRONT, _letters

    assert FRONT.endswith("{0,7}")

    texts = ["a-b c1d\ne ß f  g hijk", "", "ab", "12 é", "abcdefgh", "?" * 30_000 + "a" + "?" * 30_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.regexp_extract("t", FRONT, 0).alias("f"), F.left(_letters("t"), F.lit(7)).alias("want")).select("i", _letters("f").alias("got"), "want").orderBy("i").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_recall_runs_each_search_once(spark):
    from pyspark.sql import functions as F

    from fragsieve.plans.queries import _recall

    hits = lambda n: spark.range(n).select(F.struct(F.lit(1).alias("item_id"), F.lit(0).alias("piece")).alias("qrow"), F.when(F.col("id") % 4 != 1, F.col("id") % 4).alias("protein_num"), F.lit(5).alias("st"))
    # Four different places (one in a record without a number), each found twice; the exact search finds three, and two that the other doesn't.
    made = _recall(hits(3).unionByName(hits(2).withColumn("st", F.lit(9))), hits(8))
    assert made.first()["recall"] == 75.0
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 3


def test_scratch_folders_are_marked_for_removal_and_tables_dealt_in_bounded_parts(spark, monkeypatch):
    from fragsieve.sources import shared

    path = shared.scratch_path(spark)
    target, system = shared._place(spark, path)
    assert not system.exists(target) and system.cancelDeleteOnExit(target.getParent())
    monkeypatch.setattr(shared, "PART", 10)
    one = spark.range(95).coalesce(1)
    assert shared.spread(one).rdd.getNumPartitions() == 10 and sorted(r[0] for r in shared.spread(one).collect()) == list(range(95))
    assert shared.spread(one.limit(0)).count() == 0
