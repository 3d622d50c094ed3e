import random
import threading

import pytest

from fragsieve.operators import best_match, search
from fragsieve.sources import index as I
from fragsieve.sources import readers, storage

from .test_search import brute, corpus, queries, rows


def made(spark, folder, seqs):
    return I.KmerIndex(spark, str(folder), lambda: corpus(spark, seqs))


def some(rng, n, letters="ACDEFGHIKLMNPQRSTVWY"):
    return "".join(rng.choice(letters) for _ in range(n))


def read_rows(df):
    """Rows that the plan's only scan returned."""
    found = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    assert leaves.size() == 1
    return found, leaves.apply(0).metrics().apply("numOutputRows").value()


def test_lookup_reads_few_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(I, "FILE_ROWS", 100_000)
    seqs = [some(rng, 2000) for _ in range(250)]
    found = made(spark, tmp_path / "i", seqs)
    total = found.kmers(5).count()
    assert total > 490_000
    wanted = sorted({s[i : i + 5] for s in rng.sample(seqs, 20) for i in [rng.randrange(1990)]})[:20]
    got, read = read_rows(found.kmers(5, wanted))
    assert read < 0.05 * total
    want = sorted((s[i : i + 5], p + 1, i) for p, s in enumerate(seqs) for i in range(len(s) - 4) if s[i : i + 5] in wanted)
    assert sorted((r.kmer, r.protein_num, r.pos) for r in got if r.kmer in wanted) == want
    # The text of three candidates comes from the pages of their blocks.
    got, read = read_rows(found.sequence_blocks([(3, 1), (77, 0), (200, 3)]))
    assert read < 0.5 * found.sequence_blocks().count() and {(3, 1), (77, 0), (200, 3)} <= {(r.protein_num, r.block) for r in got}
    # More keys than ranges: some share one.
    many = sorted({s[:5] for s in seqs} | {s[9:14] for s in seqs})
    assert len(many) > I.RANGES
    assert {r.kmer for r in found.kmers(5, many).collect()} >= set(many)
    assert found.kmers(5, []).count() == 0


@pytest.mark.parametrize("k,most", [(2, 0), (5, 0), (2, 1), (3, 2), (4, 3)])
def test_search_through_the_index(spark, tmp_path, k, most):
    rng = random.Random(k * 10 + most)
    seqs = [some(rng, rng.choice([0, 3, 20, 511, 512, 513, 1600]), "ACDE") for _ in range(12)]
    qs = [some(rng, rng.randint(1, 12), "ACDE") for _ in range(15)] + [seqs[-1][505:520] or "ACDEACDE", max(seqs, key=len)[3:1500]]
    assert rows(search.search(None, queries(spark, qs), k, most, made(spark, tmp_path / "i", seqs))) == brute(seqs, qs, k, most)


def test_hot_kmers(spark, tmp_path, monkeypatch):
    """A motif makes up a third of the corpus: its postings reach over files, and its seeds over numbers."""
    rng = random.Random(3)
    monkeypatch.setattr(I, "FILE_ROWS", 3000)
    seqs = [some(rng, 700) + "AAAAA" * 100 + some(rng, 300) for _ in range(40)]
    found = made(spark, tmp_path / "i", seqs)
    per_file = sorted(r["rows"] for r in spark.read.parquet(f"{found.folder}/postings_5/_splits").collect()) if found.kmers(5).count() else []
    assert len(per_file) > 10 and per_file[-1] < 2 * per_file[len(per_file) // 2]
    qs = ["AAAAA" + seqs[5][1200:1206], "AAAAAAAAAAAAA", seqs[1][600:699], "AAAAAWWWWW"]
    want = brute(seqs, qs, 5, 0)
    rare = {r.qrow: (r.off, r.n) for r in search.rarest_seeds(queries(spark, qs), 5, found).collect()}
    assert rare[0][1] < 100 and rare[1][1] > 10_000 and set(rare) == {0, 1, 2}
    assert rows(search.search(None, queries(spark, qs), 5, 0, found)) == want
    monkeypatch.setattr(search, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(search, "HOT", 500)
    assert rows(search.search(None, queries(spark, qs), 5, 0, found)) == want
    sizes = search._postings(search.seeds(queries(spark, ["AAAAA"]), 5, "anchor"), 5, found).groupBy("part").count().collect()
    assert len(sizes) > 30 and max(r["count"] for r in sizes) < 1000


def test_exact_counts_read_no_text(spark, tmp_path):
    rng = random.Random(8)
    seqs = [some(rng, 300, "AC") for _ in range(5)]
    q = queries(spark, ["ACACAC", "AAAA", "GGGGGG", "ACA", "A"])
    found = search.exact_counts(q, 3, made(spark, tmp_path / "i", seqs))
    want = {}
    for r, *_ in brute(seqs, ["ACACAC", "AAAA", "GGGGGG", "ACA", "A"], 3, 0):
        want[r] = want.get(r, 0) + 1
    assert {r.qrow: r.Count for r in found.collect()} == want
    files = found.inputFiles()
    assert files and all("/postings_3/" in f for f in files)


def test_seedless_search(spark):
    rng = random.Random(9)
    seqs = [some(rng, n, "ACD") for n in (0, 4, 30, 255, 300)]
    qs = [some(rng, n, "ACD") for n in range(1, 16)] + [""]
    for most in range(4):
        want = set()
        for r, q in enumerate(qs):
            for p, s in enumerate(seqs):
                for st in range(len(s) - len(q) + 1) if q else ():
                    w = s[st : st + len(q)]
                    e = sum(a != b for a, b in zip(q, w, strict=True))
                    if e <= most:
                        want.add((r, p + 1, st, w, e))
        assert rows(search.hamming_search(corpus(spark, seqs), queries(spark, qs), most)) == want


def test_builds_are_whole_or_absent(spark, tmp_path):
    folder, seqs = tmp_path / "i", ["ACDEFGHIKL" * 30]
    with pytest.raises(ZeroDivisionError):
        storage.published(spark, str(folder / "t"), lambda own: [spark.range(5).write.parquet(own), 1 // 0])
    assert not storage.exists(spark, str(folder / "t")) and list(folder.glob("*")) == []
    # What a killed builder left is not read.
    (folder / ".building-dead" / "part-0.parquet").mkdir(parents=True)
    found = made(spark, folder, seqs)
    assert found.kmers(4).count() == 297
    # Several at once give one index, and every reader the same.
    made_by, counts = [], []

    def build():
        storage.published(spark, str(folder / "race"), lambda own: (made_by.append(own), spark.range(7).repartition(2).write.parquet(own)))
        counts.append(spark.read.parquet(str(folder / "race")).count())

    threads = [threading.Thread(target=build) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert counts == [7] * 4 and len(made_by) > 1
    assert not [p for p in folder.glob(".building-*") if not p.name.endswith("dead")] and not [p for p in (folder / "race").iterdir() if p.is_dir()]


def test_any_store(spark, tmp_path):
    """A mounted path that no local file call reaches."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.kept.link./in", f"file://{tmp_path}")
    (tmp_path / "a.fasta").write_text(">x\nACDEF\nGHIKL\n>y\nACDEFG\n")
    (tmp_path / "q.txt").write_text("cdefg\n\nwwwww\n")
    one = I.CorpusIndex(spark, "viewfs://kept/in/a.fasta", "viewfs://kept/in/index")
    assert sorted((r.protein_num, r.pos) for r in one.kmers(5, ["CDEFG"]).where("kmer = 'CDEFG'").collect()) == [(1, 1), (2, 1)]
    assert one.folder.startswith("viewfs://kept/in/index/a-") and (tmp_path / "index").is_dir()
    hits = search.search(None, readers.queries(spark, "viewfs://kept/in/q.txt"), 3, 1, one)
    assert {(r.qrow, r.protein_num, r.st, r.edits) for r in hits.collect()} == {(1, 1, 1, 0), (1, 2, 1, 0)}
    assert I.CorpusIndex(spark, "viewfs://kept/in/a.fasta", str(tmp_path / "index")).folder.rpartition("/")[2] == one.folder.rpartition("/")[2]


def test_numbers_are_dense_in_file_order(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for f, n in (("a", 40), ("b", 3), ("c", 25)):
        (tmp_path / "c" / f"{f}.fasta").write_text("".join(f">{f}{i}\n{'ACDE' * (i % 9)}\n" + (">\nlost\n" if i % 7 == 0 else "") for i in range(n)))
    want = [f"{f}{i}" for f, n in (("a", 40), ("b", 3), ("c", 25)) for i in range(n)]
    try:
        for size in ("128m", "200"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = readers.fasta(spark, str(tmp_path / "c"))
            assert [(r.protein_num, r.header) for r in got.orderBy("protein_num").collect()] == list(enumerate(want, 1))
        assert spark.read.text(str(tmp_path / "c")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_best_hits_through_the_index(spark, tmp_path):
    rng = random.Random(2)
    seqs = [some(rng, 120, "ACDEFGHIK") for _ in range(4)]
    qs = [seqs[0][5:17], seqs[1][40:46] + "LL" + seqs[1][48:52], "LMLMLMLMLM"]
    plain, found = (best_match.best_hits(corpus(spark, seqs), queries(spark, qs), i) for i in (None, made(spark, tmp_path / "i", seqs)))
    assert rows(found) == rows(plain)
