import csv
import json
import random
import zipfile

import pytest

from fragsieve import cli
from fragsieve.functions import headers
from fragsieve.plans.matcher import Matcher, Preprocessor
from fragsieve.sources import index, readers
from fragsieve.streaming.search import search_stream

FASTA = """>sp|P1|AA_X First protein, part OS=Some virus (isolate 1) OX=12 GN=gA PE=2 SV=3
MKVNALVEATRFC
GHIPPPPWDEFGH\r
>sp|P1-2|AA_X Isoform two OS=Some virus OX=12 GN=gA PE=0 SV=1
MKVNALVEATRFCAAA
>tr|T9|BB_X Second (Fragment) OS=Other OX=7 GN=gA SV=1
MKVNALVEATRFCTTTT
>sp|P3|CC_X OS=odd name
MMMMMMM
>bare_token
fgpgkPPPP"""


@pytest.fixture
def path(tmp_path):
    (tmp_path / "small.corpus.fasta").write_text(FASTA)
    return str(tmp_path / "small.corpus.fasta")


def test_fasta_and_headers(spark, path):
    records = readers.fasta(spark, path)
    rows = records.orderBy("protein_num").collect()
    assert [r.sequence for r in rows] == ["MKVNALVEATRFCGHIPPPPWDEFGH", "MKVNALVEATRFCAAA", "MKVNALVEATRFCTTTT", "MMMMMMM", "fgpgkPPPP"]
    meta = headers.metadata(records).orderBy("protein_num").collect()
    assert [m.protein_id for m in meta] == ["P1", "P1-2", "T9", "P3", "bare_token"]
    assert [m.pe_level for m in meta] == [2, 2, 0, 0, 0]
    assert [m.gene_priority for m in meta] == [1, 0, 0, 0, 0]
    assert [m.sequence_version for m in meta] == [3, 1, 1, 1, 1]
    assert [m.species for m in meta] == ["Some virus (isolate 1)", "Some virus", "Other", "odd name", None]
    assert [m.protein_name for m in meta] == ["First protein, part", "Isoform two", "Second (Fragment)", "OS=odd name", None]
    assert [m.swissprot for m in meta] == [True, True, False, True, False]


def test_exact_with_a_miss_and_versions(spark, path, tmp_path):
    m = Matcher(spark, ["nalveatrf", "WWWWWW", "MMM"], path, preprocessed_files_path=str(tmp_path))
    rows = sorted(map(tuple, m.match().collect()), key=str)
    assert [(r[0], r[3], r[10], r[11]) for r in rows] == [("1", "P1-2.1", 4, 12), ("1", "P1.3", 4, 12), ("1", "T9.1", 4, 12), ("2", None, None, None), ("3", None, None, None)]
    assert {r[9] for r in rows} == {"[]"}


def test_mismatch_mixed_and_best(spark, path, tmp_path):
    q = tmp_path / "q.txt"
    q.write_text("NALXEATRF\n\nM1, K2, X3\n")
    rows = Matcher(spark, str(q), path, max_mismatches=1, k=3, preprocessed_files_path=str(tmp_path)).match().collect()
    assert sorted((r["Query ID"], r["Protein ID"], r["Mismatches"], r["Mutated Positions"]) for r in rows) == [(i, p, 1, w) for i, w in (("1", "[4]"), ("2", "[3]")) for p in ("P1-2.1", "P1.3", "T9.1")]
    best = Matcher(spark, ["NALXEATRF", "YYYYYYYYY"], path, best_match=True, preprocessed_files_path=str(tmp_path)).match().collect()
    assert sorted((r["Query ID"], r["Protein ID"], r["Mismatches"]) for r in best) == [("1", "P1.3", 1), ("2", None, None)]


def test_outputs(spark, path, tmp_path):
    out = str(tmp_path / "found")
    for fmt in ("csv", "tsv", "json", "xlsx"):
        assert Matcher(spark, ["NALVEATRF", "WWWWW"], path, preprocessed_files_path=str(tmp_path), output_format=fmt, output_name=out).match() is None
    table = list(csv.DictReader(open(out + ".csv")))
    assert len(table) == 4 and {r["SwissProt Reviewed"] for r in table} == {"true", "false", ""}
    assert list(csv.reader(open(out + ".tsv"), delimiter="\t"))[0] == list(table[0])
    assert len(json.load(open(out + ".json"))) == 4
    assert b"NALVEATRF" in zipfile.ZipFile(out + ".xlsx").read("xl/worksheets/sheet1.xml")


@pytest.mark.parametrize("bad", [{"k": 1}, {"max_indels": 2}, {"max_indels": 1, "max_mismatches": 1}, {"max_indels": 1, "best_match": True}, {"max_indels": 1, "counts_only": True}, {"output_format": "x"}, {"counts_only": True, "best_match": True}, {"max_mismatches": -1}])
def test_contradictions(spark, path, bad):
    with pytest.raises(ValueError):
        Matcher(spark, ["ABCDE"], path, **bad)


def test_input_errors(spark, path, tmp_path):
    with pytest.raises(FileNotFoundError):
        Matcher(spark, "/nowhere.fasta", path)
    with pytest.raises(FileNotFoundError):
        Preprocessor(spark, "/nowhere.fasta")
    (tmp_path / "q.bin").write_text("x")
    (tmp_path / "e.txt").write_text("\n")
    for q in (str(tmp_path / "q.bin"), str(tmp_path / "e.txt")):
        with pytest.raises(ValueError):
            Matcher(spark, q, path)
    with pytest.raises(ValueError):
        Matcher(spark, ["A1, B2"], path, max_indels=1)


def test_index_follows_the_content(spark, path, tmp_path):
    first = index.CorpusIndex(spark, path, str(tmp_path))
    n = Preprocessor(spark, path, preprocessed_files_path=str(tmp_path)).preprocess(4).count()
    assert n == sum(max(len(s) - 3, 0) for s in ("MKVNALVEATRFCGHIPPPPWDEFGH", "MKVNALVEATRFCAAA", "MKVNALVEATRFCTTTT", "MMMMMMM", "fgpgkPPPP"))
    open(path, "a").write("\n>new\nAAAA\n")
    assert index.CorpusIndex(spark, path, str(tmp_path)).folder != first.folder


def test_cli_and_counts(spark, path, tmp_path):
    (tmp_path / "q.fasta").write_text(">a b\nNALVEATRF\n")
    cli.main(["match", "-q", str(tmp_path / "q.fasta"), "-p", path, "-P", str(tmp_path), "-o", str(tmp_path / "r")])
    assert len(open(tmp_path / "r.csv").read().splitlines()) == 4
    counted = Matcher(spark, ["NALVEATRF", "WWWWWW"], path, max_mismatches=1, k=3, counts_only=True, preprocessed_files_path=str(tmp_path)).match().collect()
    assert [tuple(r) for r in counted] == [("1", "NALVEATRF", 0, 3)]


def test_stream_of_queries(spark, path, tmp_path):
    spark.createDataFrame([("x", "nalveatrf")], "query_id string, seq string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id string, seq string").parquet(str(tmp_path / "in"))
    corpus = readers.fasta(spark, path)
    search_stream(stream, corpus, headers.metadata(corpus), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_index_holds_whole_kmers_over_block_edges(spark, tmp_path):
    rng = random.Random(6)
    seqs = ["".join(rng.choice("ACDEFGHIK") for _ in range(n)) for n in (600, 256, 257, 512, 5)]
    (tmp_path / "long.fasta").write_text("".join(f">s{i}\n{s}\n" for i, s in enumerate(seqs)))
    for k in (2, 5, 300):
        got = sorted(tuple(r) for r in Preprocessor(spark, str(tmp_path / "long.fasta"), preprocessed_files_path=str(tmp_path)).preprocess(k).select("protein_num", "pos", "kmer").collect())
        assert got == [(p + 1, i, s[i : i + k]) for p, s in enumerate(seqs) for i in range(len(s) - k + 1)]
