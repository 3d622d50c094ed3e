import pytest

from fragsieve.functions import headers
from fragsieve.plans.benchmark import COLUMNS, Benchmarker, measured, recall, run
from fragsieve.sources.index import CorpusIndex
from fragsieve.streaming.search import search_stream

CORPUS = ">sp|P1|A_X One OS=V OX=1 GN=g PE=1 SV=2\nMKVNALVEATRFCGHIWWDEFGH\n>sp|P2|B_X Two OS=V OX=1 GN=h PE=1 SV=1\nMKVNALVEXTRFCAAAKLMNPQR\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "c.fasta").write_text(CORPUS)
    (tmp_path / "q.txt").write_text("NALVEATRF\nKLMNPQRST\n")
    return str(tmp_path / "q.txt"), str(tmp_path / "c.fasta"), str(tmp_path)


def test_seed_lengths(spark, files):
    k = lambda name, lengths, most: Benchmarker(spark, name, *files[:2], lengths, most, files[2]).k
    assert [k("x", [9, 12], 0), k("x", [9], 2), k("x", [5], 3), k("coronavirus", [9], 2), k("neoepitopes", [15], 3), k("neoepitopes", [15], 0), k("x", [15], -1)] == [9, 3, 2, 2, 3, 15, 0]


def test_run_and_recall(spark, files):
    rows = [("NALVEATRF", "NALVEATRF", "P1", 4), ("NALVEATRF", "NALVEXTRF", "P2", 4), ("KLMNPQRST", None, None, None)]
    expected = spark.createDataFrame(rows + rows[:1], "`Query Sequence` string, `Matched Sequence` string, `Protein ID` string, `Index start` long")
    found = run(spark, Benchmarker(spark, "x", *files[:2], [9], 1, files[2]), expected)
    assert (found["rows"], found["recall"], found["k"]) == (3, 100.0, 4)
    assert found["preprocess_query"] is None and found["search"]["task_s"] > 0 and found["search"]["driver_heap_mb"] > 0 and found["preprocess_proteome"]["shuffle_mb"] > 0
    exact = run(spark, Benchmarker(spark, "x", *files[:2], [9], 0, files[2]), expected)
    assert exact["recall"] == pytest.approx(200 / 3) and exact["k"] == 9
    assert recall(expected.where("false"), expected) == 0 and recall(expected, expected.where("false")) == 100
    assert Benchmarker(spark, "x", *files[:2], [9], -1, files[2]).search().columns == COLUMNS
    with pytest.raises(ZeroDivisionError):
        measured(spark, lambda: 1 // 0)


def test_stream_against_an_index(spark, files, tmp_path):
    index = CorpusIndex(spark, files[1], files[2])
    schema = "query_id string, seq string"
    spark.createDataFrame([("x", "nalveatrf"), ("x", "nalveatrf"), ("y", "wwwww")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    for place in ("one", "two"):  # the same batch once more, with its own record of progress
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        search_stream(stream, index, index.metadata(), str(tmp_path / place), str(tmp_path / f"{place}-cp"), 3, 1).awaitTermination(120)
    one, two = (sorted(map(tuple, spark.read.parquet(str(tmp_path / p / "batch=0")).collect()), key=str) for p in ("one", "two"))
    assert one == two and len(one) == 5
    assert headers.metadata(index.proteins()).count() == 2
