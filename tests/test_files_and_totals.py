"""One file out of many parts, and k-mers counted in the tasks."""

import csv
import json
from collections import Counter

import pytest
from pyspark.sql import DataFrame

from fragsieve.operators import kmers
from fragsieve.sources import sinks

ROWS = [(1, 'a "b", c', True), (2, None, None), (3, "tab\there", False), (4, "é\U0001f600 x", True), (5, "", None), (6, "b\\c", False)]


@pytest.mark.parametrize("store", [False, True])
@pytest.mark.parametrize("fmt", ["csv", "tsv", "json"])
def test_no_row_passes_through_the_driver(spark, tmp_path, monkeypatch, fmt, store):
    def never(*_, **__):
        raise AssertionError("rows came to the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", never)
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", never)
    df = spark.createDataFrame(ROWS, "n long, text string, flag boolean").repartition(4, "n")
    local = str(tmp_path / "out")
    path = sinks.write_file(df, fmt, f"file://{local}" if store else local)
    assert path.endswith(f"out.{fmt}")
    with open(f"{local}.{fmt}", encoding="utf-8", newline="") as f:
        if fmt == "json":
            assert sorted((r["n"], r["text"], r["flag"]) for r in json.load(f)) == ROWS
        else:
            head, *rows = csv.reader(f, delimiter="\t" if fmt == "tsv" else ",")
            assert head == ["n", "text", "flag"]
            assert sorted(map(tuple, rows)) == [(str(n), t or "", "" if b is None else str(b).lower()) for n, t, b in ROWS]
    if fmt == "json":
        assert sorted(map(tuple, sinks.read_json_file(spark, path if store else f"file://{path}", df.schema).collect())) == ROWS
        empty = sinks.write_file(df.where("n > 9"), fmt, str(tmp_path / "none"))
        assert json.load(open(empty)) == [] and sinks.read_json_file(spark, f"file://{empty}", df.schema).count() == 0


@pytest.mark.parametrize("k", [1, 3, 5])
@pytest.mark.parametrize("texts", [["ACACAC", "AC", "", None, "CCCACA"], ["ACACAC", "Aé\U0001f600éA", "CCC"]])
def test_totals_send_a_row_for_each_kmer(spark, k, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    for ids in (rows, [*rows, (1, "ACACACA"), (None, "ACACAC")]):
        n, held = Counter(), {}
        for i, t in ids:
            for j in range(len(t or "") - k + 1):
                n[t[j : j + k]] += 1
                held.setdefault(t[j : j + k], set()).update({i} - {None})
        found = kmers.totals(spark.createDataFrame(ids, "protein_num long, sequence string").repartition(2), k)
        assert {r.kmer: (r.n, r.n_sequences) for r in found.collect()} == {x: (n[x], len(held[x])) for x in n}
        if ids is rows:
            assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_parts_are_read_by_all_cores(spark):
    """The table of parts is one small file: its search must not be one task."""
    from fragsieve.plans import results

    assert results._corpus(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
