"""Whole results against SQL on the small driver tables."""

from pathlib import Path

import duckdb
import pytest

from fragsieve.plans import results as R

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.is_dir(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(R.queries()))
def test_rows_are_those_of_sql(spark, name):
    con = duckdb.connect()
    for file in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df, sql = R.queries()[name](spark, str(SF)), con.sql(R.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    got = sorted(map(str, (tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect())))
    assert got == sorted(map(str, sql.project(", ".join(f'"{c}"' for c in columns)).fetchall()))
    assert len(got) > 40
