"""Corpora and queries from FASTA, text files, lists and DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import exists

#: Suffixes that are read as FASTA (fixed values).
FASTA = {".fasta", ".fas", ".fa", ".fna", ".ffn", ".faa", ".mpfa", ".frn"}


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of a text source with dense numbers 1, 2, ... in file order, by file and place in it.

    Each split counts its rows, and the counts before it, one number for each split,
    are added. ``rows`` may be filtered; they must come straight from the files.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"))
    splits = placed.groupBy("__file", "__start").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("__file", "__start", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__offset"))
    met = placed.join(F.broadcast(offsets), ["__file", "__start"])
    return met.select((F.col("__offset") + F.col("__id") + 1).alias(name), *rows.columns)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``protein_num, header, sequence``: Spark splits the files at record starts, so large files are read in parallel.

    Records are numbered from 1 without gaps, in file order (several files by their
    paths). Lines are trimmed and joined; letters keep their case. Text before the
    first header, and records with an empty header, are left out.
    """
    text = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", r"^\s*>", "")
    header = F.trim(F.regexp_replace(F.substring_index(record, "\n", 1), "\r", ""))
    rows = numbered(text.where(header != ""), "protein_num")
    body = F.when(F.instr(record, "\n") > 0, F.regexp_replace(F.expr("substr(regexp_replace(value, '^\\\\s*>', ''), instr(regexp_replace(value, '^\\\\s*>', ''), '\\n') + 1)"), r"(?m)^[ \t\r]+|[ \t\r]+$|[\r\n]+", "")).otherwise("")
    return rows.select("protein_num", header.alias("header"), F.regexp_replace(body, r"[\r\n]", "").alias("sequence"))


def queries(spark: SparkSession, query: object) -> DataFrame:
    """``qrow, query_id, seq``; lists and text files are numbered from 1, FASTA records keep the first word of their header.

    Raises for unsupported or missing files and for empty queries, before any search.
    """
    if isinstance(query, DataFrame):
        rows = query.select(F.monotonically_increasing_id().alias("qrow"), F.col("query_id").cast("string").alias("query_id"), F.upper("seq").alias("seq"))
    elif isinstance(query, list):
        rows = spark.createDataFrame([(i, str(i + 1), s.upper()) for i, s in enumerate(query)], "qrow long, query_id string, seq string")
    else:
        path = str(query)
        suffix = os.path.splitext(path)[1].lower()
        if not exists(spark, path):
            raise FileNotFoundError(f"no such query file: {query}")
        if suffix in FASTA:
            rows = fasta(spark, path).select(F.col("protein_num").alias("qrow"), F.regexp_extract("header", r"^(\S*)", 1).alias("query_id"), F.upper(F.regexp_replace("sequence", r"\s", "")).alias("seq"))
        elif suffix == ".txt":
            line = F.regexp_replace("value", r"^\s+|\s+$", "")
            lines = numbered(spark.read.text(path).where(line != ""), "qrow")
            rows = lines.select("qrow", F.col("qrow").cast("string").alias("query_id"), F.upper(line).alias("seq"))
        else:
            raise ValueError(f"unsupported query format: {suffix}; use a list, a .txt or a FASTA file")
    if rows.isEmpty():
        raise ValueError("the query is empty")
    return rows
