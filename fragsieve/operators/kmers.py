"""k-mers of a corpus in blocks, and seeds of queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .windows import plain_bytes

#: Letters that are counted together, about.
LETTERS = 1 << 20
#: Start positions that a block owns.
BLOCK = 256


def blocks(corpus: DataFrame, halo: int) -> DataFrame:
    """``protein_num, plen, b0, c0, chunk``: owned starts from ``b0`` on, and the text from ``c0`` with ``halo`` characters on both sides.

    Sequences are cut before k-mers are exploded, so that no long string is copied to each of its k-mers.
    """
    cut = corpus.where("length(sequence) > 0").select("protein_num", "sequence", F.length("sequence").alias("plen"))
    starts = F.expr(f"explode(sequence(0, length(sequence) - 1, {BLOCK}))")
    placed = cut.select("*", starts.alias("b0")).withColumn("c0", F.greatest(F.col("b0") - halo, F.lit(0)))
    return placed.select("protein_num", "plen", "b0", "c0", F.expr(f"substr(sequence, c0 + 1, b0 + {BLOCK} + {halo} - c0)").alias("chunk"))


def kmers(blocked: DataFrame, k: int) -> DataFrame:
    """Every window of ``k`` characters: ``kmer, pos`` and the block's columns."""
    last = F.least(F.col("b0") + (BLOCK - 1), F.col("plen") - k)
    with_last = blocked.withColumn("last", last).where("last >= b0")
    return with_last.select("protein_num", "plen", "c0", "chunk", F.expr("explode(sequence(b0, last))").alias("pos")).withColumn("kmer", F.expr(f"substr(chunk, pos - c0 + 1, {k})"))


def kmers_among(blocked: DataFrame, k: int, wanted: list[str]) -> DataFrame:
    """Those rows of ``kmers`` whose k-mer is in the list: positions are sorted out inside each block, before any becomes a row."""
    last = F.least(F.col("b0") + (BLOCK - 1), F.col("plen") - k)
    names = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in wanted) or "NULL"
    found = F.expr(f"filter(transform(sequence(b0, last), p -> named_struct('pos', p, 'kmer', substr(chunk, p - c0 + 1, {k}))), x -> x.kmer IN ({names}))")
    return blocked.withColumn("last", last).where("last >= b0").select("protein_num", "plen", "c0", "chunk", F.explode(found).alias("x")).select("protein_num", "plen", "c0", "chunk", "x.pos", "x.kmer")


def _totals(k: int):
    """Of each task: k-mers, their places, and the rows that hold them. Up to three ASCII letters are an index; others are counted by text."""
    dense = 1 << (7 * k) if k <= 3 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, holders = np.zeros(dense, np.int64), np.zeros(dense, np.int64)
        more, rows = Counter(), Counter()

        def out(names: list[str], n: list[int], held: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(held, pa.int64())], names=["kmer", "n", "held"])

        def rest() -> pa.RecordBatch:
            made = out(list(more), list(more.values()), [rows[x] for x in more])
            more.clear(), rows.clear()
            return made

        for batch in batches:
            step = max(1, batch.num_rows * LETTERS // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, step):
                column = batch.column("sequence").slice(i, step)
                plain = plain_bytes(column) if dense else None
                if plain is None:
                    for text in column.to_pylist():
                        own = Counter(text[j : j + k] for j in range(len(text or "") - k + 1))
                        more.update(own)
                        rows.update(own.keys())
                        if len(more) > 1_000_000:
                            yield rest()
                    continue
                raw, offsets = plain
                size = np.diff(offsets)
                row = np.repeat(np.arange(len(size)), np.maximum(size - k + 1, 0))
                if not len(row):
                    continue
                at = np.arange(len(row)) + np.repeat(offsets[:-1] - np.cumsum(np.maximum(size - k + 1, 0)) + np.maximum(size - k + 1, 0), np.maximum(size - k + 1, 0))
                code = np.zeros(len(at), np.int64)
                for j in range(k):
                    code = code << 7 | raw[at + j]
                both, n = np.unique(row * dense + code, return_counts=True)
                code = both % dense
                np.add.at(places, code, n)
                np.add.at(holders, code, 1)
        found = np.flatnonzero(places)
        yield out(["".join(chr((c >> (7 * j)) & 127) for j in reversed(range(k))) for c in found.tolist()], places[found].tolist(), holders[found].tolist())
        yield rest()

    return run


def totals(corpus: DataFrame, k: int) -> DataFrame:
    """``kmer, n, n_sequences``: places of each k-mer, and different sequences that hold it. A task sends one row for each k-mer, not for each place."""
    ids = corpus.agg(F.count("*").alias("rows"), F.countDistinct("protein_num").alias("ids")).first()
    if ids["rows"] != ids["ids"]:
        # Sequences without a number, or with one number, are told apart only by their rows.
        return kmers(blocks(corpus, k), k).groupBy("kmer").agg(F.count("*").alias("n"), F.countDistinct("protein_num").alias("n_sequences"))
    ship(corpus.sparkSession)
    found = corpus.select("sequence").mapInArrow(_totals(k), "kmer string, n long, held long")
    return found.groupBy("kmer").agg(F.sum("n").alias("n"), F.sum("held").alias("n_sequences"))


def offsets(k: int, how: str) -> Column:
    """Seed offsets of ``seq``: ``anchor`` (the first), ``mismatch`` (blocks if k divides the length, else all), ``coverage`` (blocks and the last), ``ends`` (the first and the last)."""
    size = F.length("seq")
    steps, every = F.sequence(F.lit(0), size - k, F.lit(k)), F.sequence(F.lit(0), size - k)
    if how == "anchor":
        return F.array(F.lit(0))
    if how == "mismatch":
        return F.when(size % k == 0, steps).otherwise(every)
    if how == "ends":
        return F.array_distinct(F.array(F.lit(0), size - k))
    return F.array_distinct(F.concat(steps, F.array(size - k)))


def seeds(queries: DataFrame, k: int, how: str) -> DataFrame:
    """``qrow, query_id, seq, off, kmer`` for queries of at least ``k`` characters."""
    long = queries.where(F.length("seq") >= k)
    return long.select("qrow", "query_id", "seq", F.explode(offsets(k, how)).alias("off")).withColumn("kmer", F.expr(f"substr(seq, off + 1, {k})"))
