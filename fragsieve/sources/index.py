"""A corpus kept for lookups: sequences, metadata, and postings of k-mers, under the corpus' content hash.

Every table is sorted by its key and dealt to files by ranges of it, with small pages:
a lookup lists only the files whose range holds a key, from a table of split points,
and Parquet's page index leaves out the pages that don't. Tables are published by a
rename, in any store that Spark writes to.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import metadata
from ..operators.kmers import blocks, kmers
from ..operators.search import SEQUENCE_BLOCK
from .readers import fasta
from .storage import exists, published, qualified

#: Rows of a page, and of a file on average.
PAGE_ROWS, FILE_ROWS = 1024, 8_000_000
#: Ranges of keys that a lookup pushes to the files; more keys share ranges.
RANGES = 64


def content_key(rows: DataFrame) -> str:
    """Names the rows' content, whatever their order and partitions: the tasks hash rows, and only sums reach the driver."""
    every = [F.col(f"`{c}`") for c in rows.columns]
    sums = rows.agg(F.count("*"), F.bit_xor(F.xxhash64(F.lit(1), *every)), F.sum(F.xxhash64(F.lit(2), *every).cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr(tuple(sums)).encode()).hexdigest()[:16]


def key_ranges(keys: list, most: int = RANGES) -> list[tuple]:
    """Sorted keys as at most ``most`` ranges (first and last key), one for each key if they are few."""
    size = max(1, -(-len(keys) // most))
    return [(keys[i], keys[min(i + size, len(keys)) - 1]) for i in range(0, len(keys), size)]


def _any(conditions: list[Column]) -> Column:
    """Their disjunction as a balanced tree: the optimizer's work on a chain would grow with the square of its length."""
    if len(conditions) < 2:
        return conditions[0] if conditions else F.lit(False)
    half = len(conditions) // 2
    return _any(conditions[:half]) | _any(conditions[half:])


class KmerIndex:
    """Lookups in the sequences of ``make()`` (``protein_num, sequence``), whose tables are made once under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, make=None):
        self.spark, self.folder, self._make = spark, qualified(spark, folder), make

    def _table(self, name: str, make) -> DataFrame:
        return self.spark.read.parquet(published(self.spark, f"{self.folder}/{name}", lambda own: make().write.parquet(own)))

    def _sorted(self, name: str, make, *order: str, wide: int = 1) -> DataFrame:
        """A table by ranges of ``order``, and beside it the table of its files' first and last keys. ``wide``: how many times as large as a posting a row is."""

        def build(own: str) -> None:
            rows = make()
            files = max(self.spark.sparkContext.defaultParallelism, rows.count() * wide // FILE_ROWS)
            rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.option("parquet.page.row.count.limit", max(1, PAGE_ROWS // wide)).parquet(own)
            ends = self.spark.read.parquet(own).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("rows"))
            # Hidden, so that a reader of the folder doesn't take it for rows.
            ends.write.parquet(f"{own}/_splits")

        return self.spark.read.parquet(published(self.spark, f"{self.folder}/{name}", build))

    def _lookup(self, table: DataFrame, name: str, key: str, keys: list, within: Column | None = None) -> DataFrame:
        """Rows of ``table`` in the pages that may hold one of the sorted ``keys``: a superset of the rows asked for."""
        ranges = key_ranges(keys)
        if not ranges:
            return table.where("false")
        path = f"{self.folder}/{name}"
        hold = _any([(F.col("first") <= b) & (F.col("last") >= a) for a, b in ranges])
        files = [r["file"] for r in self.spark.read.parquet(f"{path}/_splits").where(hold).select("file").limit(10_001).collect()]
        some = self.spark.read.schema(table.schema).parquet(*(f"{path}/{f}" for f in files)) if 0 < len(files) <= 10_000 else table
        return some.where(within if within is not None else _any([F.col(key) == a if a == b else F.col(key).between(a, b) for a, b in ranges]))

    def proteins(self) -> DataFrame:
        return self._table("proteins", self._make)

    def kmers(self, k: int, wanted: list[str] | None = None) -> DataFrame:
        """``kmer, protein_num, pos`` of all k-mers, or of the pages that hold those ``wanted``. A frequent k-mer reaches over several files."""
        if k < 2:
            raise ValueError("k must be at least 2")
        name = f"postings_{k}"
        table = self._sorted(name, lambda: kmers(blocks(self.proteins(), k), k).select("kmer", "protein_num", "pos"), "kmer", "protein_num", "pos")
        return table if wanted is None else self._lookup(table, name, "kmer", sorted(wanted))

    def frequencies(self, k: int, wanted: list[str] | None = None) -> DataFrame:
        """``kmer, n``: how many places each k-mer has."""
        name = f"frequencies_{k}"
        table = self._sorted(name, lambda: self.kmers(k).groupBy("kmer").agg(F.count("*").alias("n")), "kmer")
        return table if wanted is None else self._lookup(table, name, "kmer", sorted(wanted))

    def sequence_blocks(self, wanted: list[tuple[int, int]] | None = None) -> DataFrame:
        """``protein_num, block, plen, chunk``: the text in blocks, each with as many letters after those that it owns; all, or of the pages that hold the ``wanted`` blocks."""
        size = SEQUENCE_BLOCK
        cut = f"transform(sequence(0, (length(sequence) - 1) div {size}), b -> named_struct('block', b, 'chunk', substr(sequence, CAST(b * {size} + 1 AS int), {2 * size})))"
        make = lambda: self.proteins().where("length(sequence) > 0").select("protein_num", F.length("sequence").alias("plen"), F.explode(F.expr(cut)).alias("x")).select("protein_num", F.col("x.block").cast("int").alias("block"), "plen", "x.chunk")
        table = self._sorted("blocks", make, "protein_num", "block", wide=64)
        if wanted is None:
            return table
        places = sorted(wanted)
        within = _any([(F.col("protein_num") == p) & F.col("block").between(a, b) if p == q else F.col("protein_num").between(p, q) for (p, a), (q, b) in key_ranges(places)])
        return self._lookup(table, "blocks", "protein_num", [p for p, _ in places], within)


class CorpusIndex(KmerIndex):
    """The index of a FASTA corpus in any store: ``folder/name-content``; changed content gets another folder.

    ``kmers_k`` tables of earlier versions aren't read.
    """

    def __init__(self, spark: SparkSession, path: str, folder: str = ".", name: str = ""):
        if not exists(spark, path):
            raise FileNotFoundError(f"no such corpus file: {path}")
        self.path, self.name = path, name or path.rstrip("/").rpartition("/")[2].split(".")[0]
        super().__init__(spark, f"{folder}/{self.name}-{content_key(fasta(spark, path))}", lambda: fasta(spark, path))

    def metadata(self) -> DataFrame:
        return self._table("metadata", lambda: metadata(self.proteins()))
