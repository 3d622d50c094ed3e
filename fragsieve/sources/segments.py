"""An index for many queries at once: segments of text, each with its places sorted by the letters that follow.

A segment is made by one task from its own rows, so building it sends no row through a
shuffle, and seeds of any length up to eight letters are ranges of one order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.letters import letters, letters_in
from .shipping import ship
from .storage import published, qualified

#: Letters that a block of a segment owns, those that follow, and letters of a segment: its places are 16-bit numbers.
BLOCK, HALO, SEGMENT = 32_768, 1024, 65_536
SCHEMA = "chunks array<string>, nums array<long>, begins array<int>, owned array<int>, places binary"


def sorted_places(text: str) -> bytes | None:
    """All places of ``text`` by the eight letters from there on; None (searches then look at every place) if it isn't ASCII."""
    if not text.isascii():
        return None
    padded = np.concatenate([np.frombuffer(text.encode(), np.uint8), np.zeros(8, np.uint8)])
    words = np.ndarray((len(text),), ">u8", padded, strides=(1,)).astype(np.uint64)
    return np.argsort(words, kind="stable").astype("<u2").tobytes()


def _segment(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    nums, begins, chunks = zip(*rows, strict=True)
    columns = [pa.array([chunks], pa.list_(pa.string())), pa.array([nums], pa.list_(pa.int64())), pa.array([begins], pa.list_(pa.int32())), pa.array([[BLOCK] * len(rows)], pa.list_(pa.int32())), pa.array([sorted_places("".join(chunks))], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["chunks", "nums", "begins", "owned", "places"])


def _made(only_letters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            texts = batch.column("sequence")
            for num, text in zip(batch.column("protein_num").to_pylist(), (letters_in(texts) if only_letters else texts).to_pylist(), strict=True):
                for begin in range(0, len(text or ""), BLOCK):
                    chunk = text[begin : begin + BLOCK + HALO]
                    if size + len(chunk) > SEGMENT:
                        yield _segment(rows)
                        rows, size = [], 0
                    rows.append((num, begin, chunk))
                    size += len(chunk)
        if rows:
            yield _segment(rows)

    return run


class SegmentIndex:
    """Segments of the sequences of ``make()`` (``protein_num, sequence``; with ``only_letters`` of their upper-cased letters A to Z), made once under ``folder``.

    Every query is looked up in every segment, so this is for many queries;
    ``KmerIndex`` reads only the pages of a few.
    """

    halo = HALO

    def __init__(self, spark: SparkSession, folder: str, make, only_letters: bool = False):
        self.spark, self.folder, self._make, self.only_letters = spark, qualified(spark, folder), make, only_letters

    def proteins(self) -> DataFrame:
        made = self._make()
        return made.withColumn("sequence", letters(F.col("sequence"))) if self.only_letters else made

    def segments(self) -> DataFrame:
        def build(own: str) -> None:
            ship(self.spark)
            self._make().select(F.col("protein_num").cast("long").alias("protein_num"), "sequence").mapInArrow(_made(self.only_letters), SCHEMA).write.option("compression", "zstd").parquet(own)

        return self.spark.read.parquet(published(self.spark, f"{self.folder}/segments", build))
