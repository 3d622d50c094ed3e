"""Streams of queries against a fixed corpus or its index: a stateless search of every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import search
from ..plans.matcher import result_frame
from ..sources.index import KmerIndex


def search_stream(queries: DataFrame, corpus: DataFrame | KmerIndex, meta: DataFrame, sink: str, checkpoint: str, k: int = 5, max_mismatches: int = 0) -> StreamingQuery:
    """Each batch of ``query_id, seq`` gives its results as Parquet under ``sink``, in a folder of the batch's number, so that a repeated batch replaces itself.

    With an index, a batch looks up its seeds' postings and the blocks of text that
    hold a candidate; the sequences are never read whole. Every batch's seeds are
    counted before they are broadcast. Query rows are numbered by their values, so that a batch that is run
    again has the same numbers.
    """
    index = corpus if isinstance(corpus, KmerIndex) else None
    if index is not None:
        index.kmers(k), index.frequencies(k), index.sequence_blocks()  # made before the first batch

    def run(batch: DataFrame, number: int) -> None:
        once = batch.select("query_id", F.upper("seq").alias("seq")).groupBy("query_id", "seq").agg(F.count("*").alias("copies"))
        each = once.select("query_id", "seq", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        rows = each.select(F.struct("query_id", "seq", "copy").alias("qrow"), "query_id", "seq").persist()
        found = result_frame(rows, search(None if index else corpus, rows, k, max_mismatches, index), meta)
        found.toDF(*(c.replace(" ", "_") for c in found.columns)).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        rows.unpersist()

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
