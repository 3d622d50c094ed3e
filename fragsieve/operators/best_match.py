"""Best match: seeds of falling length until every query has a hit, then one hit by edits and metadata."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .search import least_edits, search

if TYPE_CHECKING:
    from ..sources.index import KmerIndex


def stages(shortest: int) -> list[int]:
    """Seed lengths: the shortest query, halved down to 2."""
    found = [shortest]
    while found[-1] > 2:
        found.append(max(found[-1] // 2, 2))
    return sorted(set(found), reverse=True)


def last_level(frontier: list[tuple[int | None, int]], level: int) -> int:
    """The budget at which deepening ends: it grows by one while it is below the shortest query left, and queries leave with their least edits.

    ``frontier``: the different pairs of least edits (None: no place at all) and length.
    """
    left = list(frontier)
    while left and level < min(size for _, size in left):
        level += 1
        left = [(least, size) for least, size in left if least is None or least > level]
    return level


def best_hits(corpus: DataFrame | None, queries: DataFrame, index: KmerIndex | None = None) -> DataFrame:
    """Hits of the first stage that has any for a query id; queries that leave are not searched again.

    Stages with seeds of falling length, as many as the length can be halved, come
    first. What they leave is decided by one table: the least edits of every query at
    any place with a seed of two letters. From its few different rows follows where a budget
    that grows by one at a time would stop, so one search brings the hits with the
    least edits, instead of one for each budget. Every stage is written; with an ``index`` it is a lookup.
    """
    left, found = written(queries), None

    def shortest() -> int | None:
        return left.agg(F.min(F.length("seq"))).first()[0]

    def leave(hits: DataFrame) -> None:
        nonlocal left, found
        ids = left.join(hits.select("qrow").distinct(), "qrow").select("query_id").distinct()
        found = hits if found is None else found.unionByName(hits)
        left = written(left.join(ids, "query_id", "left_anti").select("qrow", "query_id", "seq"))

    for k in stages(shortest() or 2):
        if (size := shortest()) is None:
            return found
        leave(written(search(corpus, left, k, max(size // k - 1, 0), index)))
    if (size := shortest()) is None:
        return found
    least = left.join(least_edits(corpus, left, 2, index), "qrow", "left")
    by_id = written(least.groupBy("query_id").agg(F.min("least").alias("least"), F.min(F.length("seq")).alias("size")))
    # One row for each pair of edits and length, however many queries there are.
    frontier = [(r["least"], r["size"]) for r in by_id.select("least", "size").distinct().collect()]
    most = last_level(frontier, size // 2)
    wanted = left.join(by_id.where(F.col("least") <= most), "query_id").select("qrow", "query_id", "seq", "least")
    hits = search(corpus, wanted.drop("least"), 2, most, index).join(wanted.select("qrow", "least"), "qrow").where("edits = least").drop("least")
    return found.unionByName(written(hits))


def pick(results: DataFrame, order: list | None = None) -> DataFrame:
    """One row per ``Query ID``: fewest edits, gene priority, no isoform, reviewed, least evidence level, no fragment, first in the corpus."""
    whole = F.coalesce(~F.col("Protein Name").contains("Fragment"), F.lit(False))
    keys = order or [
        F.col("Matched Sequence").isNull(), F.col("Mismatches"), F.desc("Gene Priority"), F.col("Protein ID").contains("-"), F.desc("SwissProt Reviewed"),
        F.col("Protein Existence Level"), F.desc(whole), F.col("protein_num"), F.col("Index start"),
    ]
    return results.withColumn("nth", F.row_number().over(Window.partitionBy("Query ID").orderBy(*keys))).where("nth = 1").drop("nth")
