"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(links: DataFrame, most: int = 50) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``) that isn't its own root; the root is the least node of the component.

    Each round links every node's larger neighbours to its least one, then the node
    and its smaller neighbours; the number of rounds grows with the logarithm of
    the number of nodes. Neighbours are never gathered: only minima are joined.
    The rounds end when every node has one edge, to a node that has none itself.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most):
        several = edges.groupBy("u").count().where("count > 1").select("u")
        inner = edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi")
        if several.unionByName(inner).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, both["u"] == least["k"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(least, large["u"] == least["k"])
        edges = written(small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    raise RuntimeError("the components did not settle")
