"""The search API: preprocessing, and one entry for all modes."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import versioned_id
from ..operators import best_match as best
from ..operators import search as S
from ..sources.index import CorpusIndex
from ..sources.readers import queries as read_queries
from ..sources.sinks import FORMATS, write_file

log = logging.getLogger(__name__)


def result_frame(queries: DataFrame, hits: DataFrame, meta: DataFrame, edit: str = "Mismatches", version: bool = True, keep_num: bool = False) -> DataFrame:
    """The 15 result columns: a row for each hit, and one for each query without any."""
    end = F.col("en") if "en" in hits.columns else F.col("st") + F.length("matched")
    named = hits.withColumn("end_", end.cast("long")).join(meta, "protein_num", "left")
    full = queries.select("qrow", "query_id", "seq").join(named, "qrow", "left")
    columns = [
        F.col("query_id").alias("Query ID"), F.col("seq").alias("Query Sequence"), F.col("matched").alias("Matched Sequence"), versioned_id(version).alias("Protein ID"),
        F.col("protein_name").alias("Protein Name"), F.col("species").alias("Species"), F.col("taxon_id").alias("Taxon ID"), F.col("gene").alias("Gene"), F.col("edits").cast("long").alias(edit),
        F.coalesce("mutated", F.lit("[]")).alias("Mutated Positions"), (F.col("st") + 1).cast("long").alias("Index start"), F.col("end_").alias("Index end"),
        F.col("pe_level").alias("Protein Existence Level"), F.col("gene_priority").alias("Gene Priority"), F.col("swissprot").alias("SwissProt Reviewed"),
    ]
    return full.select(*columns, *(["protein_num"] if keep_num else []))


def best_frame(queries: DataFrame, hits: DataFrame, meta: DataFrame, version: bool = True, by_id: bool = True) -> DataFrame:
    """The result with the best hit only: hits decide for a query id as a whole.

    Without any hit each query row stays; with ``by_id`` only if no other row of its id has one.
    """
    full = result_frame(queries, hits, meta, version=version, keep_num=True)
    hit = F.col("Matched Sequence").isNotNull()
    missed = full.where(~hit)
    if by_id:
        missed = missed.join(full.where(hit).select("Query ID").distinct(), "Query ID", "left_anti").select(*full.columns)
    return best.pick(full.where(hit)).unionByName(missed).drop("protein_num")


class Preprocessor:
    """Builds the tables of a corpus file for one k."""

    def __init__(self, spark: SparkSession, proteome: str, proteome_name: str = "", preprocessed_files_path: str = "."):
        self.index = CorpusIndex(spark, proteome, preprocessed_files_path, proteome_name)

    def preprocess(self, k: int) -> DataFrame:
        self.index.metadata()
        self.index.sequence_blocks()
        self.index.frequencies(k)
        return self.index.kmers(k)


class Matcher:
    """One search; parameters are checked here, before any Spark job runs a search."""

    def __init__(self, spark: SparkSession, query: object, proteome_file: str, max_mismatches: int = 0, max_indels: int = 0, k: int = 0, preprocessed_files_path: str = ".", best_match: bool = False, output_format: str = "dataframe", output_name: str = "", sequence_version: bool = True, counts_only: bool = False):
        if k and k < 2:
            raise ValueError("k must be at least 2")
        if max_mismatches < 0 or max_indels < 0:
            raise ValueError("edit budgets can't be negative")
        if max_indels > 1:
            raise ValueError("at most one insertion or deletion is supported")
        if max_indels and (max_mismatches or best_match or counts_only):
            raise ValueError("max_indels excludes max_mismatches, best_match and counts_only")
        if output_format not in FORMATS:
            raise ValueError(f"the output format must be one of {FORMATS}")
        if counts_only and best_match:
            raise ValueError("counts_only excludes best_match")
        self.auto = best_match and not k
        self.k = k or 5
        self.mismatches, self.indels, self.best, self.counts = max_mismatches, max_indels, best_match, counts_only
        self.format, self.name, self.version = output_format, output_name or "search_results", sequence_version
        self.index = CorpusIndex(spark, proteome_file, preprocessed_files_path)
        self.anchored, self.linear = S.discontinuous_queries(read_queries(spark, query))
        if max_indels and not self.anchored.isEmpty():
            raise ValueError("max_indels excludes position-anchored queries")

    def _linear(self, corpus: DataFrame, meta: DataFrame) -> DataFrame:
        if self.indels:
            return result_frame(self.linear, S.indel_search(corpus, self.linear, self.index), meta, "Indels", self.version)
        hits = best.best_hits(corpus, self.linear, self.index) if self.auto else S.search(corpus, self.linear, self.k, self.mismatches, self.index)
        if not self.best:
            return result_frame(self.linear, hits, meta, version=self.version)
        return best_frame(self.linear, hits, meta, self.version, self.auto)

    def frame(self) -> DataFrame:
        """The result, not written."""
        corpus, meta = self.index.proteins(), self.index.metadata()
        if self.counts:
            if not self.anchored.isEmpty():
                log.warning("position-anchored queries are not counted")
            if not self.mismatches:
                return S.named_counts(S.exact_counts(self.linear, self.k, self.index), self.linear)
            return S.counts(S.search(None, self.linear, self.k, self.mismatches, self.index), self.linear)
        parts = []
        if not self.linear.isEmpty():
            parts.append(self._linear(corpus, meta))
        if not self.anchored.isEmpty():
            parts.append(result_frame(self.anchored, S.discontinuous_search(corpus, self.anchored, self.mismatches), meta, version=self.version))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def match(self) -> DataFrame | None:
        """The frame, or None once it is written to a file."""
        if self.format == "dataframe":
            return self.frame()
        write_file(self.frame(), self.format, self.name)
        return None
