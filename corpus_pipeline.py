"""From raw documents to packed training sequences, in stages that are each written and read again.

Decisions are made by row, not by ``doc_id``: rows without an id, and different rows
with one id, are judged each by its own text. An empty table stays empty, and columns
that a table of documents has beyond the usual ones are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragsieve.llm.ngram_join import ngram_join
from fragsieve.llm.packing import pack
from fragsieve.llm.queries import vocabulary
from fragsieve.llm.secrets import redacted
from fragsieve.llm.shipping import ship
from fragsieve.llm.tables import scratch, written
from fragsieve.llm.toxicity import without_toxic
from fragsieve.llm.winnowing import decontaminate


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, predicts to be toxic go."""
    ship(spark)
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Keys that are broadcast to the rows that they pick, at most; more are joined by a shuffle.
BROADCAST = 200_000


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a column that tells all rows apart: ``doc_id``, or a key of each row, with which they are written, if ids are missing or repeated."""
    ids = docs.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    if ids["rows"] == ids["ids"]:
        return docs, "doc_id"
    key = "row_key"
    while key in docs.columns:
        key += "_"
    return written(docs.withColumn(key, F.monotonically_increasing_id())), key


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """``rows`` less those whose ``key`` is in ``dropped``."""
    dropped = written(dropped)
    return rows.join(F.broadcast(dropped) if dropped.count() <= BROADCAST else dropped, key, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by their word 5-grams (Jaccard similarity of 0.8 or more), equal rows included, one stays:
    that with the least id (null ids last), of equal ids the first row. Rows without words stay."""
    ship(spark)
    rows, key = keyed(docs)
    joined = ngram_join(rows.select(F.col(key).cast("long").alias("doc_id"), "text"), size=5, percent=80, keyed=True)
    named = joined.join(rows.select(F.col(key).alias("doc_id"), F.col("doc_id").alias("id")), "doc_id") if key != "doc_id" else joined.withColumn("id", F.col("doc_id"))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("doc_id").alias("row"))).alias("first"), F.count("*").alias("n")).where("n > 1")
    dropped = named.join(first.select("component_id", F.col("first.row").alias("row")), "component_id").where("doc_id <> row").select(F.col("doc_id").alias(key))
    return without(rows, dropped, key).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that benchmark passages contaminate go."""
    ship(spark)
    rows, key = keyed(docs)
    with scratch(spark):
        judged = decontaminate(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        dropped = written(judged.where("contaminated").select(F.col("doc_id").alias(key)), keep=True)
    return without(rows, dropped, key).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span is replaced by a mark; all documents stay."""
    ship(spark)
    return redacted(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    ship(spark)
    return pack(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]

#: SQL has no word for the classifier's weights or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        # What a stage wrote on its way goes once its result is written.
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
