"""Metadata columns from FASTA headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags of header fields (fixed values).
SPECIES, TAXON, GENE, VERSION, EXISTENCE = "OS=", "OX=", "GN=", "SV=", "PE="


def record_id(header: Column) -> Column:
    """Between the first two bars, else the first word."""
    parts = F.split(header, r"\|", 3)
    return F.when(F.size(parts) > 2, parts[1]).otherwise(F.coalesce(F.try_element_at(F.split(F.trim(header), r"\s+"), F.lit(1)), F.lit("")))


def record_name(header: Column) -> Column:
    """What follows the first blank, up to `` OS=``."""
    rest = F.regexp_extract(header, r"^\S* (.*)$", 1)
    return F.trim(F.substring_index(rest, " OS=", 1))


def field(header: Column, tag: str) -> Column:
    """The word after the first occurrence of ``tag``."""
    return F.regexp_extract(header, tag + r"(\S*)", 1)


def species(header: Column) -> Column:
    return F.trim(F.regexp_extract(header, SPECIES + r"(.*?)(?: OX=|$)", 1))


def raw_fields(records: DataFrame) -> DataFrame:
    """``records`` (with ``protein_num, header``) and all header fields as strings, before any inheritance."""
    h = F.col("header")
    empty_as = lambda c, v: F.when(c == "", F.lit(v)).otherwise(c)
    pid = record_id(h)
    return records.select(
        "protein_num", pid.alias("protein_id"), record_name(h).alias("protein_name"), species(h).alias("species"), field(h, TAXON).alias("taxon_id"), field(h, GENE).alias("gene"),
        field(h, EXISTENCE).alias("pe"), empty_as(field(h, VERSION), "1").alias("sequence_version"), h.startswith("sp|").alias("swissprot"), pid.contains("-").alias("isoform"), F.substring_index(pid, "-", 1).alias("accession"),
    )


def metadata(records: DataFrame) -> DataFrame:
    """One typed row per record: isoforms inherit the evidence level of their accession, and the first reviewed record of each gene has priority."""
    raw = raw_fields(records)
    canonical = raw.where(~F.col("isoform") & (F.col("pe") != "")).groupBy(F.col("protein_id").alias("accession")).agg(F.max_by("pe", "protein_num").alias("canonical_pe"))
    pe = F.when(F.col("isoform") & F.col("pe").isin("", "0"), F.coalesce("canonical_pe", F.when(F.col("pe") == "", F.lit("0")).otherwise(F.col("pe")))).otherwise(F.when(F.col("pe") == "", F.lit("0")).otherwise(F.col("pe")))
    eligible = F.col("swissprot") & ~F.col("isoform") & (F.col("gene") != "")
    first = raw.where(eligible).groupBy("gene").agg(F.min("protein_num").alias("first_num"))
    null = lambda c: F.when(F.col(c) != "", F.col(c))
    return raw.join(canonical, "accession", "left").join(first, "gene", "left").select(
        "protein_num", null("protein_id").alias("protein_id"), null("protein_name").alias("protein_name"), null("species").alias("species"), null("taxon_id").alias("taxon_id"), null("gene").alias("gene"),
        pe.cast("long").alias("pe_level"), F.col("sequence_version").cast("long").alias("sequence_version"),
        F.coalesce((F.col("protein_num") == F.col("first_num")) & eligible, F.lit(False)).cast("long").alias("gene_priority"), "swissprot",
    )


def versioned_id(use: bool = True) -> Column:
    """``id.version`` where there is a version."""
    pid = F.col("protein_id")
    return F.when(F.col("sequence_version").isNotNull(), F.concat_ws(".", pid, F.col("sequence_version").cast("string"))).otherwise(pid) if use else pid


