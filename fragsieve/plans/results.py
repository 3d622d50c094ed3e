"""Whole results over the driver tables: metadata, staged best match, and files written and read again; with SQL for each.

Parts are the corpus (letters of their names, with headers made of their columns),
names of nations and words of parts the queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as H
from ..operators import best_match as best
from ..operators import search as S
from ..sources.readers import fasta
from ..sources.readers import queries as read_queries
from ..sources.shared import scratch_path, spread
from ..sources.sinks import read_json_file, write_file, write_parts
from .matcher import best_frame, result_frame
from .queries import _FIELDS, LOW, UP, _headers, _letters, _read


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    # A million parts are a file of a few MB, which would be one task.
    return spread(_read(spark, sf, "part").select("p_partkey", "p_name")).select(F.col("p_partkey").alias("protein_num"), _letters("p_name").alias("sequence"))


#: Words of part names, in those of 6 or 9 letters the third one overwritten.
WORD = "CASE WHEN length(x) IN (6, 9) THEN concat(left(x, 2), 'X', substr(x, 4)) ELSE x END"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """Queries: the names of all nations, and the different words of all part names; numbered by a hash of their ids."""
    nations = _read(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("query_id"), _letters("n_name").alias("seq"))
    words = _read(spark, sf, "part").select(F.explode(F.split("p_name", "[^A-Za-z]+")).alias("x")).select(_letters("x").alias("x")).where("x <> ''").distinct()
    both = nations.unionByName(words.select(F.concat(F.lit("w"), "x").alias("query_id"), F.expr(WORD).alias("seq")))
    return both.select(F.xxhash64("query_id").alias("qrow"), "query_id", "seq")


def metadata_join(spark: SparkSession, sf: str) -> DataFrame:
    """All result columns of hits with at most one substitution, and a row for each query without any."""
    queries = _named(spark, sf)
    return result_frame(queries, S.search(_corpus(spark, sf), queries, 2, 1), H.metadata(_headers(spark, sf)))


def best_match_staged(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds of falling length until each query has a hit, then one hit by edits and metadata."""
    queries = _named(spark, sf)
    return best_frame(queries, best.best_hits(_corpus(spark, sf), queries), H.metadata(_headers(spark, sf)))


def fasta_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All documents written as FASTA, in lines of 60 letters, and read again."""
    record = F.concat(F.lit(">D"), F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("source", F.lit("")), F.lit("\n"), F.regexp_replace(_letters("text"), "(.{60})", "$1\n"))
    path = scratch_path(spark)
    _read(spark, sf, "documents").select(record.alias("value")).write.text(path)
    return fasta(spark, path).select("header", "sequence")


def _parts(fmt: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        result, path = metadata_join(spark, sf), scratch_path(spark)
        write_parts(result, fmt, path)
        reader = spark.read.schema(result.schema)
        return reader.json(path) if fmt == "json" else reader.csv(path, header=True, sep="\t" if fmt == "tsv" else ",", escape='"')

    return query


def fasta_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of the documents' records, written as FASTA in the order of their ids and read again over all splits."""
    path = scratch_path(spark)
    rows = _read(spark, sf, "documents").select("doc_id", F.concat(F.lit(">D"), F.col("doc_id").cast("string"), F.lit("\n"), _letters("text")).alias("value"))
    rows.orderBy("doc_id").select("value").write.text(path)
    return fasta(spark, path).select("protein_num", "header", F.length("sequence").cast("long").alias("letters"))


def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries from text files: a line for each part's name, with blank lines between some."""
    path = f"{scratch_path(spark)}.txt"
    name = F.concat(F.lit(" "), "p_name", F.lit("\t"))
    lines = _read(spark, sf, "part").select("p_partkey", F.explode(F.when(F.col("p_partkey") % 5 == 3, F.array(F.lit("  "), name)).otherwise(F.array(name))).alias("value"))
    lines.orderBy("p_partkey").select("value").write.text(path)
    return read_queries(spark, path).withColumn("query_id", F.concat(F.lit("q"), "query_id"))


def _one_file(fmt: str):
    """The result as one file in the shared folder, read again."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        result = metadata_join(spark, sf)
        path, reader = write_file(result, fmt, scratch_path(spark)), spark.read.schema(result.schema)
        return read_json_file(spark, path, result.schema) if fmt == "json" else reader.csv(path, header=True, sep="\t" if fmt == "tsv" else ",", quote='"', escape='"')

    return query


def hamming_search(spark: SparkSession, sf: str) -> DataFrame:
    """All places within 0 to 3 substitutions, whatever seeds stand there."""
    queries, found = _named(spark, sf), None
    for most in range(4):
        hits = S.hamming_search(_corpus(spark, sf), queries, most).join(queries.select("qrow", "query_id"), "qrow").select(F.lit(most).alias("budget"), "query_id", "protein_num", F.col("st").cast("long").alias("st"), "matched", F.col("edits").cast("long").alias("edits"), "mutated")
        found = hits if found is None else found.unionByName(hits)
    return found


_LETTERS = f"regexp_replace(translate(coalesce({{}}, ''), '{LOW}', '{UP}'), '[^A-Z]', '', 'g')"
_META = f"""{_FIELDS},
k AS (SELECT protein_id accession, arg_max(pe, protein_num) canonical FROM f WHERE NOT isoform AND pe <> '' GROUP BY 1),
g AS (SELECT protein_num, row_number() OVER (PARTITION BY gene ORDER BY protein_num) r FROM f WHERE swissprot AND NOT isoform AND gene <> ''),
m AS (SELECT protein_num, protein_id || '.' || sequence_version pid, protein_name, isoform, nullif(species, '') species, nullif(taxon_id, '') taxon_id, nullif(gene, '') gene,
  CAST(CASE WHEN isoform AND pe IN ('', '0') AND canonical IS NOT NULL THEN canonical WHEN pe = '' THEN '0' ELSE pe END AS BIGINT) pe_level, coalesce((r = 1)::BIGINT, 0) gene_priority, swissprot
  FROM f LEFT JOIN k USING (accession) LEFT JOIN g USING (protein_num)),
c AS (SELECT p_partkey protein_num, {_LETTERS.format("p_name")} s FROM part),
q AS (SELECT 'n' || n_nationkey query_id, {_LETTERS.format("n_name")} seq FROM nation
  UNION ALL SELECT 'w' || x, {WORD} FROM (SELECT DISTINCT translate(unnest(regexp_split_to_array(p_name, '[^A-Za-z]+')), '{LOW}', '{UP}') x FROM part) WHERE x <> ''),
w AS (SELECT query_id, seq, protein_num, st, substr(s, st::INT + 1, length(seq)) win FROM (SELECT query_id, seq, protein_num, s, unnest(range(0, length(s) - length(seq) + 1)) st FROM c, q WHERE length(s) >= length(seq)))"""
_COLUMNS = """q.query_id "Query ID", q.seq "Query Sequence", win "Matched Sequence", pid "Protein ID", protein_name "Protein Name", species "Species", taxon_id "Taxon ID", gene "Gene", hamming(win, q.seq)::BIGINT "Mismatches",
  CASE WHEN win IS NULL THEN '[]' ELSE '[' || array_to_string(list_filter(range(1, length(q.seq) + 1), lambda i: substr(q.seq, i::INT, 1) <> substr(win, i::INT, 1)), ', ') || ']' END "Mutated Positions",
  st + 1 "Index start", st + length(win) "Index end", pe_level "Protein Existence Level", gene_priority "Gene Priority", swissprot "SwissProt Reviewed\""""
# Places that a seed of two letters finds: seeds are blocks where 2 divides the length.
_SEEDED = "len(list_filter(range(1, length(seq), CASE WHEN length(seq) % 2 = 0 THEN 2 ELSE 1 END), lambda i: substr(seq, i::INT, 2) = substr(win, i::INT, 2))) > 0"
_RESULT = f"WITH {_META}, n AS (SELECT * FROM w WHERE hamming(win, seq) <= 1 AND {_SEEDED}) SELECT {_COLUMNS} FROM q LEFT JOIN n ON n.query_id = q.query_id LEFT JOIN m ON m.protein_num = n.protein_num"
# The least edits of any such place.
_BEST = f"""WITH {_META}, n AS (SELECT * FROM w WHERE {_SEEDED}),
r AS (SELECT n.*, row_number() OVER (PARTITION BY query_id ORDER BY hamming(win, seq), gene_priority DESC, isoform, swissprot DESC, pe_level, NOT contains(protein_name, 'Fragment') DESC, n.protein_num, st) nth FROM n JOIN m ON m.protein_num = n.protein_num)
SELECT {_COLUMNS} FROM q LEFT JOIN (SELECT * FROM r WHERE nth = 1) n ON n.query_id = q.query_id LEFT JOIN m ON m.protein_num = n.protein_num"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"metadata_join": metadata_join, "best_match_staged": best_match_staged, "fasta_round_trip": fasta_round_trip, "fasta_numbers": fasta_numbers, "text_queries": text_queries, "hamming_search": hamming_search, **{f"{fmt}_parts": _parts(fmt) for fmt in ("csv", "tsv", "json")}, **{f"{fmt}_file": _one_file(fmt) for fmt in ("csv", "tsv", "json")}}


def oracle_sql() -> dict[str, str]:
    records = f"SELECT trim('D' || doc_id || ' ' || coalesce(source, '')) header, {_LETTERS.format('text')} \"sequence\" FROM documents"
    numbers = f"SELECT row_number() OVER (ORDER BY doc_id) protein_num, 'D' || doc_id header, length({_LETTERS.format('text')}) letters FROM documents"
    lines = "SELECT r qrow, 'q' || r query_id, upper(trim(p_name)) seq FROM (SELECT row_number() OVER (ORDER BY p_partkey) r, p_name FROM part)"
    near = f"""WITH {_META} SELECT budget, query_id, protein_num, st, win matched, hamming(win, seq)::BIGINT edits,
  '[' || array_to_string(list_filter(range(1, length(seq) + 1), lambda i: substr(seq, i::INT, 1) <> substr(win, i::INT, 1)), ', ') || ']' mutated FROM w, (SELECT unnest([0, 1, 2, 3])::INTEGER budget) WHERE hamming(win, seq) <= budget"""
    return {
        "metadata_join": _RESULT, "best_match_staged": _BEST, "fasta_round_trip": records, "fasta_numbers": numbers, "text_queries": lines, "hamming_search": near,
        **{f"{fmt}_{how}": _RESULT for fmt in ("csv", "tsv", "json") for how in ("parts", "file")},
    }
