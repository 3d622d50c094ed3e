"""The search operators over the driver tables, with SQL for each.

Documents are the corpus (letters A-Z of the upper-cased text), whole benchmark items
give the queries: all their letters, in successive pieces, with some letters
overwritten, removed or added. Queries named ``_whole`` have the same result as those
without, and come to it through an index of the corpus, which they build first.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions.letters import letters
from ..operators import kmers as K
from ..operators import search as S
from ..operators.scan import exact_scan as scan
from ..sources.segments import SegmentIndex
from ..sources.shared import scratch_path, spread

LOW, UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _letters(c: str):
    return letters(F.col(c))


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts_of(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, of which the searches' tasks pick the letters themselves."""
    return spread(_read(spark, sf, "documents").select(F.col("doc_id").alias("protein_num"), F.col("text").alias("sequence")))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return texts_of(spark, sf).withColumn("sequence", _letters("sequence"))


def _pieces(spark: SparkSession, sf: str, seq: str, size: int, least: int = 5) -> DataFrame:
    """Whole item texts in successive pieces of ``size`` letters; ``qrow`` is the item and the number of the piece.

    A rest of fewer than ``least`` letters, too short for a seed, stays at the end of the piece before.
    Items without letters are one empty piece.
    """
    count = f"greatest((length(x) + {size - least}) div {size}, 1)"
    cut = f"transform(sequence(0, {count} - 1), i -> CASE WHEN i + 1 < {count} THEN substr(x, CAST(i * {size} + 1 AS int), {size}) ELSE substr(x, CAST(i * {size} + 1 AS int)) END)"
    base = _read(spark, sf, "benchmark").select("item_id", _letters("text").alias("x")).select("item_id", F.posexplode(F.expr(cut)).alias("piece", "w"))
    return base.select(F.struct("item_id", "piece").alias("qrow"), F.col("item_id").cast("string").alias("query_id"), F.expr(seq).alias("seq"))


#: None, one or two letters of long pieces overwritten; with the same text as SQL for the other engine.
SUBSTITUTED = "CASE WHEN length(w) < 11 OR (item_id + piece) % 3 = 0 THEN w WHEN (item_id + piece) % 3 = 1 THEN concat(left(w, 3), 'X', substr(w, 5)) ELSE concat(left(w, 3), 'X', substr(w, 5, 6), 'Z', substr(w, 12)) END"
#: One letter of long pieces removed, or one added, or none.
EDITED = "CASE WHEN length(w) < 9 OR (item_id + piece) % 3 = 0 THEN w WHEN (item_id + piece) % 3 = 1 THEN concat(left(w, 7), substr(w, 9)) ELSE concat(left(w, 6), 'X', substr(w, 7)) END"


def _index(spark: SparkSession, sf: str) -> SegmentIndex:
    """An index of the corpus in the shared folder, removed with the session."""
    return SegmentIndex(spark, scratch_path(spark), lambda: texts_of(spark, sf), only_letters=True)


def _hits(hits: DataFrame) -> DataFrame:
    """Hits of pieces."""
    return hits.select("qrow.item_id", "qrow.piece", *(F.col(c).cast("long").alias(c) for c in ("protein_num", "st")), "matched", F.col("edits").cast("long").alias("edits"), "mutated")


def _near(texts: DataFrame | None, queries: DataFrame, k: int, most: int, index: SegmentIndex | None) -> DataFrame:
    return S.search(texts, queries, k, most, index, letters=True)


def _exact(texts: DataFrame | None, queries: DataFrame, index: SegmentIndex | None = None) -> DataFrame:
    """Exact hits of queries of any length."""
    return _near(texts, queries, 1, 0, index)


def _indels(texts: DataFrame | None, queries: DataFrame, index: SegmentIndex | None = None) -> DataFrame:
    """The seeds' length follows from the shortest query, so long and short pieces are searched apart."""
    size, found = F.length("seq"), []
    for some in (size >= 15, (size >= 7) & (size < 15), size < 7):
        rows = queries.where(some)
        if not found or not rows.isEmpty():
            found.append(S.indel_search(texts, rows, index, letters=True))
    return functools.reduce(DataFrame.unionByName, found)


def _both(search: Callable[[DataFrame | None, SegmentIndex | None, SparkSession, str], DataFrame]) -> tuple[Callable, Callable]:
    """A query over the texts, and one through an index of them."""
    return (lambda spark, sf: search(texts_of(spark, sf), None, spark, sf)), (lambda spark, sf: search(None, _index(spark, sf), spark, sf))


def _with_misses(hits: DataFrame, queries: DataFrame) -> DataFrame:
    return queries.join(hits, "qrow", "left").select("qrow.item_id", "qrow.piece", "query_id", "seq", F.col("protein_num").cast("long").alias("protein_num"), F.col("st").cast("long").alias("st"), F.coalesce("mutated", F.lit("[]")).alias("mutated"))


def _counted(texts: DataFrame | None, index: SegmentIndex | None, queries: DataFrame) -> DataFrame:
    return S.counts(_near(texts, queries, 5, 2, index), queries)


def _best(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Fewest substitutions, then the documents' labels in place of metadata. Each task sends only its best hit of a piece on."""
    labels = labels.select(F.col("doc_id").alias("protein_num"), "quality", "toxic")
    full = hits.join(labels, "protein_num", "left")
    order = F.struct(F.col("edits").cast("long").alias("edits"), (-F.coalesce("quality", F.lit(-1))).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), "protein_num", F.col("st").cast("long").alias("st"))
    return full.groupBy("qrow").agg(F.min(order).alias("x")).select("qrow.item_id", "qrow.piece", "x.protein_num", "x.edits", "x.st")


def _recall(exact: DataFrame, near: DataFrame) -> DataFrame:
    """Share of the hits of the tolerant search that the exact one finds, on distinct rows. Both are sent once, and each search runs once."""
    key = ["qrow", "protein_num", "st"]
    hits = exact.select(*key, F.lit(True).alias("exact")).unionByName(near.select(*key, F.lit(False).alias("exact")))
    distinct = hits.groupBy(*key).agg(F.bool_or("exact").alias("found"), F.bool_or(~F.col("exact")).alias("expected")).where("expected")
    return distinct.agg(F.count_if("found").alias("n"), F.count("*").alias("m")).select(F.round(F.least(F.lit(100.0), F.try_divide(100.0 * F.col("n"), F.col("m"))), 6).alias("recall"))


def _changed(spark: SparkSession, sf: str, least: int = 5) -> DataFrame:
    return _pieces(spark, sf, SUBSTITUTED, 15, least)


exact_search, exact_search_whole = _both(lambda texts, index, spark, sf: _hits(_exact(texts, _pieces(spark, sf, "w", 15), index)))
exact_search_with_misses, exact_search_with_misses_whole = _both(lambda texts, index, spark, sf: _with_misses(_exact(texts, _changed(spark, sf), index), _changed(spark, sf)))
mismatch_search, mismatch_search_whole = _both(lambda texts, index, spark, sf: _hits(_near(texts, _changed(spark, sf), 5, 2, index)))
#: More substitutions than the seeds guarantee to find: an intact run of 7 is part of the rule.
mismatch_search_seed_bound, mismatch_search_seed_bound_whole = _both(lambda texts, index, spark, sf: _hits(_near(texts, _changed(spark, sf, 7), 7, 6, index)))
counts_only, counts_only_whole = _both(lambda texts, index, spark, sf: _counted(texts, index, _changed(spark, sf)))
indel_search, indel_search_whole = _both(lambda texts, index, spark, sf: _hits(_indels(texts, _pieces(spark, sf, EDITED, 16, 8), index)))
best_match, best_match_whole = _both(lambda texts, index, spark, sf: _best(_near(texts, _changed(spark, sf), 5, 2, index), _read(spark, sf, "labels")))
recall, recall_whole = _both(lambda texts, index, spark, sf: _recall(_exact(texts, _changed(spark, sf), index), _near(texts, _changed(spark, sf), 5, 2, index)))
mixed_union, mixed_union_whole = _both(
    lambda texts, index, spark, sf: _hits(_exact(texts, _pieces(spark, sf, "w", 15), index)).unionByName(discontinuous_search(spark, sf).withColumnRenamed("qrow", "item_id").withColumn("piece", F.lit(None).cast("int")))
)


def exact_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same hits as ``exact_search``, by one automaton in one pass."""
    return _hits(scan(corpus(spark, sf), _pieces(spark, sf, "w", 15)))


def exact_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of exact hits of pieces of 5 letters and more, counted by an index."""
    queries = _pieces(spark, sf, "w", 15)
    return S.named_counts(S.exact_counts(queries, 5, _index(spark, sf)), queries).groupBy("Query ID", "Query Sequence", "Mismatches").agg(F.sum("Count").alias("Count"))


#: Letters and positions taken from the first document, one of them wrong in the second query.
ANCHORED = [(1, "A1, N2, B3, L4"), (2, "A1, N2, X3"), (3, "E5, W6, H7"), (4, "T1, H2, S3, T4")]
#: The begin of a text, up to its letter at the last of these positions (or all of it): no query looks beyond.
FRONT = "^(?:[^A-Za-z]*[A-Za-z]){0,%d}" % max(int(p[1:]) for _, s in ANCHORED for p in s.split(", "))


def discontinuous_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(i, str(i), s) for i, s in ANCHORED] + [(9, "9", "PLAIN")], "qrow long, query_id string, seq string")
    anchored, _ = S.discontinuous_queries(rows)
    fronts = texts_of(spark, sf).withColumn("sequence", letters(F.regexp_extract(F.coalesce("sequence", F.lit("")), FRONT, 0)))
    found = S.discontinuous_search(fronts, anchored, 1)
    return found.select(*(F.col(c).cast("long").alias(c) for c in ("qrow", "protein_num", "st")), "matched", F.col("edits").cast("long").alias("edits"), "mutated")


def clean_query_anti(spark: SparkSession, sf: str) -> DataFrame:
    items = _read(spark, sf, "benchmark").select(F.col("item_id").alias("qrow"), (F.col("item_id") % 11).cast("string").alias("query_id"), F.when(F.col("item_id") % 5 == 0, F.lit("R3, Q40")).otherwise(F.col("text")).alias("seq"))
    return S.discontinuous_queries(items)[1].select("qrow", "query_id", "seq")


def kmer_counts(spark: SparkSession, sf: str) -> DataFrame:
    parts = spread(_read(spark, sf, "part").select("p_partkey", "p_name")).select(F.col("p_partkey").alias("protein_num"), _letters("p_name").alias("sequence"))
    return K.totals(parts, 3)


def kmer_counts_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The same over the corpus of all other queries."""
    return K.totals(corpus(spark, sf), 3)


def _seeds(size: int, k: int, how: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return K.seeds(_pieces(spark, sf, "w", size), k, how).select("qrow.item_id", "qrow.piece", F.col("off").cast("long").alias("off"), "kmer")

    return query


#: Headers made of part columns, with isoforms, missing fields and both kinds of databases.
HEADER = """concat(CASE WHEN p_partkey % 4 = 0 THEN 'tr|' ELSE 'sp|' END, 'P', lpad(CAST(p_partkey - p_partkey % 2 AS {s}), 6, '0'), CASE WHEN p_partkey % 2 = 1 THEN '-2' ELSE '' END, '|ENTRY ', p_name,
  ' OS=', p_brand, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(' OX=', CAST(p_size AS {s})) END, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat(' GN=G', CAST(p_partkey % 40 AS {s})) END,
  CASE WHEN p_partkey % 2 = 1 THEN '' ELSE concat(' PE=', CAST(p_size % 5 AS {s})) END, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(' SV=', CAST(p_size % 3 + 1 AS {s})) END)"""


def _headers(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "part").select(F.col("p_partkey").alias("protein_num"), F.expr(HEADER.format(s="string")).alias("header"))


def header_fields(spark: SparkSession, sf: str) -> DataFrame:
    return H.raw_fields(_headers(spark, sf)).select("protein_num", "protein_id", "protein_name", "species", "taxon_id", "gene", "pe", "sequence_version", "swissprot", "isoform", "accession")


def header_metadata(spark: SparkSession, sf: str) -> DataFrame:
    meta = H.metadata(_headers(spark, sf))
    return meta.select("protein_num", "pe_level", "gene_priority", "taxon_id", H.versioned_id().alias("versioned_id"))


_CORPUS = f"c AS (SELECT doc_id protein_num, regexp_replace(translate(coalesce(text, ''), '{LOW}', '{UP}'), '[^A-Z]', '', 'g') s FROM documents)"


_X = f"regexp_replace(translate(coalesce(text, ''), '{LOW}', '{UP}'), '[^A-Z]', '', 'g')"


def _q(seq: str, size: int, least: int = 5) -> str:
    """Pieces of whole items."""
    return f"""i AS (SELECT item_id, {_X} x FROM benchmark), n AS (SELECT *, greatest((length(x) + {size - least}) // {size}, 1) AS n FROM i),
p AS (SELECT item_id, piece::INTEGER piece, CASE WHEN piece + 1 < n THEN substr(x, piece::INT * {size} + 1, {size}) ELSE substr(x, piece::INT * {size} + 1) END w FROM (SELECT *, unnest(range(0, n)) piece FROM n)),
q AS (SELECT item_id, piece, item_id::VARCHAR query_id, {seq} seq FROM p)"""


#: The corpus in blocks of 256 letters with some that follow, so that no long text is searched for each of its places.
_CHUNKS = f"{_CORPUS}, h AS MATERIALIZED (SELECT protein_num, plen, b, substr(s, b::INT * 256 + 1, 320) chunk FROM (SELECT protein_num, s, length(s) plen, unnest(range(0, (length(s) + 255) // 256)) b FROM c WHERE s <> ''))"


def _places(sizes: str, name: str = "g") -> str:
    """Every k-letter string of the corpus, for each size of ``sizes``."""
    return f"{name}_size AS (SELECT DISTINCT size FROM ({sizes}) WHERE size > 0), {name} AS (SELECT protein_num, plen, size, b * 256 + i pos, substr(chunk, i::INT + 1, size::INT) g FROM (SELECT *, unnest(range(0, least(256, plen - b * 256 - size + 1))) i FROM h, {name}_size))"


#: Candidates ``item_id, piece, seq, protein_num, st, size`` with their windows.
_CUT = "SELECT x.*, substr(chunk, (st % 256)::INT + 1, size::INT) win FROM {} x JOIN h ON h.protein_num = x.protein_num AND h.b = x.st // 256 WHERE st + size <= plen"
_MUTATED = "'[' || array_to_string(list_filter(range(1, length(seq) + 1), lambda i: substr(seq, i::INT, 1) <> substr(win, i::INT, 1)), ', ') || ']'"


def _exact_sql(seq: str, size: int = 15) -> str:
    """Windows ``w`` that equal a piece, found by its first five letters."""
    return f"""{_CHUNKS}, {_q(seq, size)}, {_places("SELECT least(5, length(seq)) size FROM q")},
o AS (SELECT item_id, piece, query_id, seq, protein_num, pos st, length(seq) size FROM g JOIN q ON g = left(seq, 5)), w AS (SELECT * FROM ({_CUT.format("o")}) WHERE win = seq)"""


def _near_sql(most: int, k: int) -> str:
    """Windows ``near`` within the budget at which a seed of k letters stands: blocks where k divides the length, else any."""
    return f"""{_CHUNKS}, {_q(SUBSTITUTED, 15, k)}, {_places(f"SELECT {k} size")},
e AS (SELECT item_id, piece, seq, off, substr(seq, off::INT + 1, {k}) g FROM (SELECT *, unnest(range(0, length(seq) - {k} + 1, CASE WHEN length(seq) % {k} = 0 THEN {k} ELSE 1 END)) off FROM q WHERE length(seq) >= {k})),
o AS (SELECT DISTINCT item_id, piece, seq, protein_num, pos - off st, length(seq) size FROM g JOIN e USING (g) WHERE pos >= off AND pos - off + length(seq) <= plen),
near AS (SELECT item_id, piece, seq, protein_num, st, win matched, hamming(win, seq)::BIGINT edits, {_MUTATED} mutated FROM ({_CUT.format("o")}) WHERE hamming(win, seq) <= {most})"""


_EXACT = "SELECT item_id, piece, protein_num, st, win matched, 0::BIGINT edits, '[]' mutated FROM w"
_NUM = "item_id, piece, protein_num, st, matched, edits, mutated"
_ANCHORED = " UNION ALL ".join(
    f"SELECT {i} qrow, protein_num, {parts[0][1:]} - 1 st, concat_ws(', ', {', '.join(f"concat(substr(s, {p[1:]}, 1), '{p[1:]}')" for p in parts)}) matched, list_filter([{', '.join(f"CASE WHEN substr(s, {p[1:]}, 1) <> '{p[0]}' THEN {p[1:]} END" for p in parts)}], lambda x: x IS NOT NULL) wrong FROM c WHERE length(s) >= {max(int(p[1:]) for p in parts)}"
    for i, parts in ((i, s.split(", ")) for i, s in ANCHORED)
)
_DISCONTINUOUS = f"SELECT qrow::BIGINT qrow, protein_num, st::BIGINT st, matched, len(wrong)::BIGINT edits, '[' || array_to_string(wrong, ', ') || ']' mutated FROM ({_ANCHORED}) WHERE len(wrong) <= 1"


def _seed_sql(size: int, k: int, offs: str) -> str:
    return f"WITH {_q('w', size)} SELECT item_id, piece, off::BIGINT off, substr(seq, off::INT + 1, {k}) kmer FROM (SELECT item_id, piece, seq, unnest({offs}) off FROM q WHERE length(seq) >= {k})"


# One half of a query stands before or after its edit; of it four letters, or all of a short one, find the place.
_HALF = "least(4, length(seq) // 2)"
_INDEL = f"""
WITH {_CHUNKS}, {_q(EDITED, 16, 8)}, {_places(f"SELECT {_HALF} size FROM q")},
f AS (SELECT item_id, piece, seq, protein_num, plen, pos FROM g JOIN q ON g = left(seq, size::INT) AND size = {_HALF}),
r AS (SELECT item_id, piece, seq, protein_num, plen, pos + {_HALF} stop FROM g JOIN q ON g = right(seq, size::INT) AND size = {_HALF}),
o AS (SELECT DISTINCT * FROM (SELECT item_id, piece, seq, protein_num, pos st, length(seq) + d size FROM f, (SELECT unnest([-1, 0, 1]) d) UNION ALL SELECT item_id, piece, seq, protein_num, stop - length(seq) - d, length(seq) + d FROM r, (SELECT unnest([-1, 1]) d)) WHERE st >= 0),
w AS ({_CUT.format("o")})
SELECT item_id, piece, protein_num, st, win matched, abs(size - length(seq))::BIGINT edits, '[]' mutated FROM w WHERE CASE
  WHEN size = length(seq) THEN win = seq AND length(seq) > 1
  WHEN size < length(seq) THEN length(seq) > 3 AND len(list_filter(range(1, length(seq) - 1), lambda i: left(seq, i::INT) || substr(seq, i::INT + 2) = win)) > 0
  ELSE length(seq) > 2 AND len(list_filter(range(1, length(seq)), lambda i: left(win, i::INT) || substr(win, i::INT + 2) = seq)) > 0 END
"""
_FIELDS = f"""
h AS (SELECT p_partkey protein_num, {HEADER.format(s='varchar')} header FROM part),
f AS (SELECT protein_num, split_part(header, '|', 2) protein_id, trim(split_part(regexp_extract(header, '^[^ ]* (.*)$', 1), ' OS=', 1)) protein_name, trim(regexp_extract(header, 'OS=(.*?)( OX=|$)', 1)) species,
  regexp_extract(header, 'OX=([^ ]*)', 1) taxon_id, regexp_extract(header, 'GN=([^ ]*)', 1) gene, regexp_extract(header, 'PE=([^ ]*)', 1) pe,
  CASE WHEN regexp_extract(header, 'SV=([^ ]*)', 1) = '' THEN '1' ELSE regexp_extract(header, 'SV=([^ ]*)', 1) END sequence_version,
  starts_with(header, 'sp|') swissprot, contains(split_part(header, '|', 2), '-') isoform, split_part(split_part(header, '|', 2), '-', 1) accession FROM h)"""


def oracle_sql() -> dict[str, str]:
    near = lambda most, k=5: f"WITH {_near_sql(most, k)}"
    exact = f"WITH {_exact_sql('w')} {_EXACT}"
    counts = lambda texts, name: f"WITH {_CHUNKS.replace(_CORPUS, f'c AS (SELECT {name} protein_num, {texts})')}, {_places('SELECT 3 size')} SELECT g kmer, count(*) n, count(DISTINCT protein_num) n_sequences FROM g GROUP BY g"
    found = {
        "exact_search": exact,
        "exact_search_with_misses": f"WITH {_exact_sql(SUBSTITUTED)} SELECT q.item_id, q.piece, q.query_id, q.seq, protein_num, st, '[]' mutated FROM q LEFT JOIN w ON w.item_id = q.item_id AND w.piece = q.piece",
        "mismatch_search": f"{near(2)} SELECT {_NUM} FROM near",
        "mismatch_search_seed_bound": f"{near(6, 7)} SELECT {_NUM} FROM near",
        "counts_only": f"""{near(2)} SELECT item_id::VARCHAR "Query ID", seq "Query Sequence", edits "Mismatches", count(*) "Count" FROM near GROUP BY item_id, piece, seq, edits""",
        "indel_search": _INDEL,
        "discontinuous_search": f"WITH {_CORPUS} {_DISCONTINUOUS}",
        "clean_query_anti": "WITH i AS (SELECT item_id qrow, (item_id % 11)::VARCHAR query_id, CASE WHEN item_id % 5 = 0 THEN 'R3, Q40' ELSE text END seq FROM benchmark) SELECT * FROM i WHERE query_id NOT IN (SELECT query_id FROM i WHERE regexp_full_match(seq, '.[0-9]+(, .[0-9]+)*'))",
        "best_match": f"{near(2)} SELECT item_id, piece, protein_num, edits, st FROM (SELECT near.*, row_number() OVER (PARTITION BY item_id, piece ORDER BY edits, coalesce(quality, -1) DESC, coalesce(toxic, -1), protein_num, st) r FROM near LEFT JOIN labels ON doc_id = protein_num) WHERE r = 1",
        "mixed_union": f"SELECT * FROM ({exact}) UNION ALL SELECT qrow, NULL, protein_num, st, matched, edits, mutated FROM (WITH {_CORPUS} {_DISCONTINUOUS})",
        # An exact hit of 5 letters and more has an intact seed.
        "recall": f"{near(2)} SELECT round(least(100.0::DOUBLE, 100.0::DOUBLE * count(*) FILTER (edits = 0) / count(*)), 6) recall FROM near",
        "kmer_counts": counts(f"{_X.replace('text', 'p_name')} s FROM part", "p_partkey"),
        "kmer_counts_whole": counts(f"{_X} s FROM documents", "doc_id"),
        "exact_scan": exact,
        "exact_counts": f"""WITH {_exact_sql('w')} SELECT item_id::VARCHAR "Query ID", seq "Query Sequence", 0::BIGINT "Mismatches", count(*) "Count" FROM w WHERE length(seq) >= 5 GROUP BY item_id, seq""",
        "seeds_block": _seed_sql(15, 5, "range(0, length(seq) - 4, CASE WHEN length(seq) % 5 = 0 THEN 5 ELSE 1 END)"),
        "seeds_sliding": _seed_sql(15, 4, "range(0, length(seq) - 3, CASE WHEN length(seq) % 4 = 0 THEN 4 ELSE 1 END)"),
        "seeds_coverage": _seed_sql(15, 4, "list_distinct(list_concat(range(0, length(seq) - 3, 4), [length(seq) - 4]))"),
        "header_fields": f"WITH {_FIELDS} SELECT * FROM f",
        "header_metadata": f"""WITH {_FIELDS},
k AS (SELECT protein_id accession, arg_max(pe, protein_num) canonical FROM f WHERE NOT isoform AND pe <> '' GROUP BY 1),
g AS (SELECT protein_num, row_number() OVER (PARTITION BY gene ORDER BY protein_num) r FROM f WHERE swissprot AND NOT isoform AND gene <> '')
SELECT protein_num, CAST(CASE WHEN isoform AND pe IN ('', '0') AND canonical IS NOT NULL THEN canonical WHEN pe = '' THEN '0' ELSE pe END AS BIGINT) pe_level, coalesce((r = 1)::BIGINT, 0) gene_priority,
  nullif(taxon_id, '') taxon_id, protein_id || '.' || sequence_version versioned_id FROM f LEFT JOIN k USING (accession) LEFT JOIN g USING (protein_num)""",
    }
    return found | {f"{name}_whole": found[name] for name in WHOLE if f"{name}_whole" not in found}


#: Queries that have a twin by another way to the same rows, or by another name.
WHOLE = ["exact_search", "exact_search_with_misses", "mismatch_search", "mismatch_search_seed_bound", "counts_only", "indel_search", "best_match", "recall", "mixed_union", "clean_query_anti", "kmer_counts", "seeds_block", "seeds_sliding", "seeds_coverage"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "exact_search": exact_search, "exact_search_with_misses": exact_search_with_misses, "mismatch_search": mismatch_search, "mismatch_search_seed_bound": mismatch_search_seed_bound,
        "counts_only": counts_only, "indel_search": indel_search, "discontinuous_search": discontinuous_search, "clean_query_anti": clean_query_anti, "best_match": best_match, "mixed_union": mixed_union,
        "recall": recall, "kmer_counts": kmer_counts, "seeds_block": _seeds(15, 5, "mismatch"), "seeds_sliding": _seeds(15, 4, "mismatch"), "seeds_coverage": _seeds(15, 4, "coverage"),
        "header_fields": header_fields, "header_metadata": header_metadata, "exact_scan": exact_scan, "exact_counts": exact_counts,
        "exact_search_whole": exact_search_whole, "exact_search_with_misses_whole": exact_search_with_misses_whole, "mismatch_search_whole": mismatch_search_whole,
        "mismatch_search_seed_bound_whole": mismatch_search_seed_bound_whole, "counts_only_whole": counts_only_whole, "indel_search_whole": indel_search_whole, "best_match_whole": best_match_whole,
        "recall_whole": recall_whole, "mixed_union_whole": mixed_union_whole, "kmer_counts_whole": kmer_counts_whole,
    }
    # These always took whole items where they were named so.
    return found | {f"{name}_whole": found[name] for name in WHOLE if f"{name}_whole" not in found}
