"""Shards in random order by a two-pass external shuffle; DataFrame functions only.

The first pass scatters records over buckets by a seeded hash of their row, so that
each bucket is a uniform share of all records and fits into a task's memory. The
second pass puts each bucket, a partition of its own, into random order (Fisher-Yates).
Buckets in turn are one random order of all records, which is cut into shards
whose numbers of rows differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Bytes that a bucket has on average, and that a row takes besides its values.
BUCKET_BYTES, ROW_BYTES = 64 << 20, 64


def _free(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def external_shuffle(rows: DataFrame, weight: Column | None = None, seed: int = 1, bucket_bytes: int = BUCKET_BYTES, place: str = "place") -> tuple[DataFrame, int]:
    """``rows`` with their 0-based ``place`` (long) in one random order, and how many they are.

    ``weight``: bytes of a row's values, for the number of buckets (none: rows of a few
    numbers). The same seed over the same files gives the same order. Repeated rows
    are scattered one by one, so that no value, however often it occurs, makes a
    bucket large; only one row longer than ``bucket_bytes`` does. Partitions hold
    successive places, sorted. The records are written once, after the first pass,
    so that counts and places are of the same buckets when a task is run again.
    """
    bucket, key, packed, at = (_free(c, rows.columns) for c in ("__bucket", "__key", "__packed", "__at"))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.coalesce((F.lit(0) if weight is None else weight).cast("long"), F.lit(0))).alias("bytes")).first()
    buckets = max(1, -(-((total["bytes"] or 0) + ROW_BYTES * total["n"]) // bucket_bytes))
    keyed = rows.select(F.monotonically_increasing_id().alias(key), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias(packed))
    scattered = written(keyed.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(buckets)).cast("int")))
    # One row for each bucket: a millionth of the records, and fewer.
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = scattered.groupBy(bucket).agg(F.count("*").alias("n")).select(bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(at))
    # Collected values come in any order: they are sorted by their keys before they are shuffled.
    ordered = f"array_sort(collect_list(struct(`{key}`, `{packed}`)), (a, b) -> CASE WHEN a.`{key}` < b.`{key}` THEN -1 WHEN a.`{key}` > b.`{key}` THEN 1 ELSE 0 END)"
    dealt = scattered.repartitionById(buckets, bucket).groupBy(bucket).agg(F.expr(ordered).alias(packed)).withColumn(packed, F.shuffle(packed, seed))
    dealt = dealt.join(F.broadcast(counts) if buckets <= 1_000_000 else counts, bucket).select(at, F.posexplode(packed).alias("__i", "__x"))
    return dealt.select(*(F.col(f"__x.`{packed}`.`{c}`").alias(c) for c in rows.columns), (F.col(at) + F.col("__i")).alias(place)), total["n"]


def _dealt(placed: DataFrame, place: str, n: int, count: int, shard: str, slot: str) -> DataFrame:
    """``placed`` with shard and slot instead of its place: successive places make up a shard, and the first ``n % count`` shards have one row more."""
    low, more = divmod(n, count)
    edge, low_ = more * (low + 1), max(low, 1)
    of = f"CASE WHEN `{place}` < {edge} THEN `{place}` div {low + 1} ELSE {more} + (`{place}` - {edge}) div {low_} END"
    at = f"CASE WHEN `{place}` < {edge} THEN `{place}` % {low + 1} ELSE (`{place}` - {edge}) % {low_} END"
    return placed.withColumns({shard: F.expr(of).cast("int"), slot: F.expr(at).cast("long")}).drop(place)


def assign(docs: DataFrame, shards: int = 24, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``, texts themselves left where they are.

    The law is ``rows``: shards differ by one row at most; ``slot`` is the row's place
    in its shard, from 0 on. ``size``: UTF-8 bytes of the text plus 8 (null texts have
    none). Null and repeated ids are rows like others; with fewer rows than shards,
    the last shards are empty; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed, n = external_shuffle(rows, None, seed, bucket_bytes)
    dealt = _dealt(placed, "place", n, shards, "shard", "slot")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 1, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes whole records, every column as it is, as Parquet folders ``shard=0``, ``shard=1``, ... under ``path``.

    Each task shuffles one bucket and writes it to the few shards that it reaches, so
    that files of a shard by name, and rows in them, are in the order of ``slot``. Shards
    without rows have no folder. A column ``shard`` or ``slot`` of ``docs`` keeps its
    name; the new one gets a longer one then.
    """
    shard = _free("shard", docs.columns)
    slot, place = _free("slot", [*docs.columns, shard]), _free("place", docs.columns)
    placed, n = external_shuffle(docs, F.octet_length(F.col(f"`{text_col}`").cast("string")), seed, bucket_bytes, place)
    _dealt(placed, place, n, shards, shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
