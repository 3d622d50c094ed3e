import zlib
from collections import Counter

from pyspark.sql import functions as F

from fragsieve.llm.sharding import assign, external_shuffle, write_shards


def check(rows, docs, shards):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    slots = {}
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(sizes) - min(sizes) <= 1


def table(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, shard string, slot int")


def test_counts_slots_and_values(spark):
    docs = [(i, f"text {i} é" * (i % 7)) for i in range(1000)] + [(7, "same")] * 400 + [(None, None)] * 30 + [(2000, ""), (2001, "long " * 50_000)]
    for size in (1 << 26, 9000):
        check(assign(table(spark, docs), bucket_bytes=size).collect(), docs, 24)


def test_few_and_no_rows(spark):
    check(assign(table(spark, [(1, "a"), (2, None)])).collect(), [(1, "a"), (2, None)], 24)
    assert assign(table(spark, [(1, "a")]).where("false")).collect() == []


def test_order_is_random_and_follows_the_seed(spark):
    rows = spark.range(6000).repartition(5, "id")
    order = lambda seed, size: [r.id for r in external_shuffle(rows, None, seed, size)[0].orderBy("place").collect()]
    one = order(1, 64 * 1000)
    assert one == order(1, 64 * 1000) != order(2, 64 * 1000) and sorted(one) == list(range(6000))
    # No order is left: neighbours, and the mean of each tenth, are those of a random order.
    assert sum(abs(a - b) == 1 for a, b in zip(one, one[1:], strict=False)) < 12
    assert all(2600 < sum(one[i : i + 600]) / 600 < 3400 for i in range(0, 6000, 600))
    # Copies are spread like other rows: 300 equal rows of 6000 over 24 shards.
    places = [r.place for r in external_shuffle(rows.select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("id")), None, 3, 64 * 1000)[0].where("id = 0").collect()]
    assert max(Counter(p // 250 for p in places).values()) < 30


def test_written_shards_hold_whole_records(spark, tmp_path):
    docs = [(i, f"text {i}") for i in range(300)] + [(None, None)]
    write_shards(table(spark, docs), str(tmp_path / "out"), shards=7, bucket_bytes=5000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {"doc_id", "text", "shard", "slot", "shard_", "slot_"} and {r.n for r in back.groupBy("shard_").agg(F.count("*").alias("n")).collect()} == {43}
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(docs)
    for s in range(7):
        files = sorted((tmp_path / "out" / f"shard_={s}").glob("*.parquet"))
        assert [r.slot_ for f in files for r in spark.read.parquet(str(f)).collect()] == list(range(43))
