import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P

from .test_native import brute as secrets_brute
from .test_ngram_join import brute as groups_brute
from .test_tokens import check_packing
from .test_winnowing import brute as hits_brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = P.toxicity(spark, docs, SF)
    assert clean.columns == docs.columns
    toxic = {r.doc_id for r in docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("toxic = 0").collect()}
    assert toxic <= {r.doc_id for r in clean.collect()}
    rows = {r.doc_id: r for r in clean.collect()}
    one = P.near_duplicates(spark, clean, SF)
    keep = {d for d, _, c in groups_brute([(d, r.text) for d, r in sorted(rows.items())], 5, 80) if d == c}
    assert {r.doc_id for r in one.collect()} == keep and one.columns == docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    left = P.decontamination(spark, one, SF)
    keep -= {h[0] for h in hits_brute([(d, rows[d].text) for d in keep], items) if h[-1]}
    assert {r.doc_id for r in left.collect()} == keep
    safe = P.secret_scan(spark, left, SF).collect()
    assert {r.doc_id for r in safe} == keep
    for r in safe:
        assert ("[SECRET]" in r.text) == bool(secrets_brute(rows[r.doc_id].text)[4]) and r.n_chars == len(r.text)


def test_run_packs_what_is_left(spark):
    packed = P.run(spark, SF).collect()
    ids = sorted({r.doc_id for r in packed})
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(texts) == ids
    number = {d: i for i, d in enumerate(ids)}
    from pyspark.sql import Row

    rows = [Row(**{**r.asDict(), "doc_id": number[r.doc_id]}) for r in packed]
    check_packing(rows, [texts[d] for d in ids], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 2048)


def test_near_copies_by_five_words(spark):
    words = [f"w{i}" for i in range(2000)]
    changed = lambda at, n: " ".join("other" if i in at else w for i, w in enumerate(words[1000 : 1000 + n]))
    docs = [(1, " ".join(words[:800])), (2, " ".join(words[:980])), (3, changed((), 50)), (4, changed((25,), 50)), (5, changed((), 45)), (6, None), (7, " ".join(words[1500:1540]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {d for d, _, c in groups_brute(docs, 5, 80) if d == c}
    assert {r.doc_id for r in P.near_duplicates(spark, df, SF).collect()} == want == {1, 3, 6, 7}
    assert {2, 4} <= {d for d, _, c in groups_brute(docs) if d == c}


def test_rows_without_ids_with_one_id_and_more_columns(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    near = [f"w{i}" for i in range(100)]
    docs = [
        (None, item, "a"), (1, "plain words of no interest at all", "b"), (1, "plain words of no interest at all", "c"), (1, item, "d"), (1, "quite another text under the same id", "e"),
        (None, " ".join(near), "f"), (9, " ".join([*near, "end"]), "g"), (None, None, "h"), (None, "", "i"), (4, None, "j"), (3, "plain words of no interest at all", "k"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, row_key string").coalesce(1)
    one = P.near_duplicates(spark, df, SF)
    assert one.columns == df.columns
    rows = sorted(r.row_key for r in one.collect())
    # Of the two benchmark copies that with an id stays; of equal rows the first; of the near copies that with an id.
    assert [k for k in rows if k not in "bc"] == ["d", "e", "g", "h", "i", "j"] and len(rows) == 7
    left = P.decontamination(spark, df, SF)
    assert sorted(r.row_key for r in left.collect()) == list("bcefghijk") and left.columns == df.columns
    assert P.near_duplicates(spark, df.where("false"), SF).collect() == [] == P.decontamination(spark, df.where("false"), SF).collect()
    more = df.withColumn("n_chars", F.length("text").cast("long"))
    assert P.secret_scan(spark, more, SF).columns == more.columns and P.toxicity(spark, df, SF).columns == df.columns
    assert P.toxicity(spark, df.where("false"), SF).collect() == []
