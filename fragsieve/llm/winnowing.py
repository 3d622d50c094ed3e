"""Benchmark decontamination by winnowed word fingerprints.

Of every ``window`` - ``gram`` + 1 successive word ``gram``s the one with the least
hash is kept (the rightmost of equals), on both sides. Two texts that share
``window`` words share the fingerprint of that span, at the same place in it, so
every shared span of that length or more is found. A hit is then extended to both
sides, as far as the words around the fingerprint agree and a window can reach.
Items of fewer words than a window are one gram of their own length.

Documents are read once, in Python, and give only fingerprints that may be in the
benchmark; the join, the union of spans and the digests are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytespans as B
from .tables import texts, written

#: Bytes of words: not \\x00-\\x2F, \\x3A-\\x60, \\x7B-\\x7F (fixed values).
MEMBER = B.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Words around a fingerprint beyond a text's end; never equal to each other.
_OUTSIDE = {"item": np.uint64(1), "document": np.uint64(2)}


def winnow(h: np.ndarray, doc: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (first words) and hashes of the kept ``gram``s of all texts in the arrays."""
    g, span = B.gram_hashes(h, gram), window - gram + 1
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows = np.lib.stride_tricks.sliding_window_view(g, span)[:, ::-1]
    whole = np.flatnonzero(doc[: len(rows)] == doc[window - 1 : window - 1 + len(rows)])
    kept = np.unique(whole + span - 1 - rows[whole].argmin(axis=1))
    return kept, g[kept]


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``n``-word grams, hashed apart from those that are winnowed."""
    g = B.gram_hashes(h, n)
    at = np.flatnonzero(doc[: len(g)] == doc[n - 1 : n - 1 + len(g)])
    return at, B.mixed(g[at] ^ np.uint64(0x5BD1E995))


def around(h: tuple[np.ndarray, np.ndarray], doc: np.ndarray, at: np.ndarray, gram: int, window: int, side: str) -> np.ndarray:
    """The words that windows with the fingerprint can hold, row by row, each by both of its hashes (128 bits)."""
    reach = window - gram
    places = at[:, None] + np.arange(-reach, window)
    inside = (places >= 0) & (places < len(doc))
    places = np.clip(places, 0, max(len(doc) - 1, 0))
    inside &= doc[places] == doc[at][:, None]
    return np.concatenate([np.where(inside, v[places], _OUTSIDE[side]) for v in h], axis=1)


def fingerprints(side: str, gram: int, window: int, short: list[int], within: object = None):
    """A function for mapInArrow: rows of ``doc_id, text`` to ``row, doc_id, n_words`` and lists of fingerprints.

    ``within``: a broadcast sorted array of hashes that are of use; None keeps all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for part, data, offs in B.blocks(batches):
            h, second, doc = B.word_hashes(data, offs, MEMBER)
            n_words = np.bincount(doc, minlength=part.num_rows)
            first = np.cumsum(n_words) - n_words
            at, keys = winnow(h, doc, gram, window)
            found = [(at, keys, np.full(len(at), window))]
            if side == "item":  # an item of fewer words is one gram
                for n in np.unique(n_words[(n_words > 0) & (n_words < window)]):
                    at, keys = grams(h, doc, int(n))
                    own = n_words[doc[at]] == n
                    found.append((at[own], keys[own], np.full(int(own.sum()), n)))
            else:
                found += [(at, keys, np.full(len(at), n)) for n in short for at, keys in [grams(h, doc, n)]]
            at, keys, size = (np.concatenate(x) for x in zip(*found, strict=True))
            if within is not None:
                known = within.value
                slot = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                use = known[slot] == keys if len(known) else np.zeros(len(keys), bool)
                at, keys, size = at[use], keys[use], size[use]
            order = np.argsort(at, kind="stable")
            at, keys, size = at[order], keys[order], size[order]
            context = around((h, second), doc, at, gram, window, side).astype("<u8")
            width = context.shape[1] * 8
            n, owner = part.num_rows, doc[at] if len(at) else np.zeros(0, np.int64)
            bytes_ = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(at), [None, pa.py_buffer(np.ascontiguousarray(context).tobytes())]).cast(pa.binary())
            offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
            prints = pa.StructArray.from_arrays([pa.array(keys.view(np.int64)), pa.array((at - first[owner]).astype(np.int32)), pa.array(size.astype(np.int32)), bytes_], names=["key", "at", "size", "around"])
            yield pa.RecordBatch.from_arrays([pa.array(B.row_keys(row, n)), part.column("doc_id"), pa.array(n_words), pa.ListArray.from_arrays(offsets, prints)], names=["row", "doc_id", "n_words", "prints"])
            row += n

    return run


_SCHEMA = "row long, doc_id long, n_words long, prints array<struct<key: long, at: int, size: int, around: binary>>"


def extended(gram: int, window: int):
    """A function for mapInArrow: pairs of equal fingerprints to the document's words that they show to be hit."""
    reach = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(n, 2, window + reach) for c in ("around", "item_around"))
            same = (a == b).all(axis=1)
            left = np.logical_and.accumulate(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
            right = np.logical_and.accumulate(same[:, reach:], axis=1).sum(axis=1)
            size, at = batch.column("size").to_numpy().astype(np.int64), batch.column("at").to_numpy().astype(np.int64)
            long = size == window
            ok = np.where(long, (right >= gram) & (left + right >= window), right >= size)
            start, end = np.where(long, at - left, at), np.where(long, at + right, at + size)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(keep), batch.column("item_row").filter(keep), pa.array(start[ok]), pa.array(end[ok])], names=["row", "item_row", "start", "stop"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, gram: int = 7, share: int = 20, bound: int = 1 << 28, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``.

    A document's word is hit if it lies in an occurrence of ``window`` successive
    words of an item, or of a whole shorter item. ``contaminated``: some word is
    hit and ``share`` times the hit words are at least all words. Null and empty
    texts have no words, and items without words hit nothing. Equal rows of either
    table count each; an empty table of items leaves all documents clean; other
    columns are ignored.

    ``bound``: item fingerprints with the words around them are broadcast, as a
    filter and for the join, as long as they take no more than so many bytes;
    beyond, the join is a shuffle of both sides.
    """
    spark = docs.sparkSession
    item_table = written(
        texts(items, item_id_col, item_text_col)
        .mapInArrow(fingerprints("item", gram, window, []), _SCHEMA)
        .select(F.col("row").alias("item_row"), F.col("doc_id").alias("item_id"), F.explode("prints").alias("p"))
        .select("item_row", "item_id", "p.key", F.col("p.size").alias("item_size"), F.col("p.around").alias("item_around"))
    )
    short = sorted(r[0] for r in item_table.where(F.col("item_size") < window).select("item_size").distinct().collect())  # fewer than ``window`` values
    small = item_table.count() * (16 * (2 * window - gram) + 40) <= bound
    within = None
    if small:
        keys = item_table.select("key").distinct().toArrow().column("key").to_numpy()  # a part of ``bound``
        within = spark.sparkContext.broadcast(np.unique(keys.astype(np.int64).view(np.uint64)))
    printed = written(texts(docs, id_col, text_col).mapInArrow(fingerprints("document", gram, window, short, within), _SCHEMA))
    each = printed.select("row", F.explode("prints").alias("p")).select("row", "p.*")
    hits = (
        each.join(F.broadcast(item_table) if small else item_table, (each["key"] == item_table["key"]) & (each["size"] == item_table["item_size"]))
        .select("row", "item_row", "at", "size", "around", "item_around")
        .mapInArrow(extended(gram, window), "row long, item_row long, start long, stop long")
    )
    hits = written(hits.distinct())
    in_order = Window.partitionBy("row").orderBy("start", "stop")
    before = F.coalesce(F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = (
        hits.select("row", "start", "stop").distinct()
        .select("row", F.greatest(F.col("stop") - F.greatest("start", before), F.lit(0)).alias("fresh"))
        .groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    )
    ids = item_table.select("item_row", "item_id").distinct()
    items_of = (
        hits.select("row", "item_row").distinct()
        .join(F.broadcast(ids) if small else ids, "item_row")
        .groupBy("row").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    )
    out = printed.select("row", "doc_id", "n_words").join(hit, "row", "left").join(items_of, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
