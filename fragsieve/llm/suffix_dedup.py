"""Removal of long strings that repeat anywhere in a corpus, by hash-compared suffix sorting.

Every window of ``length`` bytes holds an anchor: the place with the least hash of
a ``gram``-byte string among the window's, chosen by content alone, so that equal
windows have their anchor at the same place. What surrounds an anchor, so far as
the windows with it reach, is known by its digest at first. Anchors whose gram is
unique are dropped, and surroundings that occur as a whole more than once are
settled; bytes are fetched only for grams that have different surroundings, once
for each of these.

They are gathered by gram. A gram with very many surroundings is split, as often as
needed: every window reaches further on one side of the bytes that are known to be
equal, so those that share still more bytes to the left go to one group, those that
share more to the right to another.

In a task the suffixes from the anchors on are merge-sorted; two of them are
compared by a binary search for their longest common extension with prefix
polynomial hashes, and the order is verified by bytes. A neighbour's extension
tells which windows can occur twice; these are compared by hash, and equal ones by
their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytespans as B
from .tables import texts, written

_LOW = np.uint64((1 << 28) - 1)


def anchors(prefix: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all anchors of a block's texts, their grams' hashes, and the first and last start of the windows of each. Of equal hashes the rightmost counts."""
    n, span = len(prefix) - 1, length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n - gram + 1)
    h = B.span_hashes(prefix, at, at + gram)
    value = (h & ~_LOW) | (_LOW - (at.astype(np.uint64) & _LOW))
    rows = -(-len(value) // span)
    padded = np.full(rows * span, np.uint64(2**64 - 1))
    padded[: len(value)] = value
    grid = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - length + 1)
    least = np.minimum(behind[: len(starts)], ahead[span - 1 : span - 1 + len(starts)])
    doc_end = np.repeat(offs[1:], np.diff(offs))[: len(starts)]
    starts = starts[starts + length <= doc_end]
    least = least[starts]
    run = np.flatnonzero(np.r_[True, least[1:] != least[:-1]]) if len(least) else np.zeros(0, np.int64)
    first, last = starts[run], starts[np.r_[run[1:], len(starts)] - 1] if len(run) else starts[:0]
    place = first + (((_LOW - (least[run] & _LOW)).astype(np.int64) - first) & int(_LOW))
    return place, h[place], first, last


def _anchored(length: int, gram: int):
    """Every anchor: its text's ``name``, place, gram, digest of its surrounding, and how far that reaches to both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in B.blocks(batches):
            place, key, low, last = anchors(B.prefix_hashes(data), offs, length, gram)
            doc, high, raw = np.searchsorted(offs, place, "right") - 1, last + length, data.tobytes()
            spans = zip(low.tolist(), high.tolist(), (place - low).tolist(), strict=True)
            digest = [hashlib.blake2b(raw[a:b], digest_size=16, key=p.to_bytes(2, "little")).digest() for a, b, p in spans]
            arrays = [part.column("name").take(pa.array(doc)), pa.array(place - offs[doc]), pa.array(key.view(np.int64)), pa.array(digest, pa.binary()), pa.array((place - low).astype(np.int32)), pa.array((high - place).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["name", "place", "key", "digest", "back", "ahead"])

    return run


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``text`` and ``wanted`` (key, digest, place, back, ahead) to the bytes of all that is wanted."""
    for batch in batches:
        for part, data, offs in B.blocks(iter([batch])):
            lists = part.column("wanted")
            wanted, first = lists.flatten(), offs[:-1].repeat(lists.value_lengths().to_numpy())
            place, back, ahead = (wanted.field(c).to_numpy().astype(np.int64) for c in ("place", "back", "ahead"))
            raw = data.tobytes()
            around = [raw[a:b] for a, b in zip((first + place - back).tolist(), (first + place + ahead).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([wanted.field("key"), wanted.field("digest"), wanted.field("back"), pa.array(around, pa.binary())], names=["key", "digest", "back", "around"])


class Suffixes:
    """Suffixes of one buffer, compared by hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.end, self.prefix = data, start, end, B.prefix_hashes(data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes ``a`` and ``b``, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.end[a] - self.start[a], self.end[b] - self.start[b])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = B.span_hashes(self.prefix, self.start[a], self.start[a] + mid) == B.span_hashes(self.prefix, self.start[b], self.start[b] + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix ``a`` sorts after ``b``; of equal ones the later number does."""
        n = self.common(a, b)
        end_a, end_b = self.start[a] + n >= self.end[a], self.start[b] + n >= self.end[b]
        last = len(self.data) - 1
        x, y = self.data[np.minimum(self.start[a] + n, last)], self.data[np.minimum(self.start[b] + n, last)]
        return np.where(end_a & end_b, a > b, np.where(end_a, False, np.where(end_b, True, x > y)))

    def order(self) -> np.ndarray:
        """Merge sort of all runs at once: each suffix finds its place in the neighbouring run by binary search."""
        n, width = len(self.start), 1
        order = np.arange(n)
        while width < n:
            at = np.arange(n)
            own = at // width
            first = np.minimum((own ^ 1) * width, n)
            low, high = first.copy(), np.minimum(first + width, n)
            while (open_ := low < high).any():
                mid = (low + high) // 2
                up = np.zeros(n, bool)
                up[open_] = self.after(order[open_], order[mid[open_]])
                low, high = np.where(open_ & up, mid + 1, low), np.where(open_ & ~up, mid, high)
            merged = np.empty(n, np.int64)
            merged[own // 2 * 2 * width + at % width + low - first] = order
            order, width = merged, 2 * width
        return order if self.verified(order) else np.array(sorted(range(n), key=lambda i: (self.data[self.start[i] : self.end[i]].tobytes(), i)), np.int64)

    def verified(self, order: np.ndarray) -> bool:
        """Whether the bytes bear out every neighbours' common extension and order."""
        a, b = order[:-1], order[1:]
        n = self.common(a, b)
        return bool(B.same_bytes(self.data, self.start[a], self.start[b], n).all() and not self.after(a, b).any())


def repeated_windows(around: list[bytes], back: np.ndarray, length: int, left: np.ndarray, right: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each surrounding the ranges, relative to its anchor, that windows cover which some other surrounding has too.

    Of a window at least ``left`` bytes stand before the anchor and ``right`` bytes from it on.
    """
    size = np.fromiter(map(len, around), np.int64, len(around))
    base = np.cumsum(size) - size
    data = np.frombuffer(b"".join(around), np.uint8)
    suffixes = Suffixes(data, base + back, base + size)
    order = suffixes.order()
    near = suffixes.common(order[:-1], order[1:]) if len(order) > 1 else np.zeros(0, np.int64)
    reach = np.zeros(len(around), np.int64)
    np.maximum.at(reach, order[:-1], near)
    np.maximum.at(reach, order[1:], near)
    # Windows that start ``o`` before the anchor need a common extension of ``length - o``.
    least = np.maximum(np.maximum(length - reach, back - size + length), left)
    who, nth = B.ragged(np.maximum(np.minimum(back, length - right) - least + 1, 0))
    o = least[who] + nth
    start = base[who] + back[who] - o
    h = B.span_hashes(suffixes.prefix, start, start + length)
    by = np.argsort(h, kind="stable")
    head = np.flatnonzero(np.r_[True, np.diff(h[by]) != 0]) if len(by) else np.zeros(0, np.int64)
    group = np.repeat(head, np.diff(np.r_[head, len(by)]))
    twice = np.repeat(np.diff(np.r_[head, len(by)]) > 1, np.diff(np.r_[head, len(by)]))
    hit = np.zeros(len(by), bool)
    rows = np.flatnonzero(twice)
    wrong: set[int] = set()
    for k in range(0, len(rows), 1 << 14):
        some = rows[k : k + (1 << 14)]
        same = (data[start[by[some]][:, None] + np.arange(length)] == data[start[by[group[some]]][:, None] + np.arange(length)]).all(axis=1)
        wrong |= set(group[some[~same]].tolist())
    hit[by[rows]] = True
    for g in wrong:  # different bytes under one hash: told apart by the bytes
        own = by[rows[group[rows] == g]]
        texts_ = [data[s : s + length].tobytes() for s in start[own]]
        hit[own] = [texts_.count(t) > 1 for t in texts_]
    out: list[list[tuple[int, int]]] = [[] for _ in around]
    for i, before in zip(who[hit].tolist(), o[hit].tolist(), strict=True):
        own = out[i]
        if own and -before + length >= own[-1][0]:  # starts fall: each range touches the one before it or stands apart
            own[-1] = (min(own[-1][0], -before), max(own[-1][1], length - before))
        else:
            own.append((-before, length - before))
    return out


def _resolve(length: int, most: int):
    """For surroundings sorted by key: those with repeated windows, and the ranges these cover."""

    def flush(rows: list[dict]) -> pa.RecordBatch:
        back, left, right = (np.array([r[c] for r in rows], np.int64) for c in ("back", "left", "right"))
        found = repeated_windows([r["around"] for r in rows], back, length, left, right)
        kept = [(r["key"], r["digest"], f) for r, f in zip(rows, found, strict=True) if f]
        columns = [pa.array([k for k, _, _ in kept], pa.int64()), pa.array([d for _, d, _ in kept], pa.binary())]
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        return pa.RecordBatch.from_arrays([*columns, pa.array([[{"low": a, "high": b} for a, b in f] for _, _, f in kept], kind)], names=["key", "digest", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(held) >= most and row["key"] != held[-1]["key"]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return run


def ranges_of(groups: DataFrame, length: int, most: int) -> DataFrame:
    """``key, digest, ranges`` of the different surroundings ``key, digest, back, around, left, right``.

    All surroundings of a group (``key``) agree in ``left`` bytes before the anchor and
    ``right`` from it on, and the group stands for the windows that hold these. One of
    more than ``most`` surroundings is split in two ways: of the rest of a window half,
    rounded up, is before these bytes, or else more than the other half after them. What
    the windows of a part can't reach is cut off, which makes most of its surroundings
    equal; equal ones are settled, the others are a smaller problem of the same kind.
    """
    counts = groups.groupBy("key").agg(F.count("*").alias("different"))
    small = groups.join(counts.where(F.col("different") <= most).select("key"), "key", "left_semi")
    found = small.repartition("key").sortWithinPartitions("key").mapInArrow(_resolve(length, 4096), "key long, digest binary, ranges array<struct<low: long, high: long>>")
    large = written(groups.join(counts.where(F.col("different") > most).select("key"), "key", "left_semi"))
    if large.isEmpty():
        return found
    slack = F.expr(f"{length} - left - right")
    half = F.floor((slack + 1) / 2).cast("int")
    parts = None
    for side, left, right in (("l", F.col("left") + half, F.col("right")), ("r", F.col("left"), F.col("right") + slack - half + 1)):
        part = large.withColumn("left_", left.cast("int")).withColumn("right_", right.cast("int")).where("back >= left_ AND length(around) - back >= right_")
        part = part.withColumn("key_", F.xxhash64("key", F.lit(side), F.expr("substring(around, back - left_ + 1, left_ + right_)")))
        part = part.withColumn("back_", F.expr(f"least(back, {length} - right_)"))
        part = part.withColumn("around_", F.expr(f"substring(around, back - back_ + 1, back_ + {length} - left_)"))
        part = part.withColumn("digest_", F.unhex(F.md5(F.concat("around_", F.col("back_").cast("string").cast("binary")))))
        part = part.select(F.col("key").alias("parent"), F.col("digest").alias("parent_digest"), *(F.col(f"{c}_").alias(c) for c in ("key", "digest", "back", "around", "left", "right")))
        parts = part if parts is None else parts.unionByName(part)
    parts = written(parts)
    distinct = written(parts.groupBy("key", "digest").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("back", "around", "left", "right"))))
    more = ranges_of(distinct.drop("n"), length, most).unionByName(_whole(distinct.withColumn("ahead", F.length("around") - F.col("back")), length))
    above = parts.select("key", "digest", "parent", "parent_digest").join(more, ["key", "digest"])
    return found.unionByName(written(above.select(F.col("parent").alias("key"), F.col("parent_digest").alias("digest"), "ranges")))


def _whole(distinct: DataFrame, length: int) -> DataFrame:
    """Of surroundings that occur more than once, all of it."""
    ranges = F.array(F.struct((-F.col("back")).cast("long").alias("low"), F.col("ahead").cast("long").alias("high")))
    return distinct.where(f"n > 1 AND back + ahead >= {length}").select("key", "digest", ranges.alias("ranges"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], []]
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            raw, at, rest, merged = text.as_py().encode(), 0, hashlib.sha256(), []
            for s in sorted((x["low"], x["high"]) for x in spans):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            for a, b in merged:
                rest.update(raw[at:a])
                at = b
            rest.update(raw[at:])
            for c, v in zip(out, (sum(b - a for a, b in merged), len(merged), rest.hexdigest()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("name"), *(pa.array(c, pa.int64()) for c in out[:2]), pa.array(out[2], pa.string())], names=["name", "n_removed", "n_spans", "kept"])


def _one_each(named: DataFrame, names: DataFrame, bound: int) -> DataFrame:
    """``name, text`` of one row for each of ``names``, or more; up to ``bound`` names are broadcast, and texts of other names stay where they are."""
    some = named.join(F.broadcast(names), "name", "left_semi") if names.count() <= bound else named
    return some.groupBy("name").agg(F.first("text").alias("text"))


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 64, most: int = 20_000, share: int = 2_000, bound: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    A byte is removed if a string of ``length`` bytes that covers it starts anywhere
    else in the corpus too. Null and empty texts have no bytes; of equal rows of at
    least ``length`` bytes everything is removed; an empty table gives no rows;
    other columns are ignored. ``most``: surroundings that one sort takes; larger
    groups are split first. ``share``: grams with more than one of so many anchors
    are counted before they are shuffled. Of equal texts one is sent, and only those
    with bytes to fetch or spans, if these are up to ``bound`` different texts (whose
    names are broadcast). These two change the plan only.
    """
    named = texts(docs, id_col, text_col).withColumn("whole", F.sha2("text", 256)).withColumn("name", F.substring(F.unhex("whole"), 1, 16))
    long = named.where(F.octet_length("text") >= length).select("name", "text")
    found = written(long.mapInArrow(_anchored(length, gram), "name binary, place long, key long, digest binary, back int, ahead int"))
    # Grams that occur more than once.
    shared = written(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    # Fewer than ``share`` grams can hold more than that part of all anchors: they are broadcast, and their
    # anchors meet by gram and digest, counted where they are read. All others are joined by a shuffle.
    often = F.col("n") > found.count() / share
    hot, others = F.broadcast(shared.where(often).select("key")), shared.where(~often).select("key")
    places = [F.first(c).alias(c) for c in ("name", "place", "back", "ahead")]
    parts = [met.groupBy("key", "digest").agg(F.count("*").alias("n"), *places) for met in (found.join(hot, "key", "left_semi"), found.join(hot, "key", "left_anti").join(others, "key", "left_semi"))]
    one = written(parts[0].unionByName(parts[1]))
    # Bytes of one of each of the different surroundings of a gram; of equal texts one is sent.
    differ = one.groupBy("key").agg(F.count("*").alias("different")).where("different > 1").select("key")
    asked = one.join(differ, "key", "left_semi")
    wanted = asked.groupBy("name").agg(F.collect_list(F.struct("key", "digest", "place", "back", "ahead")).alias("wanted"))
    fetched = _one_each(long, written(asked.select("name").distinct()), bound).join(wanted, "name").select("text", "wanted").mapInArrow(_fetched, "key long, digest binary, back int, around binary")
    several = written(fetched.select("key", "digest", "back", "around", F.lit(0).alias("left"), F.lit(gram).alias("right")))
    ranges = ranges_of(several, length, most).unionByName(_whole(one, length)).select("key", "digest", F.explode("ranges").alias("r"))
    placed = found.select("name", "place", "key", "digest").join(ranges, ["key", "digest"]).select("name", (F.col("place") + F.col("r.low")).alias("low"), (F.col("place") + F.col("r.high")).alias("high")).distinct()
    # Runs of touching ranges become one before they are gathered by text.
    in_order = Window.partitionBy("name").orderBy("low", "high")
    opens = F.coalesce(F.col("low") > F.max("high").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    runs = placed.withColumn("opens", opens).withColumn("run", F.sum("opens").over(in_order)).groupBy("name", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    spans = written(runs.groupBy("name").agg(F.collect_list(F.struct("low", "high")).alias("spans")))
    met = _one_each(long, spans.select("name"), bound).join(spans, "name").select("name", "text", "spans")
    kept = met.mapInArrow(_kept, "name binary, n_removed long, n_spans long, kept string")
    rows = named.select("doc_id", "name", F.octet_length("text").cast("long").alias("n_bytes"), "whole").join(kept, "name", "left")
    removed = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")]
    return rows.select("doc_id", "n_bytes", *removed, F.coalesce("kept", "whole").alias("kept_sha256"))
