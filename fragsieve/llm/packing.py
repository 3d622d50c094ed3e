"""Packing of documents into sequences by fitted length patterns.

Patterns are multisets of one to three length classes that fill a sequence. Their
repeat counts are fitted to the histogram of lengths by non-negative least squares
(active set), rounded down, and the documents left over are packed best-fit, still
as a histogram: the driver holds only counts by length. Places are then dealt to
documents by their rank among equal lengths, which is summed from counts by
partition, so no group of equal lengths is gathered anywhere.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytespans as B
from . import pretokens as P
from .tables import texts, written

#: Bytes of distinct pre-tokens whose ids a worker remembers, at most (and those of one block).
REMEMBERED = 1 << 22


class Encoder:
    """Token ids by the library, each distinct pre-token encoded once for a block and then remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [(t.content, i) for i, t in self.library.get_added_tokens_decoder().items() if t.special]
        self.special, self.special_ids = [s for s, _ in added], [i for _, i in added]
        # In a byte-level vocabulary a token has a character for each byte.
        self.width = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.width[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.entry: dict[bytes, int] = {}
        self.size, self.first, self.ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        self.n_ids = self.n_bytes = 0

    def remember(self, raw: list[bytes]) -> None:
        """One library call for all of them; the bytes tell which ids are whose."""
        [found] = self.library.encode_batch_fast([[b.decode() for b in raw]], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))) + 1
        size = np.diff(ends, prepend=0)
        self.entry.update(zip(raw, range(len(self.entry), len(self.entry) + len(raw)), strict=True))
        self.n_bytes += sum(map(len, raw))
        self.size.append(size)
        self.first.append(self.n_ids + ends - size)
        self.ids.append(ids)
        self.n_ids += len(ids)

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each pre-token, and all their ids in a row."""
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        one, which = P.distinct(data, start, end)
        if self.n_bytes > REMEMBERED:
            self.clear()
        whole, known = data.tobytes(), self.entry
        names = [whole[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
        if fresh := [b for b in names if b not in known]:
            self.remember(fresh)
        for column in ("size", "first", "ids") if len(self.size) > 32 else ():
            setattr(self, column, [np.concatenate(getattr(self, column))])
        size, first, ids = (x[0] if len(x) == 1 else np.concatenate(x) for x in (self.size, self.first, self.ids))
        entry = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[which]
        group, place = B.ragged(size[entry])
        return size[entry], ids[first[entry][group] + place]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str, room: int, end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and its place ``part, nth`` among equal lengths of its partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, part_id, seen = encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        for part, data, offs in B.blocks(batches, size=4 * B.BLOCK):
            segs, doc, before = P.segments(part.column("text"), model.special)
            if segs is not None:
                data, offs = B.utf8(pa.array(segs, pa.large_string()))
            start, end, seg = P.pretokens(data, offs)
            size, ids = model.encode(data, start, end)
            by_seg = np.bincount(seg, weights=size, minlength=len(doc)).astype(np.int64)
            flat, at, columns = [], 0, ([], [], [], [], [], [])
            doc_ids = part.column("doc_id").to_pylist()
            whole: list[list[np.ndarray]] = [[] for _ in doc_ids]
            for d, special, n in zip(doc.tolist(), before.tolist(), by_seg.tolist(), strict=True):
                if special >= 0:
                    whole[d].append(np.array([model.special_ids[special]], np.uint32))
                whole[d].append(ids[at : at + n])
                at += n
            last = np.array([end_id], np.uint32)
            for doc_id, own in zip(doc_ids, whole, strict=True):
                flat = np.concatenate([*own, last]).astype("<u4")
                n = len(flat)
                first = n % room or room
                edges = [0, *range(min(first, n), n + 1, room)]
                for k, (a, b) in enumerate(itertools.pairwise(edges)):
                    for column, v in zip(columns, (doc_id, k, a, b - a, zlib.crc32(flat[a:b].tobytes()), seen[b - a]), strict=True):
                        column.append(v)
                    seen[b - a] += 1
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(columns[0]), part_id), pa.int32())], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"])

    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, part int")


def patterns(units: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """Multisets of one to three classes among ``present`` (widths in units) that sum to ``units``."""
    have = set(present.tolist())
    found = [(units,)] if units in have else []
    for a in sorted(have, reverse=True):
        if a < units and (b := units - a) <= a and b in have:
            found.append((a, b))
        for b in range(min(a, units - a - 1), 0, -1):
            if (c := units - a - b) > b:
                break
            if b in have and c in have:
                found.append((a, b, c))
    return found


def nnls(some: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by the active-set method.

    The matrix is never built: column ``j`` has a one for each of the rows ``some[j]``
    (a row listed twice counts twice, ``len(b)`` stands for none). Only the normal
    equations of the active columns, no more than there are rows, are dense.
    """
    n, x = len(b), np.zeros(len(some))
    if not len(some):
        return x
    names: list[int] = []
    columns = np.zeros((0, n))

    def gradient() -> np.ndarray:
        rest = np.append(b - (x[names] @ columns if names else 0.0), 0.0)
        return rest[some].sum(axis=1)

    eps = 1e-9 * max(1.0, float(np.abs(gradient()).max()))
    for _ in range(rounds):
        g = gradient()
        g[names] = -np.inf
        j = int(np.argmax(g))
        if g[j] <= eps:
            break
        names.append(j)
        columns = np.vstack([columns, np.bincount(some[j], minlength=n + 1)[:n]])
        while names:
            s = np.linalg.solve(columns @ columns.T + 1e-10 * np.eye(len(names)), columns @ b)
            own = x[names]
            if s.min() > 0:
                x[names] = s
                break
            bad = s <= 0
            step = np.min(own[bad] / np.maximum(own[bad] - s[bad], 1e-300))
            own += step * (s - own)
            drop = bad & (own <= 1e-12)
            if not drop.any():
                drop = bad & (np.cumsum(bad) == 1)
            x[names] = np.where(drop, 0, own)
            names, columns = [k for k, out in zip(names, drop.tolist(), strict=True) if not out], columns[~drop]
    return x


def plan(histogram: dict[int, int], room: int, width: int) -> list[tuple[int, int, int, int]]:
    """Runs of places ``(length, count, first sequence, offset)`` that hold every length of the histogram.

    The ``i``-th place of a run is in sequence ``first + i``. Everything is done on counts: classes of ``width``
    lengths are fitted, then a run is cut wherever the exact lengths change, so its slack is known.
    """
    left = {n: c for n, c in histogram.items() if c}
    runs: list[tuple[int, int, int, int]] = []
    made = 0
    #: Open sequences by the room left: [(first, count)].
    slack: dict[int, list[tuple[int, int]]] = {}
    units = room // width
    of = lambda n: -(-n // width)
    if left and room % width == 0:
        totals = Counter()
        for n, c in left.items():
            totals[of(n)] += c
        present = np.array(sorted(totals))
        some = patterns(units, present)
        if some:
            row = {u: i for i, u in enumerate(present.tolist())}
            rows = np.array([[*(row[u] for u in pattern), *[len(row)] * (3 - len(pattern))] for pattern in some])
            repeat = np.floor(nnls(rows, np.array([totals[u] for u in present.tolist()], float)) + 1e-6).astype(int)
            stock = {u: sorted(n for n in left if of(n) == u) for u in totals}
            for j in np.flatnonzero(repeat):
                todo = int(repeat[j])
                while todo:
                    # The longest of the first class with the shortest of the others: even slack.
                    taken, need = [], Counter()
                    for k, u in enumerate(some[j]):
                        n = next((n for n in (reversed(stock[u]) if k == 0 else stock[u]) if left[n] > need[n]), None)
                        if n is None:
                            break
                        taken.append(n)
                        need[n] += 1
                    if len(taken) < len(some[j]):
                        break  # rounding asks for more than there is
                    count = min(todo, *(left[n] // c for n, c in need.items()))
                    offset = 0
                    for n in taken:
                        runs.append((n, count, made, offset))
                        offset += n
                        left[n] -= count
                        if not left[n]:
                            stock[of(n)].remove(n)
                    if offset < room:
                        slack.setdefault(room - offset, []).append((made, count))
                    made += count
                    todo -= count
    gaps = sorted(slack)
    for n in sorted((n for n in left if left[n]), reverse=True):
        todo = left[n]
        while todo:
            i = bisect.bisect_left(gaps, n)
            if i < len(gaps):
                gap = gaps[i]
                first, count = slack[gap].pop()
                if not slack[gap]:
                    gaps.pop(i)
                    del slack[gap]
                used = min(count, todo)
                if used < count:
                    _open(slack, gaps, gap, first + used, count - used)
            else:
                gap, first, used = room, made, -(-todo // max(1, room // n))
                made += used
            runs.append((n, used, first, room - gap))
            todo -= used
            if gap > n:
                _open(slack, gaps, gap - n, first, used)
    return runs


def _open(slack: dict[int, list[tuple[int, int]]], gaps: list[int], gap: int, first: int, count: int) -> None:
    if gap not in slack:
        bisect.insort(gaps, gap)
    slack.setdefault(gap, []).append((first, count))


def pack(docs: DataFrame, vocabulary: str, room: int = 2048, width: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row of ``docs``.

    A row's ids are the library's, without special tokens, then one end id. Longer
    rows are cut into pieces of ``room`` ids of which the first may be shorter.
    Null and empty texts are one piece of one id; equal rows are packed each; an
    empty table gives no rows; other columns are ignored.
    """
    cut = written(pieces(texts(docs, id_col, text_col), vocabulary, room))
    # Counts by partition and length: at most ``room`` rows for a partition.
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``room`` rows
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for n, count, first, offset in plan(histogram, room, width):
        by_length.setdefault(n, []).append((count, first, offset))
    places = {n: (np.cumsum([0] + [c for c, _, _ in own]), np.array([f for _, f, _ in own]), np.array([o for _, _, o in own])) for n, own in by_length.items()}
    dealt = docs.sparkSession.sparkContext.broadcast(places)  # bounded by room and patterns, whatever the number of documents

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                edge, first, at = dealt.value[int(length[own[0]])]
                run = np.searchsorted(edge, rank[own], "right") - 1
                sequence[own], offset[own] = first[run] + rank[own] - edge[run], at[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth", "part")
    return ranked.mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
