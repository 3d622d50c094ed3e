"""Token counts by rank-synchronous merging of ragged arrays.

Every distinct pre-token of a block is one sequence of a ragged array of symbols.
In each round all sequences look up the ranks of their neighbouring pairs at once
and each applies its lowest-ranked pair wherever it occurs; a sequence without a
known pair is finished, and its symbols are its tokens. Ranks of pairs are kept and
looked up again only beside a merge, so that long sequences stay cheap. No text is
tokenized one merge at a time, and no sequence is ever cut.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytespans as B
from . import pretokens as P
from .tables import texts

#: Bytes of distinct pre-tokens whose counts a worker remembers, at most (and those of one block).
REMEMBERED = 1 << 21
#: Rank of a pair that no merge knows.
_NEVER = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Merges:
    """Merge ranks of a byte-level vocabulary file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left << 32 | right)
        self.keys, self.rank, self.made = (left << 32 | right)[order], order, made[order]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", ()) if t["special"]]
        self._known: dict[bytes, int] = {}
        self._n_bytes = 0

    def slots(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair in the table, and its rank (``_NEVER``: not in the table)."""
        key = left << 32 | right
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return slot, np.where(self.keys[slot] == key, self.rank[slot], _NEVER)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of symbols left in each of the sequences (all of at least one symbol)."""
        left = lengths.astype(np.int64).copy()
        seq = np.repeat(np.arange(len(lengths)), lengths)
        n = len(seq)
        # Symbols are linked in both directions; ``n`` is beyond the ends. ``rank[i]`` is that of the pair that starts at i.
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lengths) - 1
        after[ends], before[ends - lengths + 1] = n, n
        sym, rank, slot = np.append(symbols, 0), np.full(n + 1, _NEVER), np.zeros(n + 1, np.int64)
        at = np.flatnonzero(after < n)
        slot[at], rank[at] = self.slots(sym[at], sym[at + 1])
        while n:
            head = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(rank[:n], head)
            live = least < _NEVER
            if not live.any():
                break
            size = np.diff(np.r_[head, n])
            used = rank[:n] < _NEVER
            if 2 * size[live].sum() < n or 4 * used.sum() < n:
                # Only living sequences stay, and of these only living symbols.
                keep = np.repeat(live, size) & (sym[:n] >= 0)
                new = np.append(np.cumsum(keep) - 1, 0)
                n = int(keep.sum())
                new[-1] = n
                sym, rank, slot, seq = (np.append(v[: len(keep)][keep], x) for v, x in ((sym, 0), (rank, _NEVER), (slot, 0), (seq, 0)))
                after, before, seq = new[after[keep]], new[before[keep]], seq[:n]
                head = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
                least, size = least[live], np.diff(np.r_[head, n])
            at = np.flatnonzero((rank[:n] < _NEVER) & (rank[:n] == np.repeat(least, size)))
            # Of overlapping occurrences (a a a), take the first, third, ... of each row of neighbours.
            fresh = np.r_[True, after[at[:-1]] != at[1:]]
            odd = (np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 1
            at = at[~odd]
            gone = after[at]
            sym[at] = self.made[slot[at]]
            sym[gone], rank[gone] = -1, _NEVER
            follow = after[gone]
            after[at] = follow
            before[follow[follow < n]] = at[follow < n]
            left -= np.bincount(seq[at], minlength=len(left))
            # Pairs beside the merged symbols are looked up again.
            near = np.unique(np.r_[at, before[at][before[at] < n]])
            inner = after[near] < n
            rank[near[~inner]] = _NEVER
            near = near[inner]
            slot[near], rank[near] = self.slots(sym[near], sym[after[near]])
        return left

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token."""
        if not len(start):
            return np.zeros(0, np.int64)
        one, which = P.distinct(data, start, end)
        whole = data.tobytes()
        names = [whole[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
        if self._n_bytes > REMEMBERED:
            self._known, self._n_bytes = {}, 0
        known = self._known
        fresh = np.array([i for i, b in enumerate(names) if b not in known], np.int64)
        if len(fresh):
            first, size = start[one[fresh]], (end - start)[one[fresh]]
            group, place = B.ragged(size)
            made = self.merge(self.of_byte[data[first[group] + place]], size)
            for i, n in zip(fresh.tolist(), made.tolist(), strict=True):
                known[names[i]] = n
            self._n_bytes += int(size.sum())
        return np.fromiter(map(known.__getitem__, names), np.int64, len(names))[which]


@functools.cache
def merges(path: str) -> Merges:
    return Merges(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens; equal rows each get their own
    row; an empty table gives no rows; other columns are ignored. ``vocabulary``
    is the path of a byte-level BPE file, readable on every executor. Its special
    strings inside texts count as one token each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(vocabulary)
        for part, data, offs in B.blocks(batches):
            n_bytes = np.diff(offs)
            pieces, doc, before = P.segments(part.column("text"), model.special)
            if pieces is not None:
                data, offs = B.utf8(pa.array(pieces, pa.large_string()))
            start, end, piece = P.pretokens(data, offs)
            tokens = np.bincount(doc[piece], weights=model.counts(data, start, end), minlength=part.num_rows).astype(np.int64)
            tokens += np.bincount(doc[before >= 0], minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = texts(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
