"""Vectorised access to the UTF-8 bytes of Arrow string columns.

Texts are handled a block of whole texts at a time (about ``BLOCK`` bytes), so
that memory is bounded by the block or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

BLOCK = 1 << 18
#: Modulus of prefix hashes, a prime: powers of two have structured collisions.
PRIME = (1 << 61) - 1
_BASE = 0x1E3779B97F4A7C15 % PRIME
_INVERSE = pow(_BASE, -1, PRIME)
_M, _LOW32, _LOW29 = np.uint64(PRIME), np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}
#: Random weights of a word's first, second, ... byte, for two independent sums.
_weights = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
#: A random value below the modulus for each byte.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, PRIME, 256, dtype=np.uint64)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


def lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lowered()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offsets (one more than texts)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def blocks(batches: Iterator[pa.RecordBatch], text_col: str = "text", size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of whole texts with at most ``size`` bytes, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = utf8(batch.column(text_col))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offs, offs[first] + size, "right")) - 1)
            yield batch.slice(first, last - first), data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
            first = last


def row_keys(start: int, n: int) -> np.ndarray:
    """Keys that differ between all rows of a run over a fixed table: partition and place."""
    context = TaskContext.get()
    return ((context.partitionId() if context else 0) << 40) + start + np.arange(n, dtype=np.int64)


def folded(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo the prime."""
    x = (x & _M) + (x >> np.uint64(61))
    return np.where(x >= _M, x - _M, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, of values below it, by halves of 32 bits."""
    a1, a0, b1, b0 = a >> np.uint64(32), a & _LOW32, b >> np.uint64(32), b & _LOW32
    middle = a1 * b0 + a0 * b1  # below 2**62
    # 2**64 is 8 and 2**61 is 1 modulo the prime.
    return folded(np.uint64(8) * (a1 * b1) + (middle >> np.uint64(29)) + ((middle & _LOW29) << np.uint64(32)) + folded(a0 * b0))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """The first ``n`` powers modulo the prime, each doubling by one product."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, times(have, np.uint64(pow(base, len(have), PRIME)))])
    _powers[base] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``P[i]``: polynomial hash (modulo the prime) of the first ``i`` bytes."""
    terms = times(BYTE_VALUES[data], powers(len(data)))
    out = np.zeros(len(data) + 1, np.uint64)
    # Halves are summed apart, so that sums stay below 2**64.
    high, low = np.cumsum(terms >> np.uint64(32)), np.cumsum(terms & _LOW32)
    out[1:] = folded(((high & _LOW29) << np.uint64(32)) + (high >> np.uint64(29)) + folded(low))
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans, the same for equal bytes wherever they stand."""
    return mixed(times(folded(prefix[end] + (_M - prefix[start])), powers(len(prefix), _INVERSE)[start]))


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the ``n`` bytes from ``a`` on equal those from ``b`` on, for each of the spans."""
    group, place = ragged(n)
    differ = data[a[group] + place] != data[b[group] + place]
    return np.bincount(group[differ], minlength=len(n)) == 0


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads differences over all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes in ``member``; runs don't cross texts."""
    inside = member[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offs, start, "right") - 1


def word_sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent sums over the bytes of each span, every byte weighted by its place in the span."""
    n = end - start
    most = int(n.max(initial=0))
    if len(_weights[0]) < most:
        for k in range(2):
            _weights[k] = np.random.default_rng(977 + k).integers(0, 2**64, max(most, 2 * len(_weights[k]), 64), dtype=np.uint64)
    group, place = ragged(n)
    value = data[start[group] + place].astype(np.uint64) + np.uint64(1)
    out = []
    for w in _weights:
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * w[place], out=total[1:])
        at = np.cumsum(n)
        out.append(total[at] - total[at - n] + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out[0], out[1]


def word_hashes(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each lower-cased (A-Z) word, a second hash of it, and the text it is in. Words that differ agree in both with odds of about 2 ** -114."""
    data = LOWER[data]
    start, end, doc = words(data, offs, member)
    a, b = word_sums(data, start, end)
    return mixed(mixed(a) + b), mixed(mixed(b ^ np.uint64(0x243F6A8885A308D3)) + a), doc


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` successive values; the caller leaves out those that cross texts."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out + h[i : len(h) - n + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mixed(out)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item of consecutive groups of these lengths: its group, and its place in it."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
