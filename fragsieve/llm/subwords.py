"""Character n-grams of the words of texts, hashed, by array operations on distinct words."""

from __future__ import annotations

import numpy as np

from . import bytespans as B

#: Bytes of words: ASCII letters and digits, the apostrophe, and all of non-ASCII text.
MEMBER = B.byte_class((0x27, 0x27), (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
ASCII_LETTERS = B.byte_class((0x41, 0x5A), (0x61, 0x7A))
_EDGE = np.uint64(0x110000)


class Words:
    """The words of a block of texts: ``doc`` and ``word`` of each occurrence, and the distinct words' bytes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        data = B.LOWER[data]
        start, end, self.doc = B.words(data, offs, MEMBER)
        sums = B.word_sums(data, start, end)
        _, one, self.word = np.unique(B.mixed(B.mixed(sums[0]) + sums[1]), return_index=True, return_inverse=True)
        first, size = start[one], (end - start)[one]
        group, place = B.ragged(size)
        self.n = len(one)
        self.raw, self.size = data[first[group] + place], size

    def grams(self, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Word number and bucket of every n-gram (of characters, with an edge mark on both sides), words in order."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = (self.raw & 0xC0) != 0x80  # first bytes of characters
        chars = np.add.reduceat(starts.astype(np.int64), np.cumsum(self.size) - self.size)
        cp = np.frombuffer(self.raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        group, place = B.ragged(chars + 2)
        marked = np.full(len(group), _EDGE)
        marked[(place > 0) & (place <= chars[group])] = cp
        word, hashed = [], []
        for n in range(low, high + 1):
            g = B.gram_hashes(marked, n)
            at = np.flatnonzero(group[: len(g)] == group[n - 1 : n - 1 + len(g)])
            word.append(group[at])
            hashed.append((g[at] & np.uint64(buckets - 1)).astype(np.int64))
        word, hashed = np.concatenate(word), np.concatenate(hashed)
        order = np.argsort(word, kind="stable")
        return word[order], hashed[order]


def expanded(of: np.ndarray, owner: np.ndarray, n: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry of ``of`` all values whose owner it names (owners sorted): the entry's number, and the value."""
    size = np.bincount(owner, minlength=n)
    first = np.cumsum(size) - size
    entry, place = B.ragged(size[of])
    return entry, values[first[of][entry] + place]
