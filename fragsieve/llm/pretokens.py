"""Pre-tokens of the byte-level tokenizer, found with array operations.

The pattern, as the vocabulary's library documents it:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

from .bytespans import mixed, same_bytes, word_sums

#: Characters that the pattern's \\s matches (fixed values).
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Letters and numbers that the vocabulary's library knows and Unicode 15.1, Python's, doesn't (fixed values).
NEWER = {
    LETTER: [
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
        (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
        (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ],
    NUMBER: [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}


@functools.cache
def classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        table[c] = kinds.get(unicodedata.category(chr(c))[0], OTHER)
    for kind, ranges in NEWER.items():
        for first, last in ranges:
            table[first : last + 1] = kind
    table[SPACES] = SPACE
    return table


def pretokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and text number of every pre-token of the block's texts."""
    empty = np.zeros(0, np.int64)
    if not len(data):
        return empty, empty, empty
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), out=at[1:])
    n = len(cp)
    begins = np.zeros(n + 1, bool)
    begins[np.searchsorted(at, offs)] = True  # the first character of each text, and the end
    cls = classes()[cp]
    space = cls == SPACE
    run = begins.copy()
    run[1:n] |= cls[1:] != cls[:-1]
    start = run.copy()
    # The last white space before something else stands apart: a blank joins what follows, anything else is a token.
    apart = np.zeros(n + 1, bool)
    apart[: n - 1] = space[:-1] & ~space[1:] & ~begins[1:n]
    start |= apart
    joined = np.zeros(n + 1, bool)
    joined[1:] = apart[:-1] & (cp == 32)
    start &= ~joined | begins
    # Contractions: an apostrophe that is a run of its own and has no blank joined to it.
    quote = np.flatnonzero((cp == 39) & run[:n] & ~joined[:n])
    quote = quote[quote + 1 < n]
    quote = quote[(cls[quote + 1] == LETTER) & ~begins[quote + 1]]
    if len(quote):
        one = cp[quote + 1]
        after = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~begins[after], cp[after], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        size = np.where(short, 2, np.where(long, 3, 0))
        hit, size = quote[size > 0], size[size > 0]
        start[hit + 1] = False
        start[hit + size] = True
    first = np.flatnonzero(start[:n])
    last = np.append(first[1:], n)
    return at[first], at[last], np.searchsorted(offs, at[first], "right") - 1


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each of the distinct pre-tokens, and for every pre-token which it is. Hashes group them, their bytes decide."""
    first, second = word_sums(data, start, end)
    _, one, which = np.unique(mixed(mixed(first) + second), return_index=True, return_inverse=True)
    wrong = np.flatnonzero(~same_bytes(data, start, start[one[which]], np.minimum(end - start, (end - start)[one[which]])) | (end - start != (end - start)[one[which]]))
    if not len(wrong):
        return one, which
    known: dict[bytes, int] = {}
    for i in wrong.tolist():
        which[i] = known.setdefault(data[start[i] : end[i]].tobytes(), len(one) + len(known))
    return np.r_[one, [wrong[which[wrong] == k][0] for k in range(len(one), len(one) + len(known))]].astype(np.int64), which


def segments(column: pa.Array, special: list[str]) -> tuple[list[str] | None, np.ndarray, np.ndarray]:
    """Texts cut at the vocabulary's special strings: pieces, text number of each, special ids found before it (-1: none).

    None instead of pieces where no text holds such a string.
    """
    import re

    import pyarrow.compute as pc

    found = np.zeros(len(column), bool)
    for s in special:
        found |= pc.match_substring(column, s).fill_null(False).to_numpy(zero_copy_only=False)
    if not found.any():
        return None, np.arange(len(column)), np.full(len(column), -1)
    pattern = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
    pieces, doc, before = [], [], []
    for i, (hit, text) in enumerate(zip(found, column.to_pylist(), strict=True)):
        parts = pattern.split(text or "") if hit else [text or ""]
        pieces += parts[::2]
        doc += [i] * len(parts[::2])
        before += [-1, *(special.index(s) for s in parts[1::2])]
    return pieces, np.array(doc), np.array(before)
