"""How the sources of a language differ in their words: exact divergences from term counts.

Texts are tokenised as UTF-8 bytes: a table of byte classes finds the boundaries of
terms in the concatenated buffers of a block of texts, xxhash groups the slices, and
the bytes of every slice are compared with those of its group. Counts by language,
term and source meet in Spark; blocks of kept terms then become sparse (CSR)
matrices with a row for each source, from which the divergences of all pairs are
summed with ``reduceat``.

Shares are integers: ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``; the divergence of
two shares is ``floor((p - q)^2 / (p + q))``. Everything is computed in 64-bit integers,
exactly, for fewer than 2 * 10^14 occurrences in a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytespans import LOWER, blocks, byte_class, same_bytes, words
from .tables import written

#: ASCII letters and every byte of other characters; all other ASCII characters separate terms.
TERM = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes of texts that are counted together; terms of a CSR block, and sources that are compared with all others at a time.
BLOCK, TERMS, TILE = 4 << 20, 2048, 256


def _groups(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each slice the number of its group of equal slices, and for each group the first of its slices."""
    import xxhash

    raw = data.tobytes()
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
    _, first, group = np.unique(h, return_index=True, return_inverse=True)
    lead, size = first[group], end - start
    same = size == size[lead]
    same[same] = same_bytes(data, start[same], start[lead][same], size[same])
    if not same.all():  # slices whose hash is that of other bytes are told apart by their bytes
        own, made = {}, len(first)
        for i in np.flatnonzero(~same).tolist():
            k = own.setdefault(raw[start[i] : end[i]], (made + len(own), i))
            group[i] = k[0]
        first = np.concatenate([first, [i for _, i in own.values()]]).astype(np.int64)
    return group, first


def _counter(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offs in blocks(batches, "text", block):
            data = LOWER[raw]
            start, end, doc = words(data, offs, TERM)
            if not len(start):
                continue
            term, first = _groups(data, start, end)
            # The block's (lang, source) groups by number.
            keys = list(zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), strict=True))
            number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            of_doc = np.array([number[k] for k in keys], np.int64)
            n = len(first)
            # Occurrences of each term in each text, then in each group: occurrences, and texts that have it.
            in_doc, occ = np.unique(doc * n + term, return_counts=True)
            cell, at = np.unique(of_doc[in_doc // n] * n + in_doc % n, return_inverse=True)
            total = np.zeros(len(cell), np.int64)
            np.add.at(total, at, occ)
            group, which = cell // n, first[cell % n]
            names = list(number)
            lengths = (end - start)[which]
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            place = np.repeat(start[which] - offsets[:-1], lengths) + np.arange(offsets[-1])
            terms = pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[place])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in names]).take(pa.array(group)), pa.array([k[1] for k in names]).take(pa.array(group)), terms.cast(pa.string()), pa.array(total), pa.array(np.bincount(at, minlength=len(cell)).astype(np.int64))],
                names=["lang", "source", "term", "occ", "docs"],
            )

    return run


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """``1 + floor(10^9 (count + 2) / total)`` without overflow: the factor is applied in two steps of a long division."""
    a = 31250 * (count + 2)
    return 1 + a // total * 32000 + a % total * 32000 // total


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _csr(size: int):
    """Rows ``lang, term, cells`` to blocks of at most ``size`` terms or 64 times as many cells: terms, and for each cell its term, source and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out(lang: str) -> pa.RecordBatch:
            rows = held.pop(lang)[1]
            cells = [(c["source"], t, c["occ"]) for t, (_, found) in enumerate(rows) for c in found]
            return pa.RecordBatch.from_pydict({"lang": [lang], "terms": [[t for t, _ in rows]], "cell_source": [[s for s, _, _ in cells]], "cell_term": pa.array([[t for _, t, _ in cells]], pa.list_(pa.int32())), "cell_count": [[n for _, _, n in cells]]})

        for batch in batches:
            for lang, term, cells in zip(*(batch.column(c).to_pylist() for c in ("lang", "term", "cells")), strict=True):
                block = held.setdefault(lang, [0, []])
                block[0] += len(cells)
                block[1].append((term, cells))
                if len(block[1]) >= size or block[0] >= 64 * size:
                    yield out(lang)
                elif len(held) > 64:  # many languages: the fullest block goes
                    yield out(max(held, key=lambda x: held[x][0]))
        for lang in list(held):
            yield out(lang)

    return run


class Block:
    """A CSR matrix of counts: a row for each source of the language, a column for each of some of its terms."""

    def __init__(self, r: dict):
        self.lang, self.terms, self.names = r["lang"], r["terms"], r["sources"]
        number = {s: i for i, s in enumerate(self.names)}
        g, t, count = np.array([number[s] for s in r["cell_source"]], np.int64), np.array(r["cell_term"], np.int64), np.array(r["cell_count"], np.int64)
        order = np.lexsort((t, g))
        self.g, self.t, count = g[order], t[order], count[order]
        self.at = np.searchsorted(self.g, np.arange(len(self.names) + 1))
        self.size = np.diff(self.at)
        total = np.array(r["totals"], np.int64) + 2 * r["v"]
        self.p, self.zero = share(count, total[self.g]), share(np.zeros(len(total), np.int64), total)
        whole = np.zeros(len(self.terms), np.int64)
        np.add.at(whole, self.t, count)
        self.q = share(whole, r["lang_total"] + 2 * r["v"])
        # Terms by their bytes, so that ties go to the least.
        self.rank = np.empty(len(self.terms), np.int64)
        self.rank[sorted(range(len(self.terms)), key=lambda i: self.terms[i].encode())] = np.arange(len(self.terms))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each cell by row; rows without cells have 0."""
        out, full = np.zeros(len(self.names), np.int64), np.flatnonzero(self.size)
        if len(full):
            out[full] = np.add.reduceat(values.astype(np.int64), self.at[:-1][full])
        return out

    def pairs(self, h: int) -> np.ndarray:
        """Divergences of source ``h`` from every source, summed over the block's terms.

        Each cell of the other source is compared with what ``h`` has there; cells that
        only ``h`` has follow, and last the terms that neither has, all with the same shares.
        """
        own = slice(self.at[h], self.at[h + 1])
        row, has = np.full(len(self.terms), self.zero[h]), np.zeros(len(self.terms), bool)
        row[self.t[own]], has[self.t[own]] = self.p[own], True
        met, both = row[self.t], has[self.t]
        theirs, shared = self.sums(apart(self.p, met)), self.sums(both)
        not_theirs = -self.sums(np.where(both, apart(self.zero[self.g], met), 0))
        step = max(1, (1 << 20) // max(1, self.size[h]))
        for a in range(0, len(self.names), step):
            not_theirs[a : a + step] += apart(self.zero[a : a + step, None], self.p[own][None, :]).sum(axis=1)
        neither = len(self.terms) - self.size - self.size[h] + shared
        return theirs + not_theirs + neither * apart(self.zero, self.zero[h])

    def best_terms(self, h: int, top: int) -> list[tuple[str, int]]:
        """The ``top`` terms, with their divergences, of those that have a larger share in ``h`` than in the language."""
        own = slice(self.at[h], self.at[h + 1])
        more = self.p[own] > self.q[self.t[own]]
        ts, value = self.t[own][more], apart(self.p[own][more], self.q[self.t[own][more]])
        best = np.lexsort((self.rank[ts], -value))[:top]
        return [(self.terms[i], v) for i, v in zip(ts[best].tolist(), value[best].tolist(), strict=True)]


def _compare(top: int, tile: int):
    """For rows of a block, its language's sources and a tile of them: the pairs and best terms of the tile's sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                b, found = Block(r), []
                for h in range(r["tile"] * tile, min((r["tile"] + 1) * tile, len(b.names))):
                    found += [(b.names[h], "pair", b.names[o], v) for o, v in enumerate(b.pairs(h).tolist()) if o != h]
                    found += [(b.names[h], "term", t, v) for t, v in b.best_terms(h, top)]
                source, part, item, value = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([b.lang] * len(found), pa.string()), pa.array(source, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    return run


def term_counts(docs: DataFrame, least: int = 10, block: int = BLOCK) -> DataFrame:
    """``lang, term, cells`` (array of ``source, occ``) of the terms that at least ``least`` documents of the language have; ``docs``: ``lang, source, text`` without nulls.

    Each task counts blocks of texts, so that a frequent term is a row for each block
    and group and not for each occurrence; counts are summed again before they are
    shuffled. What is gathered for a term is one cell for each source that has it.
    """
    counted = docs.mapInArrow(_counter(block), "lang string, source string, term string, occ long, docs long")
    cells = counted.groupBy("lang", "term", "source").agg(F.sum("occ").alias("occ"), F.sum("docs").alias("docs"))
    return cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "occ")).alias("cells")).where(F.col("docs") >= least).select("lang", "term", "cells")


def audit(docs: DataFrame, least: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", block: int = BLOCK, terms: int = TERMS, tile: int = TILE) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every source of every language its divergence from each other source (part ``pair``), and its ``top`` overrepresented terms (part ``term``).

    Nulls in text, lang and source count as ''. Terms are runs of ASCII letters and of
    characters beyond ASCII, A-Z lower-cased. A language keeps the terms that at least
    ``least`` of its documents have; without any, its pairs have the value 0.
    Values fall with the rank, ties go by the item's UTF-8 bytes. Repeated
    rows count each; a source alone in its language has no pairs; an empty table
    gives no rows; other columns are ignored. Long texts are one block of their own.
    """
    plain = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    kept = written(term_counts(plain, least, block))
    named = plain.select("lang", "source").distinct()
    occurring = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.occ").alias("total"))
    sums = named.join(occurring, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    # One row for each language; the result itself has a row for each pair of its sources.
    listed = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("s"), F.sum("total").alias("lang_total"))
    sized = kept.groupBy("lang").agg(F.count("*").alias("v"))
    langs = written(listed.join(sized, "lang", "left").select("lang", F.col("s.source").alias("sources"), F.col("s.total").alias("totals"), "lang_total", F.coalesce("v", F.lit(0)).alias("v")))
    csr = kept.mapInArrow(_csr(terms), "lang string, terms array<string>, cell_source array<string>, cell_term array<int>, cell_count array<long>")
    tiles = F.explode(F.expr(f"sequence(0, CAST((size(sources) - 1) div {tile} AS int))"))
    met = csr.join(langs, "lang").withColumn("tile", tiles)
    found = met.mapInArrow(_compare(top, tile), "lang string, source string, part string, item string, value long")
    # A term stands in one block, a pair in each: both are sums by the same key.
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    without = langs.where("v = 0").select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", F.lit("pair").alias("part"), F.explode("sources").alias("item"), F.lit(0).cast("long").alias("value")).where("source <> item")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.unionByName(without).withColumn("rank", F.row_number().over(order))
    return ranked.where(f"part = 'pair' OR rank <= {top}").select("lang", "source", "part", "item", "value", "rank")
