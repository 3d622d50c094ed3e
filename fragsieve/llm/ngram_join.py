"""Self-join of documents on the Jaccard similarity of their word n-grams.

Documents are rows and n-grams columns of a sparse 0/1 matrix; overlaps are
entries of its product with its own transpose, which is computed in blocks: a task
multiplies a tile of rows with another one, block of columns by block of columns,
accumulates the overlap counts, and discards a pair as soon as what is left can't
reach the overlap that both sizes ask for. It gives a spanning forest of the links
it finds, never all pairs: at most as many rows as the tiles have.

Which tiles meet is decided by sizes too. In any fixed order of the columns, two
rows that are similar enough share one of the first ``n - ceil(t * n) + 1`` columns
of each, the deciding ones. Documents with equal sets are one row. A row is first
multiplied with the central row of its columns that it shares most of them with;
that settles most groups of copies. Columns whose rows aren't all in one component
then put their rows into tiles (by the most frequent of them and by size), and two
tiles meet if they share such a column: first with their deciding columns only, then
with an eighth of all columns, which leaves few rows, then these with whole sets.
At each step the rows go that no pair keeps possible. So no link between different
sets that matters to a component is lost, whatever the size of a group.

The order of the columns is by hash, with frequent ones last; it only decides how
much work there is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytespans as B
from .components import components
from .tables import scratch, texts, written

#: All bytes but \\x20 and \\x09-\\x0D (fixed values).
MEMBER = ~B.byte_class((0x20, 0x20), (0x09, 0x0D))
#: Rows and shingles of a tile (a longer row is a tile by itself), and columns of a block.
TILE_ROWS, TILE_SHINGLES, COLUMNS = 512, 1 << 18, 4096
#: Shingles in one row of a table, so that Arrow batches stay small with long documents.
PIECE = 4096


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and second hash of the distinct shingles of each text, sorted by the first two; a shorter text is one shingle."""
    h, second, doc = B.word_hashes(data, offs, MEMBER)
    n = np.bincount(doc, minlength=len(offs) - 1)
    owner, grams, others = [], [], []
    for k in range(1, size + 1):
        at = np.flatnonzero(doc[: max(len(doc) - k + 1, 0)] == doc[k - 1 :])
        if k < size:
            at = at[n[doc[at]] == k]
        if len(at):
            owner.append(doc[at])
            grams.append(B.gram_hashes(h, k)[at])
            others.append(B.gram_hashes(second, k)[at])
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    owner, grams, others = np.concatenate(owner), np.concatenate(grams), np.concatenate(others)
    order = np.lexsort((grams, owner))
    owner, grams, others = owner[order], grams[order], others[order]
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])]
    return owner[fresh], grams[fresh], others[fresh]


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


def _summed(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Sum of the mixed values of each set (0 for empty sets)."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(B.mixed(values), out=total[1:])
    cut = np.searchsorted(owner, np.arange(n + 1))
    return pa.array((total[cut[1:]] - total[cut[:-1]]).view(np.int64))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(B.row_keys(done, batch.num_rows)), *batch.columns], names=["id", *batch.schema.names])
        done += batch.num_rows


def _signed(size: int, thin: int):
    """``id, doc_id``, set size, a signature of the set by two independent hashes, and about one in ``thin`` of its shingles (a different choice for each row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in B.blocks(batches):
            n = part.num_rows
            owner, grams, others = shingle_sets(data, offs, size)
            keys = part.column("id").to_numpy().astype(np.uint64)
            some = B.mixed(grams ^ B.mixed(keys)[owner]) % np.uint64(thin) == 0
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("doc_id"), pa.array(np.bincount(owner, minlength=n)), _summed(grams, owner, n), _summed(others, owner, n), _lists(grams[some], owner[some], n)],
                names=["id", "doc_id", "n", "s1", "s2", "some"],
            )

    return run


def _deciding(size: int, percent: int, frequent: object):
    """The columns that can decide a pair, and where in the order they end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in B.blocks(batches):
            n = part.num_rows
            owner, grams, _ = shingle_sets(data, offs, size)
            count = np.bincount(owner, minlength=n)
            first = np.cumsum(count) - count
            late = np.zeros(len(grams), bool)
            if len(frequent.value):
                late = frequent.value[np.minimum(np.searchsorted(frequent.value, grams), len(frequent.value) - 1)] == grams
            order = np.argsort(2 * owner + late, kind="stable")
            needed = count - (count * percent + 99) // 100 + 1
            use = np.arange(len(grams)) - first[owner] < needed[owner]
            edge = np.zeros(n, np.uint64)
            some = np.flatnonzero(count)
            last = order[first[some] + needed[some] - 1]
            edge[some] = (late[last].astype(np.uint64) << np.uint64(62)) | (grams[last] >> np.uint64(2))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(count), pa.array(edge.view(np.int64)), _lists(grams[order][use], owner[use], n)], names=["id", "n", "edge", "keys"])

    return run


def _pieces(size: int, block: bool):
    """``id`` and the set in sorted pieces; with ``block`` only a fixed eighth of the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in B.blocks(batches):
            owner, grams, _ = shingle_sets(data, offs, size)
            if block:
                use = grams >> np.uint64(61) == 0
                owner, grams = owner[use], grams[use]
            count = np.bincount(owner, minlength=part.num_rows)
            row, nth = B.ragged(np.maximum(-(-count // PIECE), 1))
            at = (np.cumsum(count) - count)[row] + nth * PIECE
            cut = pa.array(np.r_[at, len(grams)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), pa.array(nth.astype(np.int32)), pa.ListArray.from_arrays(cut, pa.array(grams.view(np.int64)))], names=["id", "piece", "grams"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Whole groups of successive rows with equal ``g1, g2``, at least ``least`` rows at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        g1, g2 = batch.column("g1").to_numpy(), batch.column("g2").to_numpy()
        if held and rows >= least:
            old = held[-1]
            same = (g1 == old.column("g1")[-1].as_py()) & (g2 == old.column("g2")[-1].as_py())
            ends = len(same) if same.all() else int(np.argmin(same))
            if ends < len(same):
                yield pa.Table.from_batches([*held, batch.slice(0, ends)])
                held, rows = [], 0
                batch = batch.slice(ends)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before (the first one does)."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def incidence(row: np.ndarray, column: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, width), np.float32)
    out[row, column] = 1
    return out


def products(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray], open_: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of a left and a right row can be similar enough, by all entries that are given.

    ``left`` and ``right``: row number and column of the entries of two sparse
    blocks; ``sizes``: entries of each whole row (with more of them than are given,
    the rest might all be shared); ``open_``: pairs that are of interest.
    """
    outside = [n - np.bincount(row, minlength=len(n)) for (row, _), n in zip((left, right), sizes, strict=True)]
    beyond = np.minimum(outside[0][:, None], outside[1][None, :])
    need = -(-percent * (sizes[0][:, None] + sizes[1][None, :]) // (100 + percent))
    open_ = open_ & (np.minimum(sizes[0][:, None], sizes[1][None, :]) >= need)
    # Only columns that both have entries in count.
    names, at = np.unique(np.concatenate([left[1], right[1]]), return_inverse=True)
    sides = [(left[0], at[: len(left[1])]), (right[0], at[len(left[1]) :])]
    both = np.ones(len(names), bool)
    for _, column in sides:
        both &= np.bincount(column, minlength=len(names)) > 0
    place = np.cumsum(both) - 1
    sides = [(row[both[column]], place[column[both[column]]]) for row, column in sides]
    width = int(both.sum())
    overlap = np.zeros(open_.shape, np.int64)
    for first in range(0, width, COLUMNS):
        rows = [np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))]
        if not len(rows[0]):
            break
        blocks, rest = [], []
        for own, (row, column), n in zip(rows, sides, open_.shape, strict=True):
            number = np.full(n, -1)
            number[own] = np.arange(len(own))
            use = (column >= first) & (column < first + COLUMNS) & (number[row] >= 0)
            blocks.append(incidence(number[row[use]], column[use] - first, len(own), min(COLUMNS, width - first)))
            rest.append(np.bincount(row[column >= first + COLUMNS], minlength=n)[own])
        where = np.ix_(*rows)
        overlap[where] += (blocks[0] @ blocks[1].T).astype(np.int64)
        left_ = np.minimum((outside[0][rows[0]] + rest[0])[:, None], (outside[1][rows[1]] + rest[1])[None, :])
        open_[where] &= overlap[where] + left_ >= need[where]
    return open_ & (overlap + beyond >= need)


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of links that connect what all links connect."""
    a, b = [], []
    rest = linked.any(axis=1)
    seen = np.zeros(linked.shape[1], bool)
    while rest.any():
        new = np.array([int(np.argmax(rest))])
        rest[new] = False
        while len(new):
            columns = np.flatnonzero(linked[new].any(axis=0) & ~seen)
            seen[columns] = True
            a.append(new[linked[np.ix_(new, columns)].argmax(axis=0)])
            b.append(columns)
            new = np.flatnonzero(rest & linked[:, columns].any(axis=1)) if len(columns) else columns
            rest[new] = False
            if len(new):
                a.append(new)
                b.append(columns[linked[np.ix_(new, columns)].argmax(axis=1)])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _multiplied(percent: int, whole: bool):
    """Rows of ``g1, g2, side, id, root, n, piece, grams``, sorted so, by the products of their groups' sides: with ``whole`` sets
    to links ``a, b`` between rows that aren't of one root, else to the rows ``g1, g2, side, id, root, n`` of possible ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 1):
            g1, g2, side, ids, root, size = (table.column(c).to_numpy() for c in ("g1", "g2", "side", "id", "root", "n"))
            lists = table.column("grams").combine_chunks()
            grams, length = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            edge = np.cumsum(length)
            cuts = [*np.flatnonzero(_changes(g1, g2)).tolist(), len(g1)]
            found: list[list[np.ndarray]] = [[], []]
            for i, j in zip(cuts, cuts[1:], strict=False):
                head = np.flatnonzero(_changes(side[i:j], ids[i:j])) + i
                entries = grams[edge[i] - length[i] : edge[j - 1]]
                row = np.repeat(np.searchsorted(head, np.arange(i, j), "right") - 1, length[i:j])
                cut = int((side[head] == 0).sum())
                if cut in (0, len(head)):
                    continue
                a, b = ids[head[:cut]], ids[head[cut:]]
                open_ = root[head[:cut]][:, None] != root[head[cut:]][None, :]
                open_ &= (a[:, None] < b[None, :]) if g1[i] == g2[i] else (a[:, None] != b[None, :])
                at, n = int(np.searchsorted(row, cut)), size[head]
                ok = products((row[:at], entries[:at]), (row[at:] - cut, entries[at:]), (n[:cut], n[cut:]), open_, percent)
                if whole:
                    x, y = forest(ok)
                    found[0].append(a[x])
                    found[1].append(b[y])
                else:
                    found[0].append(head[np.r_[ok.any(axis=1), ok.any(axis=0)]])
            if whole and found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found], names=["a", "b"])
            elif found[0]:
                alive = pa.array(np.concatenate(found[0]))
                names = ["g1", "g2", "side", "id", "root", "n"]
                yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(alive) for c in names], names=names)

    return run


def _beyond(n: np.ndarray, percent: int) -> np.ndarray:
    """Columns of a row that aren't deciding ones."""
    return (n * percent + 99) // 100 - 1


def _candidates(percent: int):
    """Rows of ``g1, g2, side, id, key, n, edge, root``, sorted so, to the rows ``g1, g2, side, id, root, n`` of which some pair can still be similar enough.

    A pair's overlap is at most the deciding columns it shares and those beyond them
    of the row whose deciding columns end first, all of whose others are known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 1 << 16):
            g1, g2, side, ids, key, n, edge, root = (table.column(c).to_numpy() for c in ("g1", "g2", "side", "id", "key", "n", "edge", "root"))
            head = np.flatnonzero(_changes(g1, g2, side, ids))
            row = np.searchsorted(head, np.arange(len(g1)), "right") - 1
            group = np.cumsum(_changes(g1, g2)) - 1
            side_, ids_, n_, edge_, root_, same = side[head], ids[head], n[head], edge[head], root[head], (g1 == g2)[head]
            # Entries by group, column and side: runs of the rows that share a column.
            order = np.lexsort((side, key, group))
            start = np.flatnonzero(_changes(group[order], key[order]))
            total = np.diff(np.r_[start, len(order)])
            right = np.add.reduceat(side[order].astype(np.int64), start)
            left = total - right
            pairs = np.bincount(group[order][start], weights=left * right)
            entries = np.bincount(group)
            sparse = (pairs <= 8 * entries)[group[order][start]]
            x, y, shared = [], [], []
            run_, k = B.ragged((left * right)[sparse])
            first, l, r = start[sparse][run_], left[sparse][run_], right[sparse][run_]  # noqa: E741
            if len(k):
                code, count = np.unique(row[order[first + k // r]] * len(head) + row[order[first + l + k % r]], return_counts=True)
                x.append(code // len(head))
                y.append(code % len(head))
                shared.append(count)
            for g in np.flatnonzero(pairs > 8 * entries).tolist():
                own = np.flatnonzero(group == g)
                rows = np.unique(row[own])
                cut = int((side_[rows] == 0).sum())
                _, column = np.unique(key[own], return_inverse=True)
                local = row[own] - rows[0]
                overlap = np.zeros((cut, len(rows) - cut), np.int64)
                for at in range(0, int(column.max()) + 1, COLUMNS):
                    use = (column >= at) & (column < at + COLUMNS)
                    whole = incidence(local[use], column[use] - at, len(rows), min(COLUMNS, int(column.max()) + 1 - at))
                    overlap += (whole[:cut] @ whole[cut:].T).astype(np.int64)
                i, j = np.nonzero(overlap)
                x.append(rows[i])
                y.append(rows[cut + j])
                shared.append(overlap[i, j])
            if not x:
                continue
            x, y, shared = (np.concatenate(v) for v in (x, y, shared))
            ea, eb, na, nb = edge_[x], edge_[y], n_[x], n_[y]
            ba, bb = _beyond(na, percent), _beyond(nb, percent)
            rest = np.where(ea < eb, ba, np.where(ea > eb, bb, np.maximum(ba, bb)))
            ok = (root_[x] != root_[y]) & np.where(same[x], ids_[x] < ids_[y], ids_[x] != ids_[y])
            ok &= (100 + percent) * (shared + rest) >= percent * (na + nb)
            alive = np.union1d(x[ok], y[ok])
            at = head[alive]
            yield pa.RecordBatch.from_arrays([pa.array(v[at]) for v in (g1, g2, side, ids, root, n)], names=["g1", "g2", "side", "id", "root", "n"])

    return run


def _in_tiles(members: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``chunk`` to ``members``: a number below what the rows and shingles of each group ``by`` ask for."""
    sized = members.groupBy(*by).agg(F.count("*").alias("rows_"), F.sum("n").alias("shingles_"))
    parts = F.greatest(F.ceil(F.col("rows_") / TILE_ROWS), F.ceil(F.col("shingles_") / TILE_SHINGLES))
    return members.join(sized.select(*by, parts.alias("parts_")), by).withColumn("chunk", F.pmod(F.xxhash64("id"), "parts_")).drop("parts_")


def _met(members: DataFrame, rows: DataFrame, size: int, bound: int, block: bool) -> DataFrame:
    """The groups ``g1, g2, side, id, root, n`` with the sets of their rows, each group's in one task. Only members' texts give sets."""
    few = members.count() <= bound
    ids = members.select("id").distinct()
    sets = rows.select("id", "text").join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(_pieces(size, block), "id long, piece int, grams array<long>")
    met = sets.join(F.broadcast(members) if few else members, "id")
    return met.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "side", "id", "piece").select("g1", "g2", "side", "id", "root", "n", "grams")


def ngram_join(docs: DataFrame, size: int = 4, percent: int = 85, thin: int = 16, often: int = 8, most: int = 200_000, bound: int = 200_000, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Two rows link if 100 * shared shingles >= ``percent`` * all shingles of both.
    Null texts and texts without words have no shingle and are linked with nothing
    (their component is themselves); equal rows are in one component; a null id
    takes part, and is a component's id only if there is no other; an empty table
    gives no rows; other columns are ignored.

    The rest changes only the amount of work. Shingles of which the thinned counts
    (one in ``thin`` occurrences, over all rows) reach ``often`` come last in the
    order of columns; at most the ``most`` most frequent are treated so, which
    bounds what is broadcast. Up to ``bound`` members of groups are broadcast to
    the texts that give their sets; more are joined by a shuffle. ``keyed`` tells
    that ids are unique and not null, and ``docs`` a table: texts are then read
    from it again instead of being written with a key of each row.
    """
    with scratch(docs.sparkSession):
        return written(_joined(texts(docs, id_col, text_col), size, percent, thin, often, most, bound, keyed), keep=True)


def _joined(docs: DataFrame, size: int, percent: int, thin: int, often: int, most: int, bound: int, keyed: bool) -> DataFrame:
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").alias("id"), "doc_id", "text") if keyed else written(docs.mapInArrow(_numbered, "id long, doc_id long, text string"))
    signed = written(rows.mapInArrow(_signed(size, thin), "id long, doc_id long, n long, s1 long, s2 long, some array<long>"))
    classes = written(signed.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("id"), F.min("doc_id").alias("least")))
    counted = signed.select(F.explode("some").alias("key")).groupBy("key").count().where(F.col("count") >= often)
    late = counted.orderBy(F.desc("count"), "key").limit(most).select("key").toArrow().column("key").to_numpy()
    frequent = context.broadcast(np.sort(late.astype(np.int64).view(np.uint64)))
    deciding = rows.select("id", "text").mapInArrow(_deciding(size, percent, frequent), "id long, n long, edge long, keys array<long>")
    deciding = written(deciding.join(classes.select("id"), "id", "left_semi"))
    every = deciding.select("id", "n", "edge", F.explode("keys").alias("key"))
    shared_by = every.groupBy("key").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    entries = written(every.join(shared_by, "key").select("id", "n", "edge", "key", "n_rows"))
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)

    # A column's central row is the one whose columns have most rows: near copies are closest to what they were copied from.
    weight = entries.groupBy("id").agg(F.sum("n_rows").alias("weight"))
    central = entries.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("least"), "n")).alias("first"))
    met = entries.join(central.select("key", (-F.col("first.least")).alias("a"), F.col("first.n").alias("na")), "key")
    best = (
        met.where((F.col("id") != F.col("a")) & fits(F.col("n"), F.col("na"))).groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("shared"))
        .groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    )
    side = lambda c: deciding.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("edge").alias(f"e{c}"), F.col("keys").alias(f"k{c}"))
    beyond = lambda n: F.floor((n * percent + 99) / 100) - 1
    na, nb, ea, eb = (F.col(c) for c in ("na", "nb", "ea", "eb"))
    rest = F.when(ea < eb, beyond(na)).when(ea > eb, beyond(nb)).otherwise(F.greatest(beyond(na), beyond(nb)))
    possible = (100 + percent) * (F.size(F.array_intersect("ka", "kb")) + rest) >= percent * (na + nb)
    stars = best.join(side("b"), "b").join(side("a"), "a").where(possible).select("a", "na", F.col("b").alias("id"), F.col("nb").alias("n"))
    stars = written(_in_tiles(written(stars), ["a"]))
    members = stars.select("a", "chunk", F.lit(1).alias("side"), "id", "n").unionByName(stars.select("a", "chunk", F.lit(0).alias("side"), F.col("a").alias("id"), F.col("na").alias("n")).distinct())
    # A group of a central row has no second tile: -1 never equals a central row.
    members = written(members.select(F.col("a").alias("g1"), (-1 - F.col("chunk")).alias("g2"), "side", "id", F.col("id").alias("root"), "n"))
    links = written(_met(members, rows, size, bound, False).mapInArrow(_multiplied(percent, True), "a long, b long"))

    # Columns whose rows aren't all in one component.
    marked = entries.join(components(links).withColumnRenamed("node", "id"), "id", "left").select("id", "n", "edge", "key", F.coalesce("root", "id").alias("root"))
    mixed = marked.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n_rows")).where("lo < hi").select("key", "n_rows")
    left = written(marked.join(mixed, "key"))
    # A little wider than the ratio of sizes that can link, so that rounding doesn't put these more than one band apart.
    band = F.floor(F.log("n") / (1.001 * math.log(100 / percent))) if percent < 100 else F.col("n")
    placed = left.groupBy("id", "n").agg(F.max(F.struct("n_rows", "key")).alias("top")).select("id", "n", F.col("top.key").alias("top"), band.alias("band"))
    tiles = _in_tiles(placed, ["top", "band"]).select("id", "band", F.xxhash64("top", "band", "chunk").alias("tile"))
    left = written(left.join(tiles, "id").drop("n_rows"))
    others = left.groupBy("key", "tile", "band").agg(F.count("*").alias("many"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    others = others.select("key", F.col("tile").alias("tile2"), F.col("band").alias("band2"), "many", "lo", "hi")
    apart = "(lo < hi OR lo <> root) AND abs(band - band2) <= 1 AND (tile <> tile2 OR many > 1)"
    g1 = F.least("tile", "tile2")
    sides = F.when(F.col("tile") == F.col("tile2"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("tile") != g1).cast("int")))
    met = left.join(others, "key").where(apart).select(g1.alias("g1"), F.greatest("tile", "tile2").alias("g2"), F.explode(sides).alias("side"), "id", "key", "n", "edge", "root")
    met = met.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "side", "id")
    group = "g1 long, g2 long, side int, id long, root long, n long"
    alive = written(met.mapInArrow(_candidates(percent), group))
    alive = written(_met(alive, rows, size, bound, True).mapInArrow(_multiplied(percent, False), group))
    more = written(_met(alive, rows, size, bound, False).mapInArrow(_multiplied(percent, True), "a long, b long"))

    labelled = classes.join(components(links.unionByName(more)).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "root").select("n", "s1", "s2", "component_id")
    out = signed.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
