"""Nearest neighbours by inner product over additively quantised vectors.

A vector's direction is approximated by a sum of full-dimensional code vectors, one
from each of several residual codebooks, chosen by beam search. Its codes are stored
with its norm and the norm of its approximation. A query makes a table of its inner
products with all code vectors once; a candidate's score is then the sum of a few
table entries, brought to the stored norm. The best candidates by that score are
compared again exactly, in double precision, on the original vectors.

Directions are unit vectors, found after a division by the largest component, so
that no finite vector is too long or too short. Norms are compared within bands of
60 powers of two; each band keeps its own best candidates until they are compared
exactly, so that none is lost beside much longer ones.

The codebooks are fitted on a bounded sample; every vector is encoded. Equal
vectors are one entry of the index, with the least ids that a result can need.
Blocks of queries meet blocks of codes: no vector is compared outside of them, and
what a task holds is bounded by one block of each. Vectors of different dimensions
never meet: each dimension has its own index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


class Codebooks:
    """``books``: float32 array of codebooks, codes, dimensions."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.norms = (books**2).sum(axis=2)

    def encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        """Codes of each row, by beam search for the least squared error."""
        n, (m, size, d) = len(x), self.books.shape
        rest, codes, width = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8), 1
        for k in range(m):
            cost = self.norms[k] - 2 * (rest.reshape(-1, d) @ self.books[k].T).reshape(n, width, size) + (rest**2).sum(axis=2)[:, :, None]
            flat = cost.reshape(n, -1)
            keep = min(beam if k < m - 1 else 1, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            parent, code = best // size, best % size
            rows = np.arange(n)[:, None]
            rest = rest[rows, parent] - self.books[k][code]
            codes = np.concatenate([codes[rows, parent], code[:, :, None].astype(np.uint8)], axis=2)
            width = keep
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[k][codes[:, k]] for k in range(len(self.books)))


def fit(x: np.ndarray, m: int, size: int, beam: int, rounds: int = 4, joint: int = 2, seed: int = 3) -> Codebooks:
    """Residual k-means, then the codebooks in turn by least squares given the others, for codes that are encoded anew."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    d = x.shape[1] if len(x) else 1
    books, rest = np.zeros((m, size, d), np.float32), x.copy()
    for k in range(m) if len(x) else ():
        centers = rest[rng.permutation(len(rest))[:size]] if len(rest) >= size else np.concatenate([rest, np.zeros((size - len(rest), d), np.float32)])
        for _ in range(rounds):
            near = ((centers**2).sum(axis=1) - 2 * rest @ centers.T).argmin(axis=1)
            count = np.bincount(near, minlength=size)
            sums = np.zeros_like(centers)
            np.add.at(sums, near, rest)
            centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
        near = ((centers**2).sum(axis=1) - 2 * rest @ centers.T).argmin(axis=1)
        books[k], rest = centers, rest - centers[near]
    out = Codebooks(books)
    for _ in range(joint if len(x) > size else 0):
        codes = out.encode(x, beam)
        error = x - out.decode(codes)
        for k in list(range(m)) * 2:  # each codebook's least squares, given the others
            count = np.bincount(codes[:, k], minlength=size)
            sums = np.zeros((size, d), np.float32)
            np.add.at(sums, codes[:, k], error)
            step = sums / np.maximum(count, 1)[:, None]
            out.books[k] += step
            error -= step[codes[:, k]]
        out = Codebooks(out.books)
    return out


#: Norms of one band differ by a factor of two to this power at most.
BAND = 60


def units(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the logarithms (base 2) of the vectors' norms; neither overflows nor vanishes for finite vectors."""
    x = np.asarray(column.flatten(), np.float64).reshape(-1, d)
    # By powers of two, which are exact; a quotient by a subnormal number would overflow.
    power = np.frexp(np.abs(x).max(axis=1, initial=0))[1]
    x = np.ldexp(x, -power[:, None])
    norm = np.sqrt((x**2).sum(axis=1))
    return x / norm[:, None], np.log2(norm) + power


def _encoder(books: object, beam: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                x, log_norm = units(part.column("embedding"), books.value.books.shape[2])
                codes = books.value.encode(x, beam)
                fitted = np.sqrt((books.value.decode(codes).astype(float) ** 2).sum(axis=1))
                ids = part.column("vec_id").to_numpy().astype("<i8")
                band = np.floor(log_norm / BAND + 0.5).astype(np.int64)
                for b in np.unique(band).tolist():
                    own = band == b
                    norm = np.exp2(log_norm[own] - BAND * b).astype("<f4")
                    yield pa.RecordBatch.from_pydict({"shard": [made], "band": [b], "ids": [ids[own].tobytes()], "codes": [codes[own].tobytes()], "norms": [norm.tobytes()], "fitted": [fitted[own].astype("<f4").tobytes()]})
                    made += 1

    return run


def _blocks(d: int, block: int):
    """Rows sorted by ``query_block`` to rows of at most ``block`` queries, as unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("query_block").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
            for a, z in zip(starts, [*starts[1:], len(key)], strict=True):
                for i in range(a, z, block):
                    part = batch.slice(i, min(block, z - i))
                    ids = part.column("vec_id").to_numpy().astype("<i8")
                    yield pa.RecordBatch.from_pydict({"query_block": pa.array([key[a]], pa.int32()), "query_ids": [ids.tobytes()], "queries": [units(part.column("embedding"), d)[0].astype("<f4").tobytes()]})

    return run


class _Best:
    """The ``short`` best candidates so far of some queries, by tables of inner products."""

    def __init__(self, ids: np.ndarray, table: np.ndarray, short: int):
        self.ids, self.table, self.short = ids, table, short
        self.near, self.found = np.full((len(ids), 0), -np.inf, np.float32), np.zeros((len(ids), 0), np.int64)

    def meet(self, ids: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> None:
        score = self.table[0][codes[:, 0]]
        for k in range(1, len(self.table)):
            score += self.table[k][codes[:, k]]
        score *= scale[:, None]
        near, found = score.T, np.broadcast_to(ids, score.T.shape)
        if near.shape[1] > self.short:
            near, found = self._least(near, found)
        self.near, self.found = np.concatenate([self.near, near], axis=1), np.concatenate([self.found, found], axis=1)
        if self.near.shape[1] > self.short:
            self.near, self.found = self._least(self.near, self.found)

    def _least(self, near: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.argpartition(-near, self.short - 1, axis=1)[:, : self.short]
        return np.take_along_axis(near, keep, axis=1), np.take_along_axis(found, keep, axis=1)

    def batch(self, band: int) -> pa.RecordBatch:
        query, place = np.nonzero(self.near > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[query]), pa.array(np.full(len(query), band, np.int64)), pa.array(self.found[query, place]), pa.array(self.near[query, place].astype(np.float64))], names=["query_id", "band", "rep", "near"])


def _scorer(books: object, short: int):
    """For rows sorted by query block, band, group and ``coded``: the ``short`` best candidates of each query over a group.

    A group's first rows have the queries, some of the block each; the others have codes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        m, size, d = books.value.books.shape
        for batch in batches:
            for row in batch.to_pylist():
                if (row["query_block"], row["band"], row["shards"]) != key:
                    for part in parts:
                        yield part.batch(key[1])
                    key, parts = (row["query_block"], row["band"], row["shards"]), []
                if not row["coded"]:
                    q = np.frombuffer(row["queries"], "<f4").reshape(-1, d)
                    table = np.einsum("qd,mkd->mkq", q, books.value.books, optimize=True).astype(np.float32)
                    parts.append(_Best(np.frombuffer(row["query_ids"], "<i8"), table, short))
                    continue
                ids, codes = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["codes"], np.uint8).reshape(-1, m)
                scale = np.frombuffer(row["norms"], "<f4") / np.maximum(np.frombuffer(row["fitted"], "<f4"), np.float32(1e-6))
                for part in parts:
                    part.meet(ids, codes, scale)
        for part in parts:
            yield part.batch(key[1])

    return run


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` (array of doubles) of the rows that take part; of rows with one id, the least vector."""
    v = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast("array<double>").alias("embedding"))
    fine = "vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    return v.where(fine).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def search(rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **more: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose id is divisible by ``every``.

    Vectors that are null, zero or hold null or non-finite components take no part.
    Those of another dimension have no inner product with a query and are no
    candidates of it; each dimension is searched by itself. Ties go to the smaller
    id. Rows with one id count once, with the least vector. With few distinct
    candidates the result is exact; an empty table, or a single vector, gives no
    rows; other columns are ignored. Vectors of any finite length are found alike;
    only inner products that vanish or overflow in double precision themselves tie
    without regard to ids. ``more``: parameters of ``search_one``.
    """
    vectors = written(usable(rows, id_col, vector_col))
    found = None
    for size in vectors.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect():
        own = search_one(vectors.where(F.size("embedding") == size["d"]), size["d"], every, k, **more)
        found = own if found is None else found.unionByName(own)
    return search_one(vectors, 1, every, k, **more) if found is None else found


def search_one(vectors: DataFrame, d: int, every: int, k: int, books: int = 24, codes: int = 256, beam: int = 4, sample: int = 8192, short: int = 192, block: int = 2048, query_block: int = 4096, queries_at_once: int = 1024, group_bytes: int = 16 << 20) -> DataFrame:
    """The search among vectors of one dimension: codebooks are fitted on ``sample`` of them, all are encoded. With at most ``short`` distinct candidates the result is exact.

    Codes are sent once for each ``query_block`` queries. They are dealt to groups of
    about ``group_bytes``, at least one for each core; a task holds one block of
    codes, the tables of a block of queries and their best candidates.
    """
    spark = vectors.sparkSession
    # A result needs at most k + 1 ids of one vector; row_number() up to that is cut in each task before the shuffle.
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    entries = written(
        vectors.withColumn("nth", nth).where(F.col("nth") <= k + 1)
        .groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("vec_ids"))
        .withColumn("rep", F.col("vec_ids")[0])
    )
    drawn = entries.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").toArrow().column("embedding").combine_chunks()
    trained = spark.sparkContext.broadcast(fit(units(drawn, d)[0] if len(drawn) else np.zeros((0, d)), books, codes, beam))  # a fixed size
    shards = written(entries.select(F.col("rep").alias("vec_id"), "embedding").mapInArrow(_encoder(trained, beam, block), "shard long, band long, ids binary, codes binary, norms binary, fitted binary"))
    queries = vectors.where(F.col("vec_id") % every == 0)
    # Blocks of queries and groups of codes by number: no row needs to know which others there are.
    n_blocks = max(1, -(-queries.count() // query_block))
    size = shards.agg(F.sum(F.octet_length("codes") + 2 * F.octet_length("ids")).alias("bytes")).first()["bytes"] or 0
    groups = max(spark.sparkContext.defaultParallelism, -(-size // group_bytes))
    numbered = queries.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")).repartition("query_block").sortWithinPartitions("query_block")
    asked = written(numbered.mapInArrow(_blocks(d, queries_at_once), "query_block int, query_ids binary, queries binary"))
    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    coded = shards.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("query_block"), "band", F.pmod(F.hash("shard"), F.lit(groups)).alias("shards"), F.lit(True).alias("coded"), *none("query_ids", "queries"), "ids", "codes", "norms", "fitted")
    places = [r["band"] for r in shards.select("band").distinct().collect()]  # 40 at most
    sent = (
        asked.select("query_block", F.explode(F.array(*(F.lit(b).cast("long") for b in places)) if places else F.array().cast("array<long>")).alias("band"), "query_ids", "queries")
        .select("query_block", "band", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("shards"), F.lit(False).alias("coded"), "query_ids", "queries", *none("ids", "codes", "norms", "fitted"))
    )
    by = ["query_block", "band", "shards"]
    met = coded.unionByName(sent).repartition(*by).sortWithinPartitions(*by, "coded")
    found = met.mapInArrow(_scorer(trained, short), "query_id long, band long, rep long, near double")
    nearest = Window.partitionBy("query_id", "band").orderBy(F.desc("near"), "rep")
    listed = found.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= short).select("query_id", "rep")
    exact = F.expr("aggregate(zip_with(q, embedding, (a, b) -> a * b), 0D, (s, x) -> s + x)")
    scored = (
        listed.join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
        .join(entries, "rep").select("query_id", "vec_ids", exact.alias("score"))
        .select("query_id", "score", F.explode("vec_ids").alias("vec_id")).where("vec_id <> query_id")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
