"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes by learned rotations. A code is split into m substrings and each
substring has an index of its own. Of the codes within a radius of the query's (radius = m * near
+ more), each agrees with it up to `near` bits in one of the first more + 1 substrings, or up to
near - 1 bits in one of the others, so looking up all values that near in every index finds all of
them. Their whole codes are compared next, and those within the radius are ranked by the vectors.
How many substrings probe the fewest rows is learned with the radius.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stripchart.llm.common import stored, table
from stripchart.session import ship

#: Rows the rotations and the radius are learned from, at most: those with the least hash of id.
LEARNED = 8192
#: Codes are this many bits, in one of these numbers of substrings.
BITS = 128
SUBSTRINGS = (16, 8, 4, 2)
ITERATIONS = 10
#: The radius takes in this share of the true neighbours between rows of the sample.
WITHIN = 0.97
#: Rows of an index block at least, where there are more than BLOCKS of those at most; of a query
#: block at most.
BLOCK_ROWS, BLOCKS, LARGE_BLOCK, BLOCK_QUERIES = 8192, 64, 32768, 32768
NEIGHBOURS = 20


def valid(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the rows that take part: id not null, vector neither null, nor
    empty, nor zero, without null, infinite or NaN components, and as long as most vectors."""
    v = f"transform(`{embedding}`, x -> cast(x as double))"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.expr(v).alias("v")).where(
        "vec_id is not null and v is not null and exists(v, x -> x <> 0) and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (size[0]["n"] if size else 0))


class Codes:
    """Learned rotations: the mean is taken off, and each rotation of the vectors is fitted so
    that its signs lose little (alternating between signs and the best rotation onto them).
    Where lengths differ a component is added that makes them equal, so that the nearest by
    angle are those with the largest inner product; queries have 0 there. `lengths` are the
    shortest and the longest of all rows that will be coded, the sample's where it is all."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, seed: int = 7, lengths: tuple[float, float] | None = None):
        norms = np.linalg.norm(sample, axis=1)
        shortest, longest = (norms.min(), norms.max()) if lengths is None else lengths
        self.longest = float(longest * 1.05) if longest - shortest > 1e-3 * longest else 0.0
        x = self._extended(sample, False)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        rng = np.random.default_rng(seed)
        turned: list[np.ndarray] = []
        while sum(r.shape[1] for r in turned) < bits:
            rotation = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
            for _ in range(ITERATIONS):
                left, _, right = np.linalg.svd(x.T @ np.where(x @ rotation > 0, 1.0, -1.0))
                rotation = left @ right
            turned.append(rotation)
        self.rotation = np.concatenate(turned, axis=1)[:, :bits]
        self.radius, self.substrings = bits, SUBSTRINGS[-1]

    def _extended(self, x: np.ndarray, query: bool) -> np.ndarray:
        if not self.longest:
            return x
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return np.c_[x, rest]

    def __call__(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """One row of bytes per vector."""
        return np.packbits((self._extended(x, query) - self.mean) @ self.rotation > 0, axis=1)

    def learn_radius(self, sample: np.ndarray, k: int, within: float = WITHIN, queries: int = 400) -> None:
        found = []
        codes, asked = self(sample), self(sample[:queries], True)
        for i in range(min(queries, len(sample))):
            score = sample @ sample[i]
            score[i] = -np.inf
            near = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
            found.append(_distance(codes[near], asked[i]))
        far = np.concatenate(found) if found else np.zeros(0)
        self.radius = int(np.quantile(far, within, method="higher")) if len(far) else self.rotation.shape[1]
        share = {m: np.mean([probed(codes, code, m, self.radius).mean() for code in asked[:100]]) for m in SUBSTRINGS}
        self.substrings = min(share, key=share.get)


def _distance(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count((codes ^ code).view(np.uint64)).sum(axis=1, dtype=np.int64)


def _substrings(codes: np.ndarray, m: int) -> np.ndarray:
    return np.ascontiguousarray(codes).view(f"u{codes.shape[-1] // m}")


def radii(radius: int, m: int) -> list[int]:
    """Bits in which each substring may differ (-1: it need not be looked up), so that no code
    within the radius is missed."""
    near, more = divmod(radius, m)
    return [near if j <= more else near - 1 for j in range(m)]


def probed(codes: np.ndarray, code: np.ndarray, m: int, radius: int) -> np.ndarray:
    """Which codes the lookups for one code lead to."""
    apart = np.bitwise_count(_substrings(codes, m) ^ _substrings(code, m))
    return (apart.astype(int) <= np.array(radii(radius, m))).any(axis=1)


@functools.lru_cache(maxsize=64)
def _ball(bits: int, radius: int) -> np.ndarray:
    """All masks of so many bits with at most `radius` set."""
    return np.array([sum(1 << i for i in at) for n in range(radius + 1) for at in itertools.combinations(range(bits), n)], np.uint64)


class Index:
    """The substring indexes of one block of rows: of each, its distinct values in order and the
    rows that have them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, m: int = 16):
        self.ids, self.vectors, self.codes, self.m = ids, vectors, codes, m
        self.tables = []
        for column in _substrings(codes, m).T:
            values, rows, counts = np.unique(column, return_inverse=True, return_counts=True)
            self.tables.append((values, np.argsort(rows, kind="stable"), np.r_[0, np.cumsum(counts)]))

    def _lookup(self, j: int, value: np.unsignedinteger, radius: int) -> np.ndarray:
        """Positions of rows whose substring j differs in at most `radius` bits: its neighbours
        are looked up one by one, or where they are more than the values there are, those are
        gone through."""
        values, rows, starts = self.tables[j]
        bits = 8 * values.itemsize
        if sum(math.comb(bits, n) for n in range(radius + 1)) < len(values):
            wanted = _ball(bits, radius).astype(values.dtype) ^ value
            place = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
            hit = place[values[place] == wanted]
        else:
            hit = np.flatnonzero(np.bitwise_count(values ^ value) <= radius)
        size = starts[hit + 1] - starts[hit]
        return rows[np.repeat(starts[hit] - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all rows whose code differs from `code` in at most radius bits."""
        found = np.zeros(len(self.ids), bool)
        for j, (value, near) in enumerate(zip(_substrings(code, self.m), radii(radius, self.m))):
            if near >= 0:
                found[self._lookup(j, value, near)] = True
        near = np.flatnonzero(found)
        return near[_distance(self.codes[near], code) <= radius]

    def nearest(self, query_id: int, query: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k nearest found, ties to the smaller id. The radius is doubled
        until k rows are found or it holds every code."""
        while True:
            near = self.within(code, radius)
            near = near[self.ids[near] != query_id]
            if len(near) >= k or radius >= 8 * len(code):
                break
            radius = min(8 * len(code), 2 * radius + 1)
        scores = np.einsum("ij,j->i", self.vectors[near], query)
        if len(near) > 4 * k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            near, scores = near[scores >= least], scores[scores >= least]
        best = np.lexsort((self.ids[near], -scores))[:k]
        return self.ids[near[best]], scores[best]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def nearest(vectors: DataFrame, every: int = 20, k: int = NEIGHBOURS, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int | None = None, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k
    nearest by inner product among all other rows.

    Rows and queries are dealt by hash into blocks of a bounded size; every query block meets
    every index block once, and each meeting gives k rows a query at most. Rows that repeat an
    id are candidates each, but none has that id as its own neighbour; as a query an id is asked
    once, with the least of its vectors. Without rows that take part the result is empty.
    """
    spark = vectors.sparkSession
    rows = stored(valid(vectors, vec_id, embedding), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    schema = "query_id long, vec_id long, score double"
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(LEARNED).select("v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    learned = _matrix(sample["v"], sample.num_rows)
    length = F.sqrt(F.expr("aggregate(v, 0d, (s, x) -> s + x * x)"))
    codes = Codes(learned, lengths=tuple(rows.agg(F.min(length), F.max(length)).first()))
    codes.learn_radius(learned, k)
    shared = spark.sparkContext.broadcast(codes)
    count = rows.count()
    block_rows = block_rows or min(LARGE_BLOCK, max(BLOCK_ROWS, count // BLOCKS))
    index_blocks = -(-count // block_rows)
    query_blocks = -(-asked.count() // block_queries)
    # by their places in the stored table too, so that repeated rows are spread
    index = rows.withColumn("b", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(index_blocks)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(max(query_blocks, 1) - 1))))
    queries = asked.withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(max(query_blocks, 1))).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(index_blocks - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            code = shared.value
            base, ask = _matrix(left["v"], left.num_rows), _matrix(right["v"], right.num_rows)
            block = Index(left["vec_id"].to_numpy(), base, code(base), code.substrings)
            for query_id, query, own in zip(right["vec_id"].to_pylist(), ask, code(ask, True)):
                ids, scores = block.nearest(query_id, query, own, code.radius, k)
                out.append((np.full(len(ids), query_id, np.int64), ids, scores))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    ship(spark)
    found = index.groupBy("b", "c").cogroup(queries.groupBy("b", "c")).applyInArrow(meet, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every row of embeddings whose id is divisible by 20, among all
    other rows. Vectors that are null, empty, zero, of another length, or with null or
    non-finite components take no part, nor do null ids; repeated rows are candidates each; ties
    go to the smaller id; no rows give no rows; other columns are not looked at."""
    return nearest(table(spark, sf_dir, "embeddings"))
