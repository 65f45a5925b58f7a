"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after rotations learned on a bounded sample (iterative quantization, started
anew for each 64 bits). A code is split into substrings of 16 bits and each block of the data indexes its codes by
every substring. Two codes within ``radius`` are near in some of the m substrings (``shares``), so probing all values
that near in each retrieves every code within the radius; a full Hamming test and the exact distance on the floats
follow. The radius is learned too: it holds most true neighbours of a sample. Where neighbours are near, it is small
and few rows are retrieved; where they are hardly nearer than other vectors, probing prunes little.

Queries meet the data in blocks. Equal vectors are one class: of a class only so many of the smallest ids as a
query can return take part, which changes no result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

TOP = 10
#: Bits of a code, of a substring; vectors to learn from; rounds of quantization.
BITS, SUB, SAMPLE, ROUNDS = 128, 16, 4096, 25
#: Share of a sample's true neighbours within the radius. In the whole, neighbours are nearer than in a sample.
COVER = 0.97
#: Rows of a block of the data and of the queries, at most; of the data at least, where there are more cores than blocks.
DATA_BLOCK, QUERY_BLOCK, LEAST_BLOCK = 1 << 16, 1 << 13, 1 << 12


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id, vec: rows with an id whose vector is there, not zero, and has finite components only."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter("vec_id is not null and vec is not null").filter(finite & F.exists("vec", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


class Codes:
    """Learned binary codes: a centre and a rotation for each 64 bits, and the radius to search."""

    def __init__(self, sample: np.ndarray, top: int = TOP):
        self.dim = sample.shape[1]
        self.centre = sample.mean(axis=0)
        x = sample - self.centre
        draw = np.random.default_rng(3)
        turns = []
        for at in range(0, BITS, self.dim):
            width = min(self.dim, BITS - at)
            r = np.linalg.qr(draw.normal(size=(self.dim, self.dim)))[0][:, :width]
            for _ in range(ROUNDS):  # iterative quantization: the rotation that brings vectors closest to their signs
                u, _, w = np.linalg.svd(x.T @ np.sign(x @ r), full_matrices=False)
                r = u @ w
            turns.append(r)
        self.turn = np.concatenate(turns, axis=1)
        self.radius = BITS
        if len(sample) > top + 1:
            some = sample[: min(256, len(sample))]
            far = ((some[:, None, :] - sample[None, :, :]) ** 2).sum(axis=2) if len(sample) < 512 else np.add.outer((some**2).sum(1), (sample**2).sum(1)) - 2 * some @ sample.T
            far[np.arange(len(some)), np.arange(len(some))] = np.inf
            near = np.argpartition(far, top, axis=1)[:, :top]
            codes = self.encode(sample)
            apart = np.bitwise_count(codes[: len(some), None, :] ^ codes[near]).sum(axis=2)
            self.radius = int(np.quantile(apart, COVER))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(n, BITS / SUB) substrings of the codes."""
        bits = (x - self.centre) @ self.turn > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u2").astype(np.uint16)


def shares(radius: int, parts: int) -> list[int]:
    """How near each substring is probed. With radius = parts * a + b, two codes within it differ in a bits at most
    of one of the first b + 1 substrings, or in a - 1 of one of the others: else they differed in more than radius."""
    a, b = divmod(radius, parts)
    return [a if k <= b else a - 1 for k in range(parts)]


class Index:
    """Of a block's codes, for each substring: the values that occur, and the rows of each."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows = [np.argsort(column, kind="stable") for column in codes.T]
        self.values, self.begin = [], []
        for column, rows in zip(codes.T, self.rows, strict=True):
            values, begin = np.unique(column[rows], return_index=True)
            self.values.append(values)
            self.begin.append(np.append(begin, len(rows)))

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of which some substring is as near as its share of the radius: all within it, by the pigeonhole.

        Of the values so near those are looked up that occur: by a search for each, or if fewer occur than are
        so near, by a test of each that occurs.
        """
        hit = np.zeros(len(self.codes), dtype=bool)
        for k, most in enumerate(shares(radius, self.codes.shape[1])):
            if most < 0:
                continue
            values, begin = self.values[k], self.begin[k]
            flips = near_values(most)
            if len(flips) < len(values):
                at = np.searchsorted(values, flips ^ code[k])
                at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == (flips ^ code[k]))]
            else:
                at = np.flatnonzero(np.bitwise_count(values ^ code[k]) <= most)
            count = begin[at + 1] - begin[at]
            ends = np.cumsum(count)
            hit[self.rows[k][np.repeat(begin[at] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]] = True
        return np.flatnonzero(hit)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from ``code`` in at most ``radius`` bits."""
        rows = self.probe(code, radius)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


@cache
def near_values(most: int) -> np.ndarray:
    """Substrings with at most so many bits set."""
    every = np.arange(1 << SUB, dtype=np.uint16)
    return every[np.bitwise_count(every) <= most]


def _search(codes: Codes, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, top: int, radius: int) -> tuple[list, list, list]:
    """The ``top`` nearest found in one block for each query: exact distances, ties to the smaller id."""
    index, wanted = Index(codes.encode(x)), codes.encode(q)
    single = len(np.unique(ids)) == len(ids)
    out: tuple[list, list, list] = ([], [], [])
    for i, q_id in enumerate(q_ids):
        rows = index.within(wanted[i], radius) if radius < BITS else np.arange(len(x))
        rows = rows[ids[rows] != q_id]
        far = np.sqrt(((x[rows] - q[i]) ** 2).sum(axis=1))
        if single and len(rows) > top:
            edge = np.partition(far, top - 1)[top - 1]
            rows, far = rows[far <= edge], far[far <= edge]
        order = np.lexsort((ids[rows], far))
        if not single:  # of an id that repeats the nearest vector counts
            order = order[np.sort(np.unique(ids[rows[order]], return_index=True)[1])]
        order = order[:top]
        out[0].extend([q_id] * len(order))
        out[1].extend(ids[rows[order]])
        out[2].extend(far[order])
    return out


def _meet(data: DataFrame, queries: DataFrame, codes: Codes, radius: int, n_data: int, n_queries: int, top: int) -> DataFrame:
    """query_id, vec_id, score: each query's nearest of every block of the data, from blocks met with blocks."""
    cores = data.sparkSession.sparkContext.defaultParallelism
    data_blocks, query_blocks = max(-(-n_data // DATA_BLOCK), min(cores, -(-n_data // LEAST_BLOCK))), -(-n_queries // QUERY_BLOCK)
    shared = data.sparkSession.sparkContext.broadcast(codes)
    d = data.withColumn("d", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, data_blocks)))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(max(0, query_blocks - 1)))))
    q = queries.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, query_blocks))).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(max(0, data_blocks - 1)))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, q_ids = left.column("vec_id").to_numpy(), right.column("q_id").to_numpy()
        found: tuple[list, list, list] = ([], [], [])
        if len(ids) and len(q_ids):
            x, y = matrix(left.column("vec")), matrix(right.column("q_vec"))
            found = _search(shared.value, q_ids, y, ids, x, top, radius)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    d = d.select("vec_id", "vec", F.col("d").cast("int").alias("d"), F.col("q").cast("int").alias("q"))
    q = q.select(F.col("vec_id").alias("q_id"), F.col("vec").alias("q_vec"), F.col("d").cast("int").alias("qd"), F.col("q").cast("int").alias("qq"))
    return d.groupBy("d", "q").cogroup(q.groupBy("qd", "qq")).applyInArrow(run, "query_id long, vec_id long, score double")


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def nearest(embeddings: DataFrame, every: int = 100, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by ``every``, its ``top`` nearest.

    score is the Euclidean distance in double precision. Vectors that are null, zero, or hold null or infinite
    components take no part, nor do rows without vec_id; nor, if lengths differ, vectors of another length than
    most have, as they have no distance. A vec_id that repeats is one candidate and one query, at the least distance
    of its vectors. A query with fewer than ``top`` found in the radius is searched again over all blocks without
    one. An empty table gives an empty result; other columns are ignored.
    """
    rows = valid(embeddings).dropDuplicates(["vec_id", "vec"])
    lengths = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 1
    rows = settle(rows.filter(F.size("vec") == dim))
    # of equal vectors only the smallest ids can be among the nearest: one more than asked for, the query's own
    alike = Window.partitionBy("vec").orderBy("vec_id")
    data = settle(rows.withColumn("k", F.row_number().over(alike)).filter(F.col("k") <= top + 1).drop("k"))
    queries = rows.filter(F.col("vec_id") % every == 0)
    n_data, n_queries = data.count(), queries.count()
    learned = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if not n_data or not n_queries:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = Codes(matrix(learned.column("vec")), top)
    first = settle(_best(_meet(data, queries, codes, codes.radius, n_data, n_queries, top), top))
    n_ids = data.select("vec_id").distinct().count()
    short = queries.join(first.filter(F.col("rank") == min(top, n_ids - 1)).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    n_short = short.count()
    if n_short:
        again = _best(_meet(data, short, codes, BITS, n_data, n_short, top), top)
        first = first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
