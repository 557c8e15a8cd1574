"""Approximate nearest neighbours by multi-index hashing.

Codes are the signs of the vectors after a learned rotation: principal axes of a bounded sample, then rotations that
bring the sample closest to its own signs (iterative quantisation). A code of BITS bits is split into CHUNKS
substrings, each with an index from its value to the rows that have it. If two codes differ in at most RADIUS bits,
one of their substrings differs in at most RADIUS div CHUNKS bits, so probing the values that near in every substring
finds all codes within RADIUS; those are ranked by exact inner products of the original vectors.

Rows are dealt into blocks of bounded size by a hash of the id, each with its own index, and the stated queries, in
blocks too, visit every block; each meeting yields the k best of the block, and the best k of those are the answer. A
vector that thousands of rows share is spread like any others. A block with fewer than k codes within RADIUS widens
the radius for this query until it has k or all rows.

Vectors of different lengths can't be compared: a query meets the rows of its own length, and each length has a rotation
of its own, learned from its part of the sample, or from a block's rows where the sample has none.

Defined cases: vectors that are null, empty, zero, or hold null, NaN or infinite components take no part; a null id takes no part; rows that share an id are separate candidates but never
the query's own; fewer than k candidates give all of them; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, sampled, small_batches

BITS, CHUNKS, RADIUS = 64, 8, 31
#: Rows of the sample that the rotation is learned from.
SAMPLE = 10_000
BLOCK, QUERY_BLOCK = 16_384, 4_096


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = 25, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): codes are the signs of (x - mean) @ axes."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    mean = sample.mean(0)
    x = sample - mean
    _, _, axes = np.linalg.svd(np.vstack([x, np.zeros((max(0, dim - len(x)), dim))]), full_matrices=False)
    out = []
    for at in range(0, bits, dim):  # more bits than dimensions: further rotations of the same axes
        width = min(dim, bits - at)
        y = x @ axes[:width].T
        r = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(y @ r > 0, 1.0, -1.0).T @ y)
            r = (u @ v).T
        out.append(axes[:width].T @ r)
    return mean, np.hstack(out)


def codes_of(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """A row of bytes for each vector; each byte is a substring of 8 bits."""
    return np.packbits((x - mean) @ axes > 0, axis=1)


def _ball(radius: int) -> np.ndarray:
    """All bytes with at most radius bits."""
    every = np.arange(256, dtype=np.uint8)
    return every[np.bitwise_count(every) <= radius]


class ChunkIndex:
    """For each substring, the rows in order of its value and where each value begins."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in codes.T]
        self.begin = [np.searchsorted(c[o], np.arange(257)) for c, o in zip(codes.T, self.order, strict=True)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose codes differ from code in at most radius bits."""
        seen = np.zeros(len(self.codes), bool)
        ball = _ball(min(8, radius // len(self.order)))
        for c, order, begin in zip(code, self.order, self.begin, strict=True):
            for value in (ball ^ c).tolist():
                seen[order[begin[value] : begin[value + 1]]] = True
        near = np.flatnonzero(seen)
        return near[np.bitwise_count(self.codes[near] ^ code).sum(1, dtype=np.int64) <= radius]


def _vectors(table: pa.Table) -> np.ndarray:
    flat = table["vec"].combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def _meet(rows: pa.Table, asked: pa.Table, rotations: dict, k: int, radius: int) -> pa.Table:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not rows.num_rows or not asked.num_rows:
        return schema.empty_table()
    ids, x, qids, q = rows["id"].to_numpy(), _vectors(rows), asked["id"].to_numpy(), _vectors(asked)
    mean, axes = rotations.get(x.shape[1]) or learn_rotation(x[np.lexsort((x[:, 0], ids))[:SAMPLE]])
    index, codes = ChunkIndex(codes_of(x, mean, axes)), codes_of(q, mean, axes)
    bits, out = codes.shape[1] * 8, []
    for qid, code, v in zip(qids, codes, q, strict=True):
        r = radius
        while True:
            near = index.within(code, r)
            near = near[ids[near] != qid]
            if len(near) >= k or r >= bits:
                break
            r += max(4, radius // 4)
        score = np.einsum("ij,j->i", x[near], v)
        if len(near) > 4 * k:  # all that reach the k-th best score, ties too
            enough = score >= np.partition(score, len(score) - k)[len(score) - k]
            near, score = near[enough], score[enough]
        best = np.lexsort((ids[near], -score))[:k]
        out.append((np.full(len(best), qid), ids[near[best]], score[best]))
    return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=schema)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, radius: int = RADIUS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k rows of vectors found with the largest inner product, its own id's aside."""
    spark = vectors.sparkSession
    small_batches(spark)

    def sound(df: DataFrame) -> DataFrame:
        v = F.col("vec")
        fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & fine)

    rows, asked = sound(vectors), sound(queries)
    by_length: dict[int, list] = {}
    for r in sampled(rows, SAMPLE, "id", "vec"):
        by_length.setdefault(len(r["vec"]), []).append(r["vec"])
    rotations = {n: learn_rotation(np.array(v, np.float64)) for n, v in by_length.items()}
    blocks, parts = max(1, math.ceil(rows.count() / BLOCK)), max(1, math.ceil(asked.count() / QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.select("id", "vec", block(blocks).alias("block"), every(parts).alias("part"))
    asked = asked.select("id", "vec", every(blocks).alias("block"), block(parts).alias("part"))
    keys = [F.size("vec").alias("length"), "block", "part"]
    met = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(lambda a, b: _meet(a, b, rotations, k, radius), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
