"""Hard negatives by segment summaries.

Vectors are cut into segments; of each segment a row's summary stores the mean and the deviation (the length of what is
left when the mean is taken away). By the inequality of Cauchy and Schwarz the inner product of two rows' segments is the
product of their means times the segment's length, plus or minus at most the product of their deviations; the sum over
segments bounds a score. A Summary has this for halves of halves of the vector; a pair is refined from coarse
segments to fine ones only while its bounds leave its place open, and only what is left after the finest is scored exactly.

Two passes over blocks of rows (by a hash of the id) and blocks of anchors, each meeting of which is one task:

* positives: the best POSITIVES rows of the anchor's label. A pair goes when its upper bound is below the least of the
  best lower bounds.
* negatives: the best of the other labels inside each positive's window of scores. A pair goes when no window can hold
  it, or when enough others that surely lie in the window surely score higher.

The best of every meeting are merged by a window over the anchor, and a meeting sends a few rows for each anchor, so ties and copies
don't gather. The anchors are a stated set against all rows; nothing is sent for a pair. Rows are copied once for each ANCHOR_BLOCK anchors.

Defined cases: a row with a null id, label or vector, or any null or non-finite component, takes no part; components
become floor(256 x), held within +-2**24, so that scores of up to 2**15 components are exact; only vectors of equal length meet
(empty ones score 0); a row is no partner of a row with its own id; rows that repeat an id are else rows of their own, as positives too,
but equal anchors count once; an anchor without positives, or a positive without negatives, gives no rows; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, small_batches, written

POSITIVES, NEGATIVES = 5, 3
BLOCK, ANCHOR_BLOCK = 8_192, 16_384
#: Lengths of segments, from coarse to fine.
SEGMENTS = (16, 8, 4, 2)
#: Bounds are refined and pairs scored for so many pairs at a time.
CELLS = 1 << 19
#: Where more than one in so many of the pairs is open, all are computed, as one product of matrices.
DENSE = 32
LIMIT = 1 << 24


class Summary:
    """For each segment length the means and deviations of all rows, times the root of the length, so that a product of two rows' entries is a bound's part."""

    def __init__(self, x: np.ndarray):
        self.x, self.levels = x, []
        for size in SEGMENTS:
            starts = np.arange(0, x.shape[1], size)
            lengths = np.diff(np.append(starts, x.shape[1]))
            mean = np.add.reduceat(x, starts, 1) / lengths if len(starts) else np.zeros((len(x), 0))
            rest = x - np.repeat(mean, lengths, 1)
            deviation = np.sqrt(np.add.reduceat(rest * rest, starts, 1)) if len(starts) else np.zeros((len(x), 0))
            self.levels.append((mean * np.sqrt(lengths), deviation))
        self.norm = np.sqrt((x * x).sum(1))

    def take(self, which) -> Summary:
        out = object.__new__(Summary)
        out.x, out.norm, out.levels = self.x[which], self.norm[which], [(m[which], d[which]) for m, d in self.levels]
        return out


def bounds(a: Summary, b: Summary, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest that a's scores with b can be, rounding allowed for."""
    (ma, da), (mb, db) = a.levels[level], b.levels[level]
    middle, spread = ma @ mb.T, da @ db.T
    spread += 1e-9 * np.outer(a.norm, b.norm) + 1e-6
    return middle - spread, middle + spread


def pair_bounds(a: Summary, b: Summary, i: np.ndarray, j: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for listed pairs."""
    (ma, da), (mb, db) = a.levels[level], b.levels[level]
    middle, spread = np.einsum("ij,ij->i", ma[i], mb[j]), np.einsum("ij,ij->i", da[i], db[j])
    spread += 1e-9 * a.norm[i] * b.norm[j] + 1e-6
    return middle - spread, middle + spread


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner products of listed pairs: in floating point where every sum is below 2**53, else in whole numbers."""
    if not len(i):
        return np.zeros(0, np.int64)
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        if DENSE * len(i) > len(a) * len(b):
            return (a @ b.T)[i, j].astype(np.int64)
        return np.concatenate([np.einsum("ij,ij->i", a[i[k : k + CELLS // 8]], b[j[k : k + CELLS // 8]]) for k in range(0, len(i), CELLS // 8)]).astype(np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    return np.concatenate([(a[i[k : k + CELLS // 8]] * b[j[k : k + CELLS // 8]]).sum(1) for k in range(0, len(i), CELLS // 8)])


def kth_best(owner: np.ndarray, value: np.ndarray, groups: int, k: int) -> np.ndarray:
    """The k-th largest value of each owner, minus infinity where it has fewer."""
    if (owner[1:] < owner[:-1]).any():
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
    counts = np.bincount(owner, minlength=groups)
    each = np.full((groups, max(k, counts.max(initial=0))), -np.inf)
    each[owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]] = value
    return np.partition(each, each.shape[1] - k, axis=1)[:, -k]


def survivors(a: Summary, b: Summary, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that may be among the k best of i within one of its windows low[i, w] to high[i, w], from coarse bounds to fine ones."""
    i, j = np.nonzero(allowed)
    for level in range(len(SEGMENTS)):
        if not len(i):
            break
        if DENSE * len(i) > allowed.size:
            below, above = bounds(a, b, level)
            below, above = below[i, j], above[i, j]
        else:
            below, above = pair_bounds(a, b, i, j, level)
        open_, counts = np.zeros(len(i), bool), np.bincount(i, minlength=len(low))
        for w in range(low.shape[1]):
            fits = below <= np.repeat(high[:, w], counts)  # i ascends
            sure = np.flatnonzero((below >= np.repeat(low[:, w], counts)) & (above <= np.repeat(high[:, w], counts)))
            enough = np.maximum(low[:, w], kth_best(i[sure], below[sure], len(low), k))
            open_ |= (above >= np.repeat(enough, counts)) & fits
        i, j = i[open_], j[open_]
    return i, j


def best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their owner, ties by the smaller id."""
    if not len(owner):
        return np.zeros(0, np.int64)
    few = np.flatnonzero(score.astype(np.float64) >= kth_best(owner, score.astype(np.float64), owner.max() + 1, k)[owner])
    order = few[np.lexsort((ids[few], -score[few], owner[few]))]
    place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    return order[place < k]


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table[column].combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


MET = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
MET_DDL = "anchor long, place int, vec_id long, score long"


def _meet(rows: pa.Table, asked: pa.Table, k: int, same: bool) -> pa.Table:
    """The best of a block of rows for each of a block of anchors; asked's windows are lists of low and high, one for each place."""
    if not rows.num_rows or not asked.num_rows:
        return MET.empty_table()
    ids, labels, all_b = rows["id"].to_numpy(), rows["label"].to_numpy(), Summary(_matrix(rows, "vec"))
    all_a, keys, aids, alabels = Summary(_matrix(asked, "vec")), asked["anchor"].to_numpy(), asked["id"].to_numpy(), asked["label"].to_numpy()
    windows, out = asked["windows"].to_pylist(), []
    at_once = max(1, CELLS // len(ids))
    for at in range(0, len(keys), at_once):
        chunk = slice(at, at + at_once)
        a, most = all_a.take(chunk), max(len(w) for w in windows[chunk])
        low, high = np.full((len(a.x), most), np.inf), np.full((len(a.x), most), -np.inf)
        for r, w in enumerate(windows[chunk]):
            low[r, : len(w)], high[r, : len(w)] = [x["low"] for x in w], [x["high"] for x in w]
        alike = alabels[chunk][:, None] == labels[None, :]
        i, j = survivors(a, all_b, (alike if same else ~alike) & (aids[chunk][:, None] != ids[None, :]), low, high, k)
        score = exact(a.x, all_b.x, i, j)
        for w in range(most):
            fits = np.flatnonzero((score >= low[i, w]) & (score <= high[i, w]))
            fits = fits[best(i[fits], score[fits], ids[j[fits]], k)]
            out.append((keys[chunk][i[fits]], np.full(len(fits), w + 1), ids[j[fits]], score[fits]))
    return pa.table([pa.array(np.concatenate(c).astype(t.type.to_pandas_dtype())) for c, t in zip(zip(*out, strict=True), MET, strict=True)], schema=MET)


def sound(df: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(id, label, vec of whole numbers) of the rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    known = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & fine)
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * 256, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return known.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("vec"))


def _met(rows: DataFrame, asked: DataFrame, blocks: int, parts: int, k: int, same: bool) -> DataFrame:
    """(anchor, place, vec_id, score): the k best for each place of each anchor."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = [F.size("vec").alias("dim"), "block", "part"]
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    asked = asked.withColumn("block", every(blocks)).withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int"))
    met = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(lambda a, b: _meet(a, b, k, same), MET_DDL)
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), F.col("vec_id"))
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, relabel: Column | None = None, share: tuple[int, int] = (50, 95), positives: int = POSITIVES, negatives: int = NEGATIVES, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors: which rows are. relabel: the label to use, from the columns id and label. share: negatives score from so
    many to so many hundredths of the positive.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    label = F.col("label") if relabel is None else relabel
    rows, chosen = (sound(df, id_col, label_col, vec_col).withColumn("label", label) for df in (vectors, vectors.where(anchors)))
    # the numbers of anchors are written, so that they stay
    chosen = written(chosen.dropDuplicates(["id", "label", "vec"]).withColumn("anchor", F.monotonically_increasing_id()))
    blocks, parts = max(1, math.ceil(rows.count() / BLOCK)), max(1, math.ceil(chosen.count() / ANCHOR_BLOCK))
    window = "array<struct<low:double,high:double>>"
    everything = F.array(F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))).cast(window)
    first = _met(rows, chosen.withColumn("windows", everything), blocks, parts, positives, True)
    first = written(first.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score")
    # 100 n from 50 p to 95 p, for whole n
    low, high = F.ceil(F.lit(share[0]) * score.cast("decimal(38,0)") / 100), F.floor(F.lit(share[1]) * score.cast("decimal(38,0)") / 100)
    ranges = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", low.cast("double").alias("low"), high.cast("double").alias("high")))).alias("windows"))
    asked = chosen.join(ranges.withColumn("windows", F.transform("windows", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).cast(window)), "anchor")
    second = _met(rows, asked, blocks, parts, negatives, False).select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = second.join(first, ["anchor", "place"]).join(chosen.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    relabel = F.when(F.col("id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, relabel)


ORACLE = """WITH sound AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM sound a JOIN sound b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""
