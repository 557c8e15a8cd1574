"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, where only ASCII white space separates words.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share; where that is unset, a local one, in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's default of 10,000, since rows are whole texts; a setting of the user's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def broadcast_up_to(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Broadcasts df if its counted rows are at most limit; otherwise Spark joins it by a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def likely(rows: DataFrame, key: str, ids: DataFrame, column: str, buckets: int = 4096) -> DataFrame:
    """The rows whose key is among ids.column and a few others, without a shuffle of rows.

    Hashes of the ids set bits in at most buckets bitmaps of 4 KB, which are broadcast (16 MB, whatever the number of ids); rows whose
    bit isn't set are dropped where they are read. With far more ids than bits most rows stay. A join then leaves the others out.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets * 32768))
    bit = place(F.col(column)).alias("_bit")
    maps = ids.select(bit).groupBy(F.floor(F.col("_bit") / 32768).alias("_bucket")).agg(F.bitmap_construct_agg(F.col("_bit") % 32768).alias("_map"))
    at = place(F.col(key))
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.floor(at % 32768 / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return rows.join(F.broadcast(maps), F.floor(at / 32768) == F.col("_bucket")).where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_bucket", "_map")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. lower() agrees on pure ASCII and is faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def text_hash(column: str = "text") -> Column:
    """Tells rows apart that share a doc_id but not a text."""
    return F.hash(F.col(column))


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def sampled(df: DataFrame, n: int, *keys: str) -> list:
    """The n rows with the least hash of their keys, in order of it; few more rows than those reach the driver, whatever the number of partitions."""
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    least = hashed.select("_hash").orderBy("_hash").limit(n).agg(F.max("_hash")).first()[0]
    if least is None:
        return []
    rows = hashed.where(F.col("_hash") <= least).limit(n).collect()
    return sorted(rows, key=lambda r: (r["_hash"], repr(r)))


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """Each row as one struct _row beside further columns, so that no column of docs can clash with an operator's own."""
    return docs.select(F.struct("*").alias("_row"), *(c.alias(n) for n, c in more.items()))


def unpacked(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs again, some of them replaced."""
    return df.select(*(new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns))


def with_block(docs: DataFrame, blocks: int, *keys: str) -> DataFrame:
    """Deals rows evenly into blocks by a hash of their keys; block sizes don't depend on how often a text occurs."""
    return docs.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))


# --- words of a batch of texts, in numpy ---------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MULT = np.random.default_rng(20240229).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: none), and where each text starts, with the end as a last entry."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of its first word (with the total as a last entry)."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = True
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with A-Z as a-z if fold is set: a sum of byte times a random odd factor of its place, mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.zeros(len(starts), np.uint64)
    lens = ends - starts
    data = _FOLD[data] if fold else data
    for k in range(int(min(lens.max(), 24))):  # column by column: most words are short
        live = np.flatnonzero(lens > k) if k else slice(None)
        out[live] += (data[starts[live] + k].astype(np.uint64) + np.uint64(1)) * _MULT[k]
    for i in np.flatnonzero(lens > 24):
        rest = data[starts[i] + 24 : ends[i]].astype(np.uint64) + np.uint64(1)
        if len(rest) > len(_MULT) - 24:  # very long words: fold pieces one after another
            for at in range(0, len(rest), 2048):
                piece = rest[at : at + 2048]
                out[i : i + 1] = mix64(out[i : i + 1] + (piece * _MULT[24 : 24 + len(piece)]).sum(dtype=np.uint64))
        else:
            out[i : i + 1] += (rest * _MULT[24 : 24 + len(rest)]).sum(dtype=np.uint64)
    return mix64(out + lens.astype(np.uint64))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries, in order; len(h) - k + 1 of them. Runs over text borders are the caller's to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + n]
    return mix64(out)


def give_back() -> None:
    """Hands memory that a finished task no longer needs to the system; workers live on and would hold the most that any task had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(table: pa.Table | pa.RecordBatch, column: str, most_bytes: int = 4 << 20):
    """Slices of the table with at most so many bytes of text each (one row at least), so that numpy's arrays stay small."""
    sizes = np.diff(text_bytes(table.column(column))[1])
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > most_bytes and i > begin:
            yield table.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < len(sizes):
        yield table.slice(begin)
