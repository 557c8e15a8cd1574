"""Token-ID output in training order.

Every partition of the documents, in the order of doc_ids, is one stream of subword ids, each text followed by the end
id, cut into sequences of LENGTH ids; the last is filled up with end ids. A sequence's number (its partition, and its
place there) goes through a keyed Feistel permutation with cycle-walking: four rounds over the least even number of
bits that holds all numbers below DOMAIN, repeated while the image is none of them. Sequences are ordered by the
images, so a sequence's global slot is the rank of its image, and the numbers of sequences needn't be known beforehand: texts are
tokenised once, and what one job makes goes through one shuffle. Equal ranges of images (they are uniform, so ranges need no sampling)
are shards: range partitions write them by Spark's own committing text writer, each record LENGTH little-endian
16-bit ids and one closing newline byte, so record r of a shard begins at r times the fixed stride, and reading
resumes at any slot by seeking. The manifest's lines are written by the same job, beside the records.

Defined cases: null or empty text is a lone end id; rows that share a doc_id are texts of their own; null doc_ids stay
out of a sequence's list of doc_ids but not out of its ids; doc_id must be a whole number; columns beside doc_id and
text don't matter; an empty table gives an empty manifest and no shards.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import subwords
from .common import load, mix64, pieces, shared_dir, small_batches, text_hash, total_bytes

LENGTH, KEY = 1024, 0x5EED
#: Numbers to permute: up to a billion partitions of up to 2**32 sequences.
DOMAIN = 10**9 << 32
#: About so much text goes into a shard; a task writes several where there are more shards than shuffle partitions and tasks would be small.
SHARD_BYTES, TASK_BYTES = 16 << 20, 256 << 20


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A permutation of 0 ... n - 1 that hangs on the key, for each entry of x."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix64(np.uint64(key) + np.arange(1, 5, dtype=np.uint64))
    x = x.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def _sequences(batches, ranks, length: int):
    """(number in the partition, ids, doc_ids, own ids) for each sequence."""
    enc = subwords.encoder(ranks.value)
    ids, owners, number = np.zeros(0, np.uint16), [], 0  # owners: (doc_id, first id, end) in what is left
    for batch in batches:
        for piece in pieces(batch, "text"):
            new, sizes = subwords.encode_texts(enc, piece.column("text"))
            ends = len(ids) + np.cumsum(sizes)
            owners += list(zip(piece.column("doc_id").to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True))
            ids = np.concatenate([ids, new])
            full, at = len(ids) // length, 0
            for s in range(full):
                begin, end, docs = s * length, (s + 1) * length, []
                while at < len(owners) and owners[at][1] < end:
                    docs.append(owners[at][0])
                    if owners[at][2] > end:
                        break
                    at += 1
                yield number, ids[begin:end], docs, length
                number += 1
            ids = ids[full * length :]
            owners = [(d, b - full * length, e - full * length) for d, b, e in owners[at:]]
    if len(ids):
        yield number, np.concatenate([ids, np.full(length - len(ids), subwords.END, np.uint16)]), [d for d, _, _ in owners], len(ids)


def _listed(docs: list) -> list:
    return list(dict.fromkeys(d for d in docs if d is not None))


ROW = pa.schema([("shard", pa.int32()), ("place", pa.int64()), ("about", pa.string()), ("record", pa.binary())])


def _rows(batches, ranks, length: int, shards: int, key: int, at_once: int = 1024):
    """The sequences with their shard, their place in order and a line for the manifest."""
    part, width, rows = TaskContext.get().partitionId(), -(-DOMAIN // shards), []

    def batch():
        places = feistel((part << 32) + np.array([n for n, _, _ in rows], np.int64), DOMAIN, key)
        return pa.RecordBatch.from_arrays([pa.array((places // width).astype(np.int32)), pa.array(places), pa.array([a for _, a, _ in rows]), pa.array([r for _, _, r in rows], pa.binary())], schema=ROW)

    for number, ids, docs, own in _sequences(batches, ranks, length):
        record = ids.astype("<u2").tobytes()
        rows.append((number, f"{own}\t{zlib.crc32(record)}\t{','.join(map(str, _listed(docs)))}", record))
        if len(rows) == at_once:
            yield batch()
            rows = []
    if rows:
        yield batch()


def write_shards(docs: DataFrame, path: str | None = None, ranks_path: str = subwords.RANKS, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Writes the shards below path (a new shared folder by default). Returns the manifest and the folder of the shards, shard=0 and so on.

    Manifest: slot, shard, byte_offset in the shard's file, doc_ids, n_tokens without filling, crc32 of the record's ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(subwords.ranks_of(ranks_path))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path = path or shared_dir(spark) + "-shards"
    if texts.isEmpty():
        return spark.createDataFrame([], "slot long, shard int, byte_offset long, doc_ids array<long>, n_tokens int, crc long"), path
    size = total_bytes(texts)
    shards = max(1, -(-size // shard_bytes))
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES))
    # in a fixed order, so that a task that runs again makes the same sequences
    fixed = texts.sortWithinPartitions("doc_id", text_hash())
    rows = fixed.mapInArrow(partial(_rows, ranks=ranks, length=length, shards=shards, key=key), "shard int, place long, about string, record binary")
    dealt = rows.repartitionById(tasks, F.floor(F.col("shard").cast("long") * tasks / shards).cast("int"))
    line = lambda manifest, value: F.struct(F.lit(manifest).alias("manifest"), value.alias("value"))
    about = F.concat_ws("\t", F.col("place").cast("string"), F.col("about"))
    lines = dealt.select("shard", "place", F.inline(F.array(line(False, F.col("record").cast("string")), line(True, about)))).sortWithinPartitions("manifest", "shard", "place")
    lines.select("manifest", "shard", "value").write.partitionBy("manifest", "shard").option("lineSep", "\n").text(path)
    cell = F.split("value", "\t", -1)
    known = spark.read.schema("value string, shard int").text(f"{path}/manifest=true").select("shard", *(cell[i].cast("long").alias(n) for i, n in enumerate(("place", "n_tokens", "crc"))), cell[3].alias("ids"))
    # the slots before each shard, from one row for each shard
    before = known.groupBy("shard").agg(F.count("*").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    record = F.row_number().over(Window.partitionBy("shard").orderBy("place")) - 1
    ids = F.transform(F.filter(F.split("ids", ","), lambda i: i != ""), lambda i: i.cast("long"))
    manifest = known.withColumn("record", record).join(before, "shard")
    return manifest.select((F.col("before") + F.col("record")).alias("slot"), "shard", (F.col("record").cast("long") * (2 * length + 1)).alias("byte_offset"), ids.alias("doc_ids"), F.col("n_tokens").cast("int").alias("n_tokens"), "crc"), f"{path}/manifest=false"


def read_records(data: bytes, length: int = LENGTH, first: int = 0) -> np.ndarray:
    """The ids of a shard's records from record first on, a row each."""
    stride = 2 * length + 1
    return np.frombuffer(data, np.dtype([("ids", "<u2", length), ("end", "u1")]), offset=first * stride)["ids"]


def query(spark, sf_dir: str) -> DataFrame:
    return write_shards(load(spark, sf_dir, "documents"))[0]
