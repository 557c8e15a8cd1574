"""Quality classifier: nearest-neighbour voting in a latent semantic space.

A document is a bag of hashed features: its words, character trigrams at word starts, and marks of form (share of
capitals, signs, digits and repeats, lengths, each in steps). Counts are damped, weighted by inverse document
frequency and projected on the leading singular vectors of a bounded labelled sample. The sample's vectors, at most
SAMPLE rows of RANK numbers, are broadcast; every document's cosines with all of them are exact products in blocks,
and the NEIGHBOURS most similar labels vote with weight max(cosine, 0) to the power SHARP.

Defined cases: null or blank text is the bag with only its marks of form, and is scored like any other; null labels
and labels of unknown documents are not learned from; with one label only, the score is that label; with none, 0.5;
rows that share a doc_id are separate, and each labelled one is learned; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, load, mix64, pieces, sampled, small_batches, text_bytes, word_hashes, word_spans

WIDTH, RANK, NEIGHBOURS, SHARP = 4096, 48, 15, 4
#: Labelled rows that are learned from, at most, and as many of each label as can be.
SAMPLE = 3_000
THRESHOLD = 0.7
MARKS = 24  # steps of a mark


def _marks(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Form of each text as numbers from 0 to 1: a column each."""
    n = len(first) - 1
    size = np.maximum(np.diff(offsets), 1)
    share = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offsets]) / size
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    sign = (data > 32) & (data < 127) & ~upper & ~digit & ~((data >= 97) & (data <= 122)) & (data != 46) & (data != 44)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    at = np.maximum(count, 1)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((words, doc))
    w, d = words[order], doc[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=n) / at
    per_text = lambda flag: np.bincount(doc, weights=flag, minlength=n) / at
    length = ends - starts
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    odd_end = (last < 128) & ~((last >= 97) & (last <= 122)) & (last != 46) & (last != 44)
    lines = share(data == 10) * size + 1
    return np.column_stack([
        np.minimum(1, 4 * share(upper)), np.minimum(1, 4 * share(digit)), np.minimum(1, 4 * share(sign)), per_text(again), distinct ** np.minimum(1, 6 / np.log2(at + 2)),
        np.minimum(1, per_text(length) / 16), np.minimum(1, per_text(length == 1) * 2), per_text(odd_end), np.minimum(1, np.log2(at + 1) / 16), np.minimum(1, lines / at), np.minimum(1, per_text(length > 20) * 4),
    ])


def features(texts: pa.Array) -> np.ndarray:
    """Damped counts of hashed features, a row for each text, with the marks of form in the last columns."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, fold=False)
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    head = word_hashes(data, starts, np.minimum(ends, starts + 3), fold=True)
    cells = n * WIDTH
    x = np.zeros(cells, np.float32)
    for h, weight in ((words, 1.0), (mix64(head + np.uint64(1)), 0.5)):
        x += (weight * np.bincount(doc * WIDTH + (h % np.uint64(WIDTH)).astype(np.int64), minlength=cells)).astype(np.float32)
    x = np.log1p(x.reshape(n, WIDTH))
    marks = _marks(data, offsets, starts, ends, first, words)
    # a mark is two neighbouring steps of a ladder, so near values have near features
    ladder = np.zeros((n, marks.shape[1], MARKS + 1), np.float32)
    place = np.clip(marks, 0, 1) * (MARKS - 1)
    low = place.astype(np.int64)
    rows, cols = np.indices(low.shape)
    ladder[rows, cols, low] = 1 - (place - low)
    ladder[rows, cols, low + 1] = place - low
    return np.hstack([x, ladder.reshape(n, -1)])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Words and marks as two parts of fixed length, so that long texts don't drown the marks."""
    x = x * idf
    return np.hstack([0.5 * _unit(x[:, :WIDTH]), _unit(x[:, WIDTH:])])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 9) -> dict | None:
    """Weights, axes, the sample's vectors and labels; None without labelled rows."""
    rows = []
    for label in (0, 1):  # half each, as far as they go
        own = labelled.where(F.col(label_col) == label).select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
        rows += [(r["t"], label) for r in sampled(own, SAMPLE // 2, "i", "t")]
    if not rows:
        return None
    x = np.vstack([features(pa.array([t for t, _ in rows[i : i + 200]])) for i in range(0, len(rows), 200)])
    y = np.array([label for _, label in rows], np.float32)
    idf = np.log((len(x) + 1) / ((x > 0).sum(0) + 1)).astype(np.float32) + 0.05
    x = _weighted(x, idf)
    rng = np.random.default_rng(seed)
    rank = min(RANK, len(x))
    basis = x.T @ rng.normal(size=(len(x), rank + 8)).astype(np.float32)
    for _ in range(3):  # subspace iteration
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ v[:rank].T).astype(np.float32)
    return {"idf": idf, "axes": axes, "vectors": _unit(x @ axes).astype(np.float32), "labels": y}


def vote(model: dict, texts: pa.Array) -> np.ndarray:
    """The share of label 1 among each text's nearest labelled vectors, weighted by similarity."""
    z = _unit(_weighted(features(texts), model["idf"]) @ model["axes"]).astype(np.float32)
    cosine = z @ model["vectors"].T
    k = min(NEIGHBOURS, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3).astype(np.float64) ** SHARP
    return np.clip((weight * model["labels"][near]).sum(1) / weight.sum(1), 0, 1)


def _score(batches, shared):
    model = shared.value
    for batch in batches:
        for piece in pieces(batch, "text", 2 << 20):
            out = []
            for i in range(0, piece.num_rows, 256):
                part = piece.slice(i, 256)
                out.append(vote(model, part.column("text")) if model is not None else np.full(part.num_rows, 0.5))
            score = np.concatenate(out)
            rest = [piece.column(c) for c in piece.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*(c for c in piece.schema.names if c != "text"), "score", "predicted"])


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(partial(_score, shared=spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double, predicted int")


def _keep(batches, shared, text_col: str):
    """Whole rows of the batches that the classifier accepts."""
    model = shared.value
    for batch in batches:
        for piece in pieces(batch, text_col, 2 << 20):
            good = [vote(model, piece.slice(i, 256).column(text_col)) >= THRESHOLD for i in range(0, piece.num_rows, 256)]
            yield piece.filter(pa.array(np.concatenate(good)))


def accept(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts, with their columns; all, if there was nothing to learn from."""
    if model is None:
        return docs
    small_batches(docs.sparkSession)
    return docs.mapInArrow(partial(_keep, shared=docs.sparkSession.sparkContext.broadcast(model), text_col=text_col), docs.schema)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE // 2) -> DataFrame:
    """The labelled rows to learn from: of each label those of the `most` documents with the least hash of doc_id. Ids alone are joined and sampled; texts are only read beside the chosen ids, which are broadcast."""
    known = labels.where(crc_mod("doc_id", 4) != 2).select(F.col("doc_id").alias("_labelled"), "quality").where("quality IS NOT NULL")
    ids = docs.select("doc_id").join(known, F.col("doc_id") == F.col("_labelled")).select("_labelled", "quality").distinct()
    chosen = [(r["_labelled"], label) for label in (0, 1) for r in sampled(ids.where(F.col("quality") == label), most, "_labelled")]
    picked = docs.sparkSession.createDataFrame(chosen, "_labelled long, quality int")
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_labelled"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score(docs, fit(training_rows(docs, load(spark, sf_dir, "labels"))))
