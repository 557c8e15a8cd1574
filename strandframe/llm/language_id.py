"""Language ID with a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text is cut into windows of WINDOW bytes, each with MARGIN bytes of its neighbours on both sides; two gated
recurrent layers run over every window, one in each direction; at each position both states give the languages'
logits. The document's probabilities are the softmax of the mean of its positions' log probabilities, scaled by
POOL, over positions with letters nearby. Each cell has one gate: h = h + z * (tanh(c) - h), z = sigmoid(g), with g
and c linear in the byte's embedding and the last state. All windows of a batch run side by side.

The network learns from a bounded, documented sample of labelled rows: an equal part of SAMPLE for each language of the
labelled rows, one row at least, and of each language its rows of least hash. Of these rows the whole texts are learned
from: a batch has as many texts of each language as of any other, and of a text any of its windows, all as likely.

Defined cases: null text, and text without a letter, is `und` with score 0; a null lang is not learned from; with no
labelled row at all every text is `und`; rows that share a doc_id are separate; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, load, pieces, small_batches, text_bytes

HIDDEN, WINDOW, MARGIN = 8, 96, 16
SAMPLE, STEPS, BATCH = 1_200, 500, 128
POOL = 6.0


def fresh(classes: int, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters: for both directions a table of a byte's part of gate and candidate, and the state's part; and the output layer."""
    rng = np.random.default_rng(seed)
    p = {"out": rng.normal(0, 0.1, (classes, 2 * HIDDEN)), "bias": np.zeros((classes, 1))}
    for d in "fb":
        p["x" + d] = rng.normal(0, 0.3, (256, 2 * HIDDEN))
        p["x" + d][:, :HIDDEN] -= 0.5
        p["h" + d] = rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(x: np.ndarray, table: np.ndarray, rec: np.ndarray, tape: list | None) -> np.ndarray:
    """States (time, HIDDEN, windows) for bytes x (time, windows). The gate is a sigmoid by way of tanh."""
    steps, n = x.shape
    h, out = np.zeros((HIDDEN, n), np.float32), np.empty((steps, HIDDEN, n), np.float32)
    scale = np.ones((2 * HIDDEN, 1), np.float32)
    scale[:HIDDEN] = 0.5
    columns, rec = np.ascontiguousarray((table * scale.T).T), np.ascontiguousarray(rec * scale)
    for t in range(steps):
        a = rec @ h
        a += np.take(columns, x[t], axis=1)
        np.tanh(a, out=a)
        z, c = a[:HIDDEN], a[HIDDEN:]
        z *= 0.5
        z += 0.5
        if tape is not None:
            tape.append((h, z, c))
        h = np.add(h, z * (c - h), out=out[t])
    return out


def _logits(p: dict, f: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.matmul(p["out"][:, :HIDDEN], f) + np.matmul(p["out"][:, HIDDEN:], b) + p["bias"]


def _back(x: np.ndarray, rec: np.ndarray, tape: list, grad: np.ndarray, size: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the byte table and the state matrix, by backpropagation through time."""
    drec, dh, parts = np.zeros_like(rec), np.zeros_like(grad[0]), []
    for t in range(len(tape) - 1, -1, -1):
        h, z, c = tape[t]
        dh = dh + grad[t]
        da = np.concatenate([dh * (c - h) * z * (1 - z), dh * z * (1 - c * c)])
        parts.append(da)
        drec += da @ h.T
        dh = dh * (1 - z) + rec.T @ da
    byte, each = x[::-1].ravel(), np.concatenate(parts, axis=1)
    dx = np.column_stack([np.bincount(byte, weights=d, minlength=size[0]) for d in each])
    return dx.astype(np.float32), drec


def _gradient(p: dict, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    tapes = {"f": [], "b": []}
    f = _run(x, p["xf"], p["hf"], tapes["f"])
    b = _run(x[::-1], p["xb"], p["hb"], tapes["b"])[::-1]
    e = _logits(p, f, b)
    e = np.exp(e - e.max(1, keepdims=True))
    e /= e.sum(1, keepdims=True)
    e[:, y, np.arange(len(y))] -= 1
    e /= e.shape[0] * e.shape[2]
    g = {"bias": e.sum((0, 2))[:, None], "out": np.hstack([np.einsum("tcn,thn->ch", e, s, optimize=True) for s in (f, b)])}
    gf, gb = np.matmul(p["out"][:, :HIDDEN].T, e), np.matmul(p["out"][:, HIDDEN:].T, e)
    g["xf"], g["hf"] = _back(x, p["hf"], tapes["f"], gf, p["xf"].shape)
    g["xb"], g["hb"] = _back(x[::-1], p["hb"], tapes["b"], gb[::-1], p["xb"].shape)
    return g


def train(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, classes: int, steps: int | None = None, rate: float = 0.02, seed: int = 11) -> dict[str, np.ndarray]:
    """Adam over batches of windows of the texts, with as many of each language in a batch as of any other."""
    p, rng, steps = fresh(classes), np.random.default_rng(seed), steps or STEPS
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    own = [np.flatnonzero(labels == c) for c in range(classes)]
    windows = -(-np.diff(offsets) // WINDOW)
    for step in range(1, steps + 1):
        text = np.concatenate([rng.choice(o, max(1, BATCH // classes)) for o in own])
        x, _ = _windows_at(data, offsets, text, rng.integers(0, windows[text]))
        for k, g in _gradient(p, np.ascontiguousarray(x.T), labels[text]).items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            p[k] -= (rate * min(1, 2 * (1 - step / steps) + 0.02) / (1 - 0.9**step)) * m[k] / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return p


def _windows_at(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window k of each text doc with its margins, filled with zero bytes outside the text; how many of its own bytes are text."""
    begin = offsets[doc] + k * WINDOW - MARGIN
    at = begin[:, None] + np.arange(WINDOW + 2 * MARGIN)
    inside = (at >= offsets[doc][:, None]) & (at < offsets[doc + 1][:, None])
    x = np.where(inside, data[np.clip(at, 0, max(0, len(data) - 1))], 0).astype(np.uint8) if len(data) else np.zeros(at.shape, np.uint8)
    return x, np.minimum(WINDOW, np.diff(offsets)[doc] - k * WINDOW)


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts with their margins; each one's text; how many of its own bytes are text."""
    per = -(-np.diff(offsets) // WINDOW)
    doc = np.repeat(np.arange(len(per)), per)
    x, own = _windows_at(data, offsets, doc, np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
    return x, doc, own


def document_scores(p: dict, texts: pa.Array, at_once: int = 4096) -> np.ndarray:
    """For each text the languages' probabilities; every byte is labelled once."""
    data, offsets = text_bytes(texts)
    classes = len(p["bias"])
    total, count = np.zeros((len(offsets) - 1, classes)), np.zeros(len(offsets) - 1)
    step = at_once * WINDOW
    windows = np.cumsum(-(-np.diff(offsets) // WINDOW))
    begin = 0
    while begin < len(offsets) - 1:  # whole texts, about at_once windows together
        end = max(begin + 1, int(np.searchsorted(windows, (windows[begin - 1] if begin else 0) + at_once, "right")))
        x, doc, own = _cut(data, offsets[begin : end + 1])
        for w in range(0, len(x), at_once):  # a single very long text
            xt = np.ascontiguousarray(x[w : w + at_once].T)
            f = _run(xt, p["xf"], p["hf"], None)[MARGIN : MARGIN + WINDOW]
            b = _run(xt[::-1], p["xb"], p["hb"], None)[::-1][MARGIN : MARGIN + WINDOW]
            e = _logits(p, f, b)
            e -= np.log(np.exp(e).sum(1, keepdims=True))  # small logits: no overflow in single precision
            # a position counts if its byte is a letter or part of a longer code point
            byte = xt[MARGIN : MARGIN + WINDOW]
            letter = ((byte >= 97) & (byte <= 122)) | ((byte >= 65) & (byte <= 90)) | (byte >= 128)
            letter &= np.arange(WINDOW)[:, None] < own[w : w + at_once]
            np.add.at(total, begin + doc[w : w + at_once], np.einsum("tcn,tn->nc", e, letter.astype(np.float32), optimize=True))
            np.add.at(count, begin + doc[w : w + at_once], letter.sum(0))
        begin = end
    mean = POOL * total / np.maximum(count, 1)[:, None]
    mean = np.exp(mean - mean.max(1, keepdims=True))
    return mean / mean.sum(1, keepdims=True)


def _predict(batches, p: dict | None, langs: list[str]):
    for batch in batches:
        for piece in pieces(batch, "text", 8 << 20):
            lettered = pc.fill_null(pc.match_substring_regex(piece.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)
            if p is None:
                lang, score = ["und"] * piece.num_rows, np.zeros(piece.num_rows)
            else:
                probability = document_scores(p, piece.column("text"))
                best = probability.argmax(1)
                lang = [langs[c] if ok else "und" for c, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered, probability.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(lang), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[dict | None, list[str]]:
    """The network and the languages, from a bounded sample of the labelled rows, whose whole texts reach the driver."""
    sample = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    langs = sorted(r["l"] for r in sample.select("l").distinct().collect())
    if not langs:
        return None, []
    most = max(1, SAMPLE // len(langs))
    hashed = sample.withColumn("_hash", F.xxhash64("i", "t"))
    first = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy("l").orderBy("_hash"))).where(F.col("_n") <= most)
    last = first(hashed.select("l", "_hash")).groupBy("l").agg(F.max("_hash").alias("_last"))
    # few texts pass the bound, so none of the others is sorted
    rows = sorted(first(hashed.join(F.broadcast(last), "l").where("_hash <= _last")).select("i", "t", "l", "_hash").collect(), key=lambda r: (r["_hash"], repr(r)))
    data, offsets = text_bytes(pa.array([r["t"] for r in rows]))
    return train(data, offsets, np.array([langs.index(r["l"]) for r in rows]), len(langs)), langs


def identify(docs: DataFrame, network: dict | None, langs: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc_mod(id_col, 3) == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(partial(_predict, p=network, langs=langs), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return identify(docs, *fit(docs.where(crc_mod("doc_id", 3) != 1)))
