"""LM scoring with a causal self-attention model on subword ids, trained in numpy.

A word is its subword ids with a leading space; a text is its words and an end. The model reads up to LENGTH ids: one
attention head over embeddings with positions gives a context, context and last id give weights over CLASSES latent
classes, and the next id's probability is the weighted mean of the classes' distributions over ids, so no sum over
the vocabulary is needed to score. Ids outside the VOCABULARY most frequent of the corpus share one entry, split by
their corpus counts. Texts are scored in overlapping windows: the first OVERLAP positions of a window are context
only, save in a text's first, so that each id is scored once; windows run in batches under one causal mask.

A word's probability is a mixture of three, all normalised:

* its share in TOPICS kinds of text, weighed by the attention's context; each kind has its words' smoothed shares in all
  training documents of this kind. Without a context the weights would be the kinds' sizes, and this the base;
* the attention's probability of its first id, given that a word border comes, times the word's share (as above) among the
  words that begin with this id;
* the attention's probability of all its ids and of a word border after them, given a border before.

The mixture's weights are learned too: each block of texts fits them to its training rows by expectation-maximisation, where a
word's own occurrence is taken out of its counts (else the counts would know every word of these rows), with
FAITH tokens of START behind them. Topics are kinds of byte pairs,
found by hard expectation-maximisation: SEEDS rows of least hash only give the starting point; from there rounds over
all training rows (TOPIC_ROUNDS) assign texts and count pairs in the tasks. The word counts cover the whole training corpus: Spark
makes and joins them, block by block, and each block of texts gets those of its own words. An unknown word has the
share of one word seen a tenth of a time, as in the base.

The weights are learned from every training row, whole: each of its ids is a target once. Rounds take growing shares of the rows (ROUNDS,
in 64ths; a hash of the row picks its round). In a round each task of the cluster starts from the same weights, takes
Adam steps of bounded gradients over the windows of its own rows, and returns how far its weights moved; tasks' moves are summed by Spark,
weighted by ids, and the driver applies their mean: a thing of fixed size; a move that isn't finite fails the query. A task that has few rows passes over them again until it
has made LEAST steps, so small corpora are learned from too.

Defined cases: null or empty text is the end alone; a null doc_id is neither learned from nor held out; rows that share
a doc_id are separate; without training rows N and V are 0, all words are unknown, and the model is the untrained one;
doc_id must be a whole number; columns beside it and the text don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import subwords
from .common import crc_mod, give_back, load, pieces, sampled, small_batches, text_bytes, text_hash, total_bytes, with_block, written

DIM, CLASSES, LENGTH, OVERLAP, VOCABULARY, TOPICS = 16, 32, 32, 8, 4000, 6
SEEDS, TOPIC_ROUNDS = 600, (4, 12, 48)
ROUNDS, RATES = (1, 1, 2, 4, 8, 16, 32), (0.03, 0.03, 0.03, 0.02, 0.015, 0.01, 0.006)
BATCH, LEAST = 256, 150
AT_ONCE = 100_000  # about so many words are scored together
BLOCK_BYTES = 8 << 20
#: The mixture's weights to start from, and how many tokens' worth they have; it is fitted to one token in FITTED, that is all.
START, FAITH, FITTED = (0.65, 0.3, 0.05), 200, 1
#: One window in so many of a text is learned from, that is all; the largest gradient that a step takes whole.
WINDOWS, STEEPEST = 1, 10.0
NO_PAIR, HEADS = 0x2020, 1 << 17
COUNTS = [f"n{z}" for z in range(TOPICS)]


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lower-cased words of all texts, dictionary-encoded, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    if not real.all():  # a text with white space at its border has empty parts
        text = np.repeat(np.arange(len(counts)), counts)
        counts, flat = np.bincount(text[real], minlength=len(counts)), flat.filter(pa.array(real))
    return flat.dictionary_encode(), counts


def _pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the byte pairs of all texts, with a space after each, and where each text's begin; the last of a text is NO_PAIR."""
    data, offsets = text_bytes(pc.binary_join_element_wise(texts, "", " "))
    pairs = np.append(data[:-1].astype(np.uint16) << np.uint16(8) | data[1:], np.uint16(NO_PAIR)) if len(data) else np.zeros(0, np.uint16)
    pairs[offsets[1:] - 1] = NO_PAIR
    return pairs, offsets[:-1]


def _log_shares(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the pairs; NO_PAIR counts for nothing."""
    counts = counts + 0.05
    counts[NO_PAIR] = 0
    table = np.log(np.maximum(counts, 1e-9) / counts.sum(0)).astype(np.float32)
    table[NO_PAIR] = 0
    return table


def topics_of(table: np.ndarray, coded: pa.DictionaryArray, counts: np.ndarray) -> np.ndarray:
    """The most likely topic of each text, by its words. table: log probabilities of byte pairs, a column for each topic."""
    out, some = np.zeros(len(counts), np.int64), np.flatnonzero(counts)
    if len(some):
        pairs, begin = _pairs(coded.dictionary)
        words = np.column_stack([np.add.reduceat(column[pairs], begin) for column in table.T])[coded.indices.to_numpy()]
        out[some] = np.add.reduceat(words, (np.cumsum(counts) - counts)[some]).argmax(1)
    return out


def learn_topics(texts: list[str], rounds: int = 12) -> np.ndarray:
    """A starting point: log probabilities of byte pairs in each topic. Each further topic starts from the texts that those before explain worst."""
    table = np.zeros((1 << 16, TOPICS), np.float32)
    texts = [t for t in (" ".join(pc.ascii_lower(t).as_py().split()) for t in map(pa.scalar, texts)) if t]
    if not texts:
        return table
    pairs, begin = _pairs(pa.array(texts))
    size = np.diff(np.append(begin, len(pairs)))
    text = np.repeat(np.arange(len(texts)), size)

    def log_of(chosen: np.ndarray) -> np.ndarray:
        return _log_shares(np.bincount(pairs[chosen[text]], minlength=1 << 16).astype(np.float64))

    fit = lambda k: np.column_stack([np.add.reduceat(table[:, z][pairs], begin) for z in range(k)])
    table[:, 0] = log_of(np.ones(len(texts), bool))
    for k in range(1, TOPICS):
        worst = fit(k).max(1) / size
        table[:, k] = log_of(worst <= np.quantile(worst[size > 100], 0.04) if (size > 100).any() else worst <= worst.min())
    for _ in range(rounds):
        best = fit(TOPICS).argmax(1)
        for z in range(TOPICS):
            if (best == z).any():
                table[:, z] = log_of(best == z)
    return table


def _sums_by(index: np.ndarray, rows: np.ndarray, few: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entries of index (below 65,536), most frequent first, and the sums of their rows. The first, second and further rows
    of all entries are added as whole arrays; what an entry has beyond a few rows is a product with ones."""
    order = np.argsort(index.astype(np.uint16), kind="stable")
    own = index[order]
    head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    size = np.diff(np.append(head, len(own)))
    by = np.argsort(-size, kind="stable")
    head, size = head[by], size[by]
    having = np.searchsorted(-size, -np.arange(1, few + 2), side="right").tolist()  # entries of at least so many rows
    rows = rows.take(order, axis=0)
    total = rows.take(head, axis=0)
    for k in range(1, few):
        n = having[k]
        total[:n] += rows.take(head[:n] + k, axis=0)
    ones = np.ones(int(size[0]), rows.dtype)
    for i, (a, n) in enumerate(zip(head[: having[few]].tolist(), size[: having[few]].tolist(), strict=True)):
        total[i] += ones[few:n] @ rows[a + few : a + n]
    return own[head], total


def _row_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, kept; a product with ones is faster than numpy's sum of short rows."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)).reshape(*x.shape[:-1], 1)


def _line(x: np.ndarray) -> np.ndarray:
    """All numbers of x in the order in which they lie."""
    return (x.T if x.flags.f_contiguous else x).reshape(-1)


def _cuts(x: np.ndarray, n: int = 1 << 14):
    """Views of n numbers of x each, so that several passes over one stay in the processor's cache."""
    x = _line(x)
    return [x[at : at + n] for at in range(0, len(x), n)]


class Network:
    """Parameters and passes. Sizes: vocabulary v (last entry: all rare ids), DIM, CLASSES."""

    def __init__(self, unigram: np.ndarray, seed: int = 2):
        rng, v = np.random.default_rng(seed), len(unigram)
        self.p = {
            "emb": rng.normal(0, 0.3, (v, DIM)), "pos": rng.normal(0, 0.1, (LENGTH, DIM)), "att": rng.normal(0, 0.3, (DIM, DIM)),
            "last": rng.normal(0, 0.3, (v, CLASSES)), "ctx": rng.normal(0, 0.3, (DIM, CLASSES)), "out": np.log(unigram)[None, :] + rng.normal(0, 0.5, (CLASSES, v)),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.p |= {"topic": np.zeros((DIM, TOPICS), np.float32), "prior": np.zeros(TOPICS, np.float32)}
        self.p["out"] = np.asfortranarray(self.p["out"])  # an entry's classes side by side
        self.safe = False  # whether no logit can leave the range of exp
        self.mask = np.where(np.tri(LENGTH, dtype=bool), 0, -1e9).astype(np.float32)

    def classes(self) -> np.ndarray:
        by_entry = self.p["out"].T
        e = by_entry - by_entry.max()
        np.exp(e, out=e)
        total = np.ones(len(e), e.dtype) @ e
        if total.min() < 1e-20:  # classes too far apart for one largest logit
            e = np.exp(by_entry - by_entry.max(0))
            total = e.sum(0)
        e /= total
        return e.T

    def forward(self, x: np.ndarray) -> tuple:
        """x: (windows, LENGTH) ids. The weights of the classes at each position, and what the backward pass needs."""
        p = self.p
        e = p["emb"].take(x, axis=0)
        e += p["pos"]
        q = (e @ p["att"]) * np.float32(DIM**-0.5)
        a = np.matmul(q, e.transpose(0, 2, 1))
        a += self.mask
        if not self.safe:
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        total = _row_sums(a)
        c = np.matmul(a, e)
        c /= total
        g = p["last"].take(x, axis=0)
        g += c @ p["ctx"]
        if not self.safe:
            g -= g.max(2, keepdims=True)
        np.exp(g, out=g)
        g /= _row_sums(g)
        return g, e, q, a, total, c

    def seal(self, entries: np.ndarray | None = None) -> None:
        """Looks how large logits can become with the weights as they are; a context is a mean of embeddings. entries: those changed since the last time, if not all."""
        p, norm = self.p, lambda z: np.sqrt(np.einsum("ij,ij->i", z, z).max())
        emb, last = (p["emb"], p["last"]) if entries is None else (p["emb"].take(entries, axis=0), p["last"].take(entries, axis=0))
        most = (norm(emb), np.abs(last).max())
        self.most = most if entries is None else tuple(map(max, self.most, most))
        longest = self.most[0] + norm(p["pos"])
        steep = longest**2 * DIM**-0.5
        flat = steep * np.linalg.norm(p["att"]) < 80 or steep * np.linalg.norm(p["att"], 2) < 80  # the first is never smaller, and cheap
        self.safe = bool(flat and self.most[1] + longest * norm(p["ctx"].T) < 80)

    def topics(self, c: np.ndarray) -> np.ndarray:
        """Weights of the topics for contexts c, a row each."""
        w = c @ self.p["topic"]
        w += self.p["prior"]
        np.exp(np.clip(w, -40, 40, out=w), out=w)
        w /= _row_sums(w)
        return w

    def gradient(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, topic: np.ndarray) -> dict[str, np.ndarray]:
        d, entries = self.gradient_rows(x, y, live, topic)
        for k in ("last", "emb"):
            rows, d[k] = d[k], np.zeros_like(self.p[k])
            d[k][entries] = rows
        return d

    def gradient_rows(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, topic: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The gradient, where last and emb have rows only for the entries, which come second."""
        p, b = self.p, self.classes()
        g, e, q, a, total, c = self.forward(x)
        a /= total
        flat = lambda z: z.reshape(-1, z.shape[-1])
        r = b.T.take(y, axis=0)
        r *= g
        scale = (live / live.sum()).astype(g.dtype)[:, :, None]
        r *= scale / _row_sums(r)
        g *= scale
        g -= r
        dg = g
        dt = self.topics(c)
        dt[np.arange(len(x)), :, topic] -= 1
        dt *= scale
        columns, out = flat(c).T, b.T * (np.ones(x.size, g.dtype) @ flat(r))
        d = {"out": out.T, "ctx": columns @ flat(dg), "topic": columns @ flat(dt), "prior": np.ones(x.size, g.dtype) @ flat(dt)}
        dc = (flat(dg) @ p["ctx"].T).reshape(c.shape)
        dc += (flat(dt) @ p["topic"].T).reshape(c.shape)
        da = np.matmul(dc, e.transpose(0, 2, 1))
        # a row's mean of da under a is its context's product with dc
        da -= _row_sums(dc * c)
        da *= a
        dq = np.matmul(da, e)
        dq *= np.asarray(DIM**-0.5, g.dtype)
        de = np.matmul(a.transpose(0, 2, 1), dc)
        de += np.matmul(da.transpose(0, 2, 1), q)
        de += (flat(dq) @ p["att"].T).reshape(de.shape)
        d["att"] = flat(e).T @ flat(dq)
        d["pos"] = de.sum(0)
        # inputs and targets in one sum, where a target is the next position's input
        n, k = x.shape[1], CLASSES + DIM
        chained = np.array_equal(x[:, 1:], y[:, :-1])
        at = 1 if chained else n
        rows = np.empty((len(x), n + at, k + CLASSES), g.dtype)
        rows[:, :n, :CLASSES], rows[:, :n, CLASSES:k], rows[:, at:, k:] = dg, de, r
        rows[:, n:, :k] = rows[:, :at, k:] = 0
        entries, total = _sums_by(np.hstack([x, y[:, -at:]]).ravel(), flat(rows))
        out[entries] -= total[:, k:]
        d["last"], d["emb"] = np.ascontiguousarray(total[:, :CLASSES]), np.ascontiguousarray(total[:, CLASSES:k])
        return d, entries

    def copy(self) -> Network:
        out = copy.copy(self)
        out.p = {k: z.copy(order="K") for k, z in self.p.items()}
        return out

    def vector(self) -> np.ndarray:
        """All weights in one array."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def move(self, by: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] += by[at : at + n].reshape(self.p[k].shape)
            at += n


class Learner:
    """Adam steps from a network's weights on; an entry's last and emb take part in steps over windows that hold it."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.steps, self.seen = net, rate, 0, 0
        self.m, self.v = ({k: np.zeros_like(z) for k, z in net.p.items()} for _ in range(2))
        net.seal()
        self.kept: list[tuple] = []  # windows to go over again, while they are few

    def step(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, topic: np.ndarray) -> None:
        self.steps += 1
        gradient, entries = self.net.gradient_rows(x, y, live, topic)
        square = sum(float(np.dot(_line(d), _line(d))) for d in gradient.values())
        if not math.isfinite(square):  # beyond single precision
            square = sum(float((d.astype(np.float64) ** 2).sum()) for d in gradient.values())
        norm = math.sqrt(square)
        rate, level = np.float32(self.rate / (1 - 0.9**self.steps)), np.float32(1 / (1 - 0.99**self.steps))
        for k, d in gradient.items():
            if norm > STEEPEST:
                d *= STEEPEST / norm
            rows = entries if k in ("last", "emb") else None
            m, v, p = (z[k] if rows is None else z[k].take(rows, axis=0) for z in (self.m, self.v, self.net.p))
            for m_, v_, p_, d_ in zip(*map(_cuts, (m, v, p, d)), strict=True):
                m_ *= np.float32(0.9)
                m_ += np.float32(0.1) * d_
                d_ *= d_
                d_ *= np.float32(0.01)
                v_ *= np.float32(0.99)
                v_ += d_
                np.multiply(v_, level, out=d_)
                np.sqrt(d_, out=d_)
                d_ += np.float32(1e-8)
                np.divide(m_, d_, out=d_)
                d_ *= rate
                p_ -= d_
            if rows is not None:
                self.m[k][rows], self.v[k][rows], self.net.p[k][rows] = m, v, p
        self.net.seal(entries)

    def learn(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, topic: np.ndarray) -> None:
        """A step for each BATCH of the windows, in random order."""
        if not live.any():
            return
        self.seen += int(live.sum())
        order = np.random.default_rng(len(x)).permutation(len(x))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            self.step(x[pick], y[pick], live[pick], topic[pick])
        if self.steps < LEAST:
            self.kept.append((x, y, live, topic))
        else:
            self.kept = []

    def finish(self) -> None:
        while self.kept and self.steps < LEAST:
            x, y, live, topic = (np.concatenate(z) for z in zip(*self.kept, strict=True))
            order = np.random.default_rng(self.steps).permutation(len(x))
            for at in range(0, len(order), BATCH):
                if self.steps < LEAST:
                    pick = order[at : at + BATCH]
                    self.step(x[pick], y[pick], live[pick], topic[pick])


def windows_over(lengths: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many ids (END first, as it were): the text and first input of each window."""
    stride = LENGTH - overlap
    per = np.maximum(1, -(-(lengths - overlap) // stride))
    text = np.repeat(np.arange(len(lengths)), per)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * stride


def _window_inputs(stream: np.ndarray, lengths: np.ndarray, end: int, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, places of the targets in the stream, which to score) of all windows. A text's ids end with the end id, which also comes before its first."""
    begin = np.cumsum(lengths) - lengths
    text, first = windows_over(lengths, overlap)
    at = first[:, None] + np.arange(LENGTH)
    inside = at < lengths[text][:, None]
    place = np.minimum(begin[text][:, None] + at, len(stream) - 1)
    x = np.where(at > 0, stream[np.maximum(place - 1, 0)], end)
    x[~inside] = end
    score = inside & ((np.arange(LENGTH) >= overlap) | (first == 0)[:, None])
    return x, stream[place], place, score


def scored(net: Network, classes: np.ndarray, border: np.ndarray, stream: np.ndarray, lengths: np.ndarray, end: int, starts: np.ndarray, at_once: int = 96) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log10 probability of each id of the stream; where an id starts a word (starts is set) also that of a border there, and the topics' weights."""
    by_id = np.ascontiguousarray(classes.T).astype(np.float32)
    edge = classes[:, border].sum(1).astype(np.float32)
    n = int(starts.sum())
    p, b, contexts = np.zeros(len(stream), np.float32), np.zeros(n, np.float32), np.zeros((n, DIM), np.float32)
    x, y, _, score = _window_inputs(stream, lengths, end)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    at = to = 0  # windows score the ids of the stream in order
    for w in range(0, len(x), at_once):
        part = slice(w, w + at_once)
        g, _, _, _, _, c = net.forward(x[part])
        place = np.flatnonzero(score[part])
        own = slice(at, at + len(place))
        p[own] = np.einsum("ik,ik->i", flat(g), by_id.take(y[part].ravel(), axis=0)).take(place)
        heads = place[starts[own]]
        at, words = at + len(place), slice(to, to + len(heads))
        to = words.stop
        contexts[words] = flat(c).take(heads, axis=0)
        b[words] = flat(g).take(heads, axis=0) @ edge
    z, tiny = net.topics(contexts), np.float32(1e-30)
    return np.log10(np.maximum(p, tiny)), np.log10(np.maximum(b, tiny)), z


def fit_mixture(parts: np.ndarray, use: tuple, rounds: int = 25) -> np.ndarray:
    """The weights of the parts (a row of probabilities for each token) that are used, by expectation-maximisation from START."""
    start = np.where(use, START, 0.0)
    start /= start.sum()
    weights, columns = start, np.ascontiguousarray(parts.T)  # one row for each part: products with long rows are fast
    for _ in range(rounds if len(parts) else 0):
        mean = weights @ columns
        np.reciprocal(mean, out=mean)
        weights = (weights * (columns @ mean) + FAITH * start) / (len(parts) + FAITH)
    return weights


class Scorer:
    """What scoring needs beside a block's own words: the tokenizer's file, the network, the map from ids to entries, totals."""

    def __init__(self, ranks: bytes, ids: np.ndarray, counts: np.ndarray, totals: np.ndarray, distinct: int, ends: np.ndarray, heads: np.ndarray, table: np.ndarray, use: tuple = (True, True, True)):
        """totals and ends: tokens and ends of training texts in each topic; heads: in each topic (a column), how many words begin with each id of the tokenizer."""
        self.ranks, self.totals, self.distinct, self.ends, self.table, self.use = ranks, totals, distinct, ends, table, use
        order = np.lexsort((ids, -counts))
        top = ids[order][:VOCABULARY]
        top = top if subwords.END in top else np.append(top[: VOCABULARY - 1], subwords.END)
        self.entry = np.full(subwords.END + 1, len(top), np.int32)
        self.entry[top] = np.arange(len(top))
        every = np.zeros(subwords.END + 1)
        every[ids] = counts
        self.end = int(self.entry[subwords.END])
        rare = self.entry == len(top)
        share = (every + 1) / max(1.0, (every[rare] + 1).sum())
        self.within = np.where(rare, np.log10(np.maximum(share, 1e-30)), 0.0).astype(np.float32)  # an id's part of the rare entry
        begun = np.column_stack([np.bincount(self.entry, weights=h, minlength=len(top) + 1) for h in heads.T])
        self.first = ((begun + 0.1) / (totals + 0.1 * len(begun))).astype(np.float32)  # the share of each topic's words that begin with an entry
        unigram = np.bincount(self.entry, weights=every + 0.01, minlength=len(top) + 1) + 0.5
        self.net = Network(unigram / unigram.sum())
        enc = subwords.encoder(self.ranks)
        self.starts = np.append(subwords.starts_of(enc), True)
        rare = np.flatnonzero(rare)
        # the rare entry counts as a border by the share of its ids that begin with a space
        self.border = np.zeros(len(top) + 1, bool)
        self.border[self.entry[np.flatnonzero(self.starts)]] = True
        self.border[len(top)] = self.starts[rare].mean() > 0.5 if len(rare) else False

    def seal(self) -> None:
        self.net.seal()
        self.classes = self.net.classes()

    def windows(self, enc, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(inputs, targets, which are targets, topic) of the windows over all texts; each id is a target once, ends too."""
        coded, counts = _words(texts)
        stream, lengths, _, _ = self.stream(*self.encoded(enc, coded.dictionary), coded.indices.to_numpy(), counts)
        x, y, _, live = _window_inputs(self.entry[stream], lengths, self.end, 0)
        y[:, :-1] = x[:, 1:]  # so it is already, save where there is no target
        return x, y, live, topics_of(self.table, coded, counts)[windows_over(lengths, 0)[0]]

    def stream(self, ids: np.ndarray, begin: np.ndarray, words: np.ndarray, counts: np.ndarray):
        """Ids of texts of so many words, each with END after it; ids of each text; ids of each word, with the ends as words; and which word each is."""
        which = np.insert(words.astype(np.int64), np.cumsum(counts), len(begin) - 2)
        stream, size = subwords.spread(ids, begin, which)
        text = np.repeat(np.arange(len(counts)), counts + 1)
        return stream, np.bincount(text, weights=size, minlength=len(counts)).astype(np.int64), size, which

    @staticmethod
    def encoded(enc, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and of the end after them, and where each one's begin."""
        ids, begin = subwords.encode_spaced(enc, dictionary)
        return np.append(ids, np.uint16(subwords.END)), np.append(begin, len(ids) + 1)

    def score(self, texts: pa.Array, train: np.ndarray, words: pa.Array, counts: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """(n_tokens, n_known, base_score, score) of each text; train: which are of the training rows; words: all their words, with training counts by topic and ids."""
        coded, per = _words(texts)
        place = pc.index_in(coded.dictionary, value_set=words).to_numpy()
        indices = place[coded.indices.to_numpy()] if len(place) else np.zeros(0, np.int32)
        ids, begin = np.append(ids, np.uint16(subwords.END)), np.append(begin, len(ids) + 1)
        c = np.vstack([counts, self.ends[None]])
        unseen = 0.1 * (self.distinct + 1)
        base = np.log10((c.sum(1) + 0.1) / (self.totals.sum() + unseen))
        share = ((c + 0.1) / (self.totals + unseen)).astype(np.float32)
        seen, kinds = c.sum(1) > 0, topics_of(self.table, coded, per)
        ends, out, at, parts, known = np.cumsum(per), [], 0, [], []
        while at < len(per):  # some texts at a time, so that arrays stay small
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            own = per[at:to]
            stream, lengths, size, which = self.stream(ids, begin, indices[ends[at] - per[at] : ends[to - 1]], own)
            text = np.repeat(np.arange(len(own)), own + 1)
            total = lambda z: np.bincount(text, weights=z, minlength=len(own))  # noqa: B023, E731
            out.append((own + 1, total(seen[which]).astype(np.int64), total(base[which])))
            found, z = self._parts(stream, lengths, size, which, share)
            parts.append(found)
            live = np.flatnonzero(np.repeat(train[at:to], own + 1))[::FITTED]
            kind = np.repeat(kinds[at:to], own + 1)[live]
            # without the word's own occurrence
            less = 1 - z[live, kind] / (self.totals[kind] + unseen) / found[live, 0]
            known.append(np.column_stack([found[live, :2] * np.maximum(less, 1e-9)[:, None], found[live, 2]]))
            at = to
        mixed = np.minimum(0, np.log10(np.maximum(np.concatenate(parts) @ fit_mixture(np.concatenate(known), self.use), 1e-300)))
        text = np.repeat(np.arange(len(per)), per + 1)
        return *(np.concatenate(x) for x in zip(*out, strict=True)), np.bincount(text, weights=mixed, minlength=len(per))

    def _parts(self, stream: np.ndarray, lengths: np.ndarray, size: np.ndarray, which: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's three probabilities, and the topics' weights there."""
        last = np.cumsum(size) - 1
        first = last - size + 1
        starts = np.zeros(len(stream), bool)
        starts[first] = True
        p, border, z = scored(self.net, self.classes, self.border, self.entry[stream], lengths, self.end, starts)
        own, head = np.einsum("wz,wz->w", z, share[which]), np.einsum("wz,wz->w", z, self.first[self.entry[stream[first]]])
        begun = own * np.minimum(1, 10.0 ** (p[first] - border)) / head
        p += self.within[stream]
        after = np.append(border[1:], np.float32(0))
        after[which == len(share) - 1] = 0  # nothing follows an end
        spelled = 10.0 ** np.minimum(0, np.add.reduceat(p, first) - border + after)
        return np.column_stack([own, np.minimum(1, begun), spelled]).astype(np.float64), z


def _block_words(table: pa.Table, topics: np.ndarray) -> pa.Table:
    """A block's distinct words with their numbers in training texts of each topic, and the ends of those texts under the word null."""
    schema = pa.schema([("block", pa.int32()), ("word", pa.string()), *((c, pa.int64()) for c in COUNTS)])
    words, numbers = [], []
    for piece in pieces(table, "text"):
        text = piece["text"].combine_chunks() if piece["text"].num_chunks != 1 else piece["text"].chunk(0)
        coded, counts = _words(text)
        train, kind = piece["train"].to_numpy(zero_copy_only=False).astype(bool), topics_of(topics, coded, counts)
        of, live = np.repeat(kind, counts), np.repeat(train, counts)
        cell = coded.indices.to_numpy()[live] * np.int64(TOPICS) + of[live]
        words += [coded.dictionary, pa.array([None], pa.string())]
        numbers += [np.bincount(cell, minlength=len(coded.dictionary) * TOPICS).reshape(-1, TOPICS), np.bincount(kind[train], minlength=TOPICS)[None]]
    if not words:
        return schema.empty_table()
    n = np.concatenate(numbers).astype(np.int64)
    found = pa.table({"word": pa.chunked_array(words), **dict(zip(COUNTS, n.T, strict=True))}).group_by("word").aggregate([(c, "sum") for c in COUNTS])
    del words, numbers, n
    give_back()
    return pa.table([np.full(found.num_rows, table["block"][0].as_py(), np.int32), found["word"], *(found[f"{c}_sum"] for c in COUNTS)], schema=schema)


def _encode_words(batches, ranks):
    """For each counted word its counts, in numbers of as few bytes as the largest needs, and its subword ids: what each block that has the word gets."""
    enc = subwords.encoder(ranks.value)
    for b in batches:
        counts = np.column_stack([b.column(c).to_numpy() for c in COUNTS]).astype("<i8")
        width = np.array([1, 2, 4, 8])[np.searchsorted([1 << 8, 1 << 16, 1 << 32], counts.max(1, initial=0), "right")]
        word, data = b.column("word"), [b""] * b.num_rows
        ids, begin = subwords.encode_spaced(enc, word.drop_null())
        ids, begin = ids.astype("<u2").tobytes(), 2 * begin
        at = np.cumsum(word.is_valid().to_numpy(zero_copy_only=False)) - 1  # null, the end, has no ids
        first, last = np.where(word.is_valid(), begin[at], 0).tolist(), np.where(word.is_valid(), begin[at + 1], 0).tolist()
        for k in np.unique(width).tolist():
            own = np.flatnonzero(width == k)
            raw, size = counts[own].astype(f"<u{k}").tobytes(), k * TOPICS
            for at, i in enumerate(own.tolist()):
                data[i] = bytes([k]) + raw[at * size : (at + 1) * size] + ids[first[i] : last[i]]
        yield pa.RecordBatch.from_arrays([word, pa.array(data, pa.binary())], names=["word", "data"])


def _decoded(data: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by topic, ids of all words, and where each word's ids begin (with the end)."""
    raw = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
    size = pc.binary_length(data).to_numpy().astype(np.int64)
    first = np.cumsum(size) - size
    width, head, counts = raw[first].astype(np.int64), np.zeros(len(raw), bool), np.zeros((len(size), TOPICS))
    head[first] = True
    for k in (1, 2, 4, 8):
        own = np.flatnonzero(width == k)
        cells = first[own][:, None] + 1 + np.arange(k * TOPICS)
        head[cells.ravel()] = True
        counts[own] = raw[cells].view(f"<u{k}")
    begin = np.concatenate([[0], np.cumsum((size - 1 - width * TOPICS) // 2)])
    return counts, raw[~head].view("<u2"), begin


def _count_ids(batches):
    """Subword counts of a batch of counted words; under HEADS and more, how many words of each topic begin with each id; and under negative ids the totals: -1 to -TOPICS words of a topic, TOPICS further ones its ends, the last two distinct words and whether there is an end."""
    for b in batches:
        if not b.num_rows:
            continue
        counts, ids, begin = _decoded(b.column("data"))
        total = np.bincount(ids, weights=np.repeat(counts.sum(1), np.diff(begin)), minlength=1)
        some = np.flatnonzero(total)
        end = b.column("word").is_null().to_numpy(zero_copy_only=False).astype(bool)
        seen = counts.sum(1) > 0
        sums = np.concatenate([counts[~end].sum(0), counts[end].sum(0), [seen[~end].sum(), seen[end].sum()]])
        word = np.flatnonzero(~end)
        cell = ids[begin[word]].astype(np.int64)[:, None] * TOPICS + np.arange(TOPICS)
        heads = np.bincount(cell.ravel(), weights=counts[word].ravel(), minlength=1)
        begun = np.flatnonzero(heads)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, HEADS + begun, -1 - np.arange(len(sums))]).astype(np.int32)), pa.array(np.concatenate([total[some], heads[begun], sums]).astype(np.int64))], names=["id", "n"])


def _count_pairs(batches, table: np.ndarray):
    """How often each byte pair stands in the texts of each topic, by the words' topics under the table."""
    counts, seen = np.zeros((1 << 16, TOPICS)), 0
    for batch in batches:
        for piece in pieces(batch, "text"):
            coded, per = _words(piece.column("text"))
            if not len(coded.dictionary):
                continue
            seen += piece.num_rows
            kind = np.repeat(topics_of(table, coded, per), per)
            weight = np.bincount(coded.indices.to_numpy() * np.int64(TOPICS) + kind, minlength=len(coded.dictionary) * TOPICS).reshape(-1, TOPICS)
            pairs, begin = _pairs(coded.dictionary)
            word = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(pairs))))
            for z in range(TOPICS):
                counts[:, z] += np.bincount(pairs, weights=weight[word, z], minlength=1 << 16)
    give_back()
    if seen:
        yield _move(counts, 1.0)


def _train(batches, shared, rate: float):
    """How far the weights move over the windows of a task's texts."""
    scorer = shared.value
    enc, net = subwords.encoder(scorer.ranks), scorer.net.copy()
    learner = Learner(net, rate)
    for batch in batches:
        for piece in pieces(batch, "text"):
            learner.learn(*scorer.windows(enc, piece.column("text")))
    learner.finish()
    give_back()
    if learner.seen:
        yield _move(net.vector() - scorer.net.vector(), learner.seen)


def _move(x: np.ndarray, weight: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([float(weight)]), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["task", "weight", "move"])


def _mean(batches):
    """One row for all rows of a task: the sum of the weights and the mean move."""
    total, weight = 0.0, 0.0
    for b in batches:
        for w, x in zip(b.column("weight").to_pylist(), b.column("move").to_pylist(), strict=True):
            total, weight = total + w * np.frombuffer(x, np.float32).astype(np.float64), weight + w
    if weight:
        yield _move(total / weight, weight)


def _mean_move(rows: DataFrame, share: tuple[int, int], step) -> tuple[np.ndarray, float] | None:
    """The tasks' mean of what step yields for the rows whose hash in 64ths lies in share. One task for each core; at most 16 sums reach the driver."""
    kind = "task int, weight double, move binary"
    chosen = rows.where((F.col("_64th") >= share[0]) & (F.col("_64th") < share[1])).select("text")
    moves = chosen.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)).mapInArrow(step, kind)
    sums = moves.repartition(16, F.col("task") % 16).mapInArrow(_mean, kind).collect()
    if not sums:
        return None
    weight = sum(r["weight"] for r in sums)
    mean = sum(r["weight"] * np.frombuffer(r["move"], np.float32).astype(np.float64) for r in sorted(sums, key=lambda r: r["task"])) / weight
    if not np.isfinite(mean).all():
        raise ArithmeticError("a task's move isn't finite")
    return mean, weight


def _shares(rounds: tuple[int, ...]) -> list[tuple[int, int]]:
    ends = np.cumsum(rounds).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def find_topics(rows: DataFrame, table: np.ndarray) -> np.ndarray:
    """The table after rounds over all rows (text, _64th)."""
    counts = np.zeros((1 << 16, TOPICS))
    for share in _shares(TOPIC_ROUNDS):
        found = _mean_move(rows, share, partial(_count_pairs, table=table))
        if found is not None:
            mean, tasks = found
            counts = counts / 4 + (mean * tasks).reshape(counts.shape)  # older rounds had worse topics
            table = _log_shares(counts)
    return table


def train(rows: DataFrame, scorer: Scorer) -> None:
    """Moves the scorer's weights over all rows (text, _64th)."""
    context = rows.sparkSession.sparkContext
    for share, rate in zip(_shares(ROUNDS), RATES, strict=True):
        shared = context.broadcast(scorer)
        found = _mean_move(rows, share, partial(_train, shared=shared, rate=rate))
        if found is not None:
            scorer.net.move(found[0])
        shared.unpersist()


def _score_block(docs: pa.Table, words: pa.Table, scorer) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    if not docs.num_rows:
        return schema.empty_table()
    flat = lambda c: c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
    values = scorer.score(flat(docs["text"]), docs["train"].to_numpy(zero_copy_only=False).astype(bool), flat(words["word"]), *_decoded(flat(words["data"])))
    give_back()
    return pa.table([docs["doc_id"], docs["held_out"], *map(pa.array, values)], schema=schema)


def score(docs: DataFrame, learn, held_out, ranks_path: str = subwords.RANKS, id_col: str = "doc_id", text_col: str = "text", use: tuple = (True, True, True)) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row. learn and held_out are conditions on the rows of docs; use tells which parts of the mixture count."""
    spark = docs.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(subwords.ranks_of(ranks_path))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(learn, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    blocks = max(1, math.ceil(total_bytes(narrow) / BLOCK_BYTES))
    dealt = with_block(narrow.withColumn("h", text_hash()), blocks, "doc_id", "h").drop("h")
    rows = narrow.where("train").select(F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("_64th"), "text")
    seeds = sampled(narrow.where("train").select("doc_id", F.coalesce("text", F.lit("")).alias("t")), SEEDS, "doc_id", "t")
    topics = find_topics(rows, learn_topics([r["t"] for r in seeds]))
    columns = ", ".join(f"{c} long" for c in COUNTS)
    words = written(dealt.select("block", "train", "text").groupBy("block").applyInArrow(lambda t: _block_words(t, topics), f"block int, word string, {columns}"), "zstd")
    counts = words.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))
    encoded = written(counts.mapInArrow(lambda b: _encode_words(b, ranks), "word string, data binary"), "zstd")
    # at most the tokenizer's vocabulary, and that for each topic
    found = encoded.mapInArrow(_count_ids, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, numbers = found["id"].to_numpy(), found["n"].to_numpy().astype(np.float64)
    sums = np.zeros(2 * TOPICS + 2)
    sums[-1 - ids[ids < 0]] = numbers[ids < 0]
    n, ends = sums[:TOPICS], sums[TOPICS : 2 * TOPICS]
    distinct = int(sums[-2]) + int(sums[-1] > 0)
    heads = np.zeros((subwords.END + 1) * TOPICS)
    heads[ids[ids >= HEADS] - HEADS] = numbers[ids >= HEADS]
    heads = heads.reshape(-1, TOPICS)
    heads[subwords.END] = ends
    plain = (ids >= 0) & (ids < HEADS)
    scorer = Scorer(ranks.value, np.append(ids[plain], subwords.END), np.append(numbers[plain], ends.sum()), n + ends, distinct, ends, heads, topics, use)
    train(rows, scorer)
    scorer.seal()
    shared = spark.sparkContext.broadcast(scorer)
    own = words.select("block", "word").join(encoded, "word").select("block", "word", "data")
    out = dealt.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(lambda d, w: _score_block(d, w, shared.value), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int((n + ends).sum())).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"), crc_mod("doc_id", 10) != 0, crc_mod("doc_id", 10) == 0)
