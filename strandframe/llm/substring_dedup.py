"""Substring dedup by relative Lempel-Ziv parsing.

Texts are dealt into blocks of bounded size by a hash of their key. A document would have to be factored against
every block, at the cost of the square of the input, so pieces go only where they can match. Each block sends the hash
of its anchors (in every window of ``span`` words the run of ANCHOR words with the least hash); equal windows have
equal anchors, so only windows around anchors that occur twice can have a source. Of those, hashes are exchanged as
plain rows, and a window over each hash finds its first place in the corpus: that place's block is the reference for
all the others. Both exchanges are rows of a few numbers, one for each distinct hash of a block, so a passage in a third of
all documents is one row a block.

A reference block then holds the passages that occur first in it, and is indexed: the suffixes of its words, sorted by
prefix doubling up to FACTOR words. The pieces of other texts (runs of windows first seen in this block) are parsed
against it from left to right: each factor is the longest match with a place earlier in the corpus, found next to the
suffix in sorted order, as (length, source document, source word). A factor is long enough if it has span words.
Parsing goes on span - 1 words before the factor's end, so that windows across a border are checked too. The factors'
words are the duplicate spans. A block that many pieces refer to is parsed by several tasks, each with the index and
some of the pieces; pieces of a block with equal words are sent once, with all their places.

Windows are compared by 64-bit hashes of their words, and the words of pieces by 48 bits of theirs.

Defined cases: null text has no words; a text shorter than span loses nothing; rows that share doc_id and text are
one document and each get its result; rows that share only the doc_id are ordered by a hash of the text; a null doc_id
counts as the largest; doc_id must be a whole number, and its column's name and further columns don't matter; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_up_to, load, run_hashes, small_batches, text_bytes, text_hash, total_bytes, with_block, word_hashes, word_spans

ANCHOR = 10
BLOCK_BYTES = 8 << 20
FACTOR = 64  # words of a factor at most; a longer match is several that overlap
PARSED = 200_000  # about so many windows of pieces are parsed by one task
LAST = np.iinfo(np.int64).max


def _window_hashes(texts: pa.Array, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes' windows: (hash, text number, start in the text, first word of each text, all word hashes)."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, fold=False)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes = run_hashes(words, span)
    n = len(hashes)
    whole = doc[:n] == doc[span - 1 :] if n else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    return hashes[at], doc[at], at - first[doc[at]], first, words


def _anchors(words: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """For each window that starts at word at: the least hash of the runs of ANCHOR words in it."""
    runs = run_hashes(words, min(ANCHOR, span))
    low, width, want = runs, 1, span - min(ANCHOR, span) + 1
    while width < want:
        step = min(width, want - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    return low[at]


def _keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table["doc_id"].fill_null(LAST).to_numpy(), table["h"].to_numpy()


def _first_places(hashes: np.ndarray, ids: np.ndarray, h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows stand at their hash's first place, one for each hash; and the number of that window for each."""
    order = np.lexsort((start, h, ids, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    lead, of = np.zeros(len(order), bool), np.empty(len(order), np.int64)
    lead[order[new]] = True
    of[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return lead, of


def _is_in(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _send_anchors(table: pa.Table, span: int) -> pa.Table:
    """The block's distinct anchors, and whether each stands at two places of the block."""
    schema = pa.schema([("block", pa.int32()), ("anchor", pa.int64()), ("twice", pa.bool_())])
    if not table.num_rows:
        return schema.empty_table()
    _, doc, start, first, words = _window_hashes(table["text"], span)
    each = np.unique(_anchors(words, first[doc] + start, span))
    runs = run_hashes(words, min(ANCHOR, span))
    at = np.searchsorted(each, runs[_is_in(runs, each)])
    twice = np.bincount(at, minlength=len(each)) > 1
    return pa.table([np.full(len(each), table["block"][0].as_py(), np.int32), _long(each), pa.array(twice)], schema=schema)


def _send_windows(docs: pa.Table, anchors: pa.Table, span: int) -> pa.Table:
    """The first place in the block of each distinct window around a repeated anchor, and whether the block has a second."""
    schema = pa.schema([("hash", pa.int64()), ("block", pa.int32()), ("id", pa.int64()), ("place", pa.int64()), ("twice", pa.bool_())])
    if not docs.num_rows or not anchors.num_rows:
        return schema.empty_table()
    hashes, doc, start, first, words = _window_hashes(docs["text"], span)
    live = _is_in(_anchors(words, first[doc] + start, span), np.sort(anchors["anchor"].to_numpy().view(np.uint64)))
    hashes, doc, start = hashes[live], doc[live], start[live]
    ids, h = _keys(docs)
    ids, h = ids[doc], h[doc]
    lead, of = _first_places(hashes, ids, h, start)
    again = (ids != ids[of]) | (h != h[of]) | (start != start[of])  # repeats of a row stand at its own place
    twice = np.bincount(of, weights=again, minlength=len(of)) > 0
    at = np.flatnonzero(lead)  # in the order of the texts, so that neighbouring rows are alike and pack well
    block = np.full(len(at), docs["block"][0].as_py(), np.int32)
    return pa.table([_long(hashes[at]), block, ids[at], (h[at].astype(np.int64) << 32) + start[at], twice[at]], schema=schema)


def _pack(batches, at_once: int = 1 << 20):
    """Rows (block, hash, source) as one row for each block of many: the hashes and their sources' blocks as bytes."""
    held, rows = [], 0

    def out():
        table = pa.Table.from_batches(held)
        block, source, hashes = (table[c].to_numpy() for c in ("block", "source", "hash"))
        order = np.lexsort((source, block))
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        parts = np.split(order, cuts)
        return pa.RecordBatch.from_arrays([pa.array([block[p[0]] for p in parts], pa.int32()), pa.array([hashes[p].tobytes() for p in parts], pa.binary()), pa.array([source[p].tobytes() for p in parts], pa.binary())], names=["block", "hashes", "sources"])

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= at_once:
            yield out()
            held, rows = [], 0
    if rows:
        yield out()


def _count_sources(batches):
    for b in batches:
        block, n = np.unique(np.frombuffer(b"".join(b.column("sources").to_pylist()), np.int32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(n)], names=["source", "n"])


def _short(words: np.ndarray) -> bytes:
    """Word hashes cut to 48 bits: pieces whose windows are known to be equal elsewhere are compared by them."""
    return words.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long_words(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


PIECE = "source int, home int, is_source boolean, id long, h int, start int, words binary, places binary"


def _runs(windows: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive windows begin and end among the chosen ones (more: must be equal within a run)."""
    new = np.ones(len(windows), bool)
    new[1:] = windows[1:] != windows[:-1] + 1
    for x in more:
        new[1:] |= x[1:] != x[:-1]
    head = np.flatnonzero(new)
    return head, np.append(head[1:], len(windows))[: len(head)]


def _send_pieces(docs: pa.Table, known: pa.Table, span: int) -> pa.Table:
    """The block's passages that are sources, and for each reference block the block's pieces that it is to parse."""
    schema = pa.schema([("source", pa.int32()), ("home", pa.int32()), ("is_source", pa.bool_()), ("id", pa.int64()), ("h", pa.int32()), ("start", pa.int32()), ("words", pa.binary()), ("places", pa.binary())])
    if not docs.num_rows or not known.num_rows:
        return schema.empty_table()
    block = docs["block"][0].as_py()
    hashes, doc, start, first, words = _window_hashes(docs["text"], span)
    found, source = (np.frombuffer(b"".join(known[c].to_pylist()), t) for c, t in (("hashes", np.uint64), ("sources", np.int32)))
    order = np.argsort(found)
    live = np.flatnonzero(_is_in(hashes, found[order]))
    hit = order[np.searchsorted(found[order], hashes[live])]
    to, hashes, doc, start = source[hit], hashes[live], doc[live], start[live]
    ids, h = _keys(docs)
    _, of = _first_places(hashes, ids[doc], h[doc], start)
    own = (to == block) & (ids[doc] == ids[doc[of]]) & (h[doc] == h[doc[of]]) & (start == start[of])  # the first place in the corpus
    rows, seen = [], {}
    place = first[doc] + start
    for chosen, is_source in ((own, True), (~own, False)):
        pick = np.flatnonzero(chosen)
        head, tail = _runs(start[pick], doc[pick], to[pick])
        for a, b in zip(pick[head].tolist(), pick[tail - 1].tolist(), strict=True):
            text = _short(words[place[a] : place[b] + span])
            where = (int(ids[doc[a]]), int(h[doc[a]]), int(start[a]))
            key = (is_source, int(to[a]), text)
            if key in seen:
                seen[key].append(where)
            else:
                seen[key] = [where]
                rows.append(key)
    out = []
    for is_source, source, text in rows:
        where = sorted(set(seen[(is_source, source, text)]))
        out.append((source, block, is_source, *where[0], text, b"" if is_source else np.array(where, np.int64).tobytes()))
    return pa.table([list(c) for c in zip(*out, strict=True)] or [[] for _ in schema], schema=schema)


class SuffixIndex:
    """The sorted suffixes of word sequences, compared by their first FACTOR words, and ranks that tell how much two share."""

    def __init__(self, words: np.ndarray, piece: np.ndarray, rest: np.ndarray):
        """words of all sequences one after another, the sequence of each, and how many words it has from each on."""
        n = len(words)
        self.rest, at = rest, np.arange(n)
        rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
        self.levels, width = [rank.astype(np.int32)], 1
        while width < FACTOR:
            nxt = np.where(rest > width, rank[np.minimum(at + width, n - 1)], 0) if n else rank
            rank = np.unique(rank * (n + 1) + nxt, return_inverse=True)[1].astype(np.int64) + 1
            self.levels.append(rank.astype(np.int32))
            width *= 2
        self.order = np.argsort(rank, kind="stable")

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at a and at b have in common, up to FACTOR; -1 is no suffix."""
        total = np.zeros(len(a), np.int64)
        some = np.flatnonzero((a >= 0) & (b >= 0))
        x, y, length = a[some].copy(), b[some].copy(), np.zeros(len(some), np.int64)
        most = np.minimum(np.minimum(self.rest[x], self.rest[y]), FACTOR)
        for k in range(len(self.levels) - 1, -1, -1):
            same = (length < most) & (self.levels[k][np.minimum(x, len(self.rest) - 1)] == self.levels[k][np.minimum(y, len(self.rest) - 1)])
            x, y, length = x + (same << k), y + (same << k), length + (same << k)
        total[some] = np.minimum(length, most)
        return total

    def nearest_earlier(self, time: np.ndarray, usable: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each asked position the next usable one before and after it in sorted order whose time is less; -1 if there is none."""
        n = len(self.order)
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        value = np.where(usable, time, LAST)[self.order]
        out = []
        for turned in (False, True):
            row = value[::-1] if turned else value
            tables = [row]  # least time of 2^k entries that end here
            while (1 << len(tables)) <= n:
                last, step = tables[-1], 1 << (len(tables) - 1)
                grown = last.copy()
                grown[step:] = np.minimum(last[step:], last[:-step])
                tables.append(grown)
            end = (n - 1 - place[asked] if turned else place[asked]) - 1  # the last entry that may be it
            own = time[asked]
            for k in range(len(tables) - 1, -1, -1):
                skip = (end >= 0) & (tables[k][np.maximum(end, 0)] >= own)
                end = np.where(skip, end - (1 << k), end)
            ok = end >= 0
            spot = np.maximum(end, 0)
            out.append(np.where(ok, self.order[n - 1 - spot if turned else spot], -1))
        return out[0], out[1]


def _factors(table: pa.Table, span: int) -> pa.Table:
    """Parses the pieces of the group against its sources: (home, id, h, begin, end, source_id, source_start) of each factor, for each place of a piece."""
    schema = pa.schema([("home", pa.int32()), ("id", pa.int64()), ("h", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("source_id", pa.int64()), ("source_begin", pa.int32())])
    is_source = table["is_source"].to_numpy(zero_copy_only=False).astype(bool)
    if is_source.all() or not is_source.any():
        return schema.empty_table()
    parts = [_long_words(x) for x in table["words"].to_pylist()]
    size = np.array([len(p) for p in parts])
    words, piece = np.concatenate(parts), np.repeat(np.arange(len(parts)), size)
    begin = np.cumsum(size) - size
    offset = np.arange(len(words)) - begin[piece]
    ids, h, first = (table[c].to_numpy() for c in ("id", "h", "start"))
    order = np.lexsort((first[piece] + offset, h[piece], ids[piece]))
    time = np.empty(len(words), np.int64)
    spot = [x[order] for x in (ids[piece], h[piece], first[piece] + offset)]
    time[order] = np.concatenate([[0], np.cumsum((spot[0][1:] != spot[0][:-1]) | (spot[1][1:] != spot[1][:-1]) | (spot[2][1:] != spot[2][:-1]))])
    index = SuffixIndex(words, piece, size[piece] - offset)
    asked = np.flatnonzero(~is_source[piece] & (index.rest >= span))
    left, right = index.nearest_earlier(time, is_source[piece], asked)
    near, far = index.shared(asked, left), index.shared(asked, right)
    match, source = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    match[asked], source[asked] = np.maximum(near, far), np.where(near >= far, left, right)
    at, end, found = begin[~is_source], (begin + size)[~is_source] - span, []
    while len(at):  # all pieces side by side, a step each
        length = match[at]
        long = length >= span
        found.append(np.column_stack([at[long], length[long]]))
        at = at + np.where(long, length - span + 1, 1)
        at, end = at[at <= end], end[at <= end]
    found = np.concatenate(found)
    of, src = piece[found[:, 0]], source[found[:, 0]]
    places = {k: np.frombuffer(x, np.int64).reshape(-1, 3) for k, x in enumerate(table["places"].to_pylist()) if len(x)}
    counts = np.array([len(places[k]) for k in of], np.int64)
    where = np.concatenate([places[k] for k in of]) if len(of) else np.zeros((0, 3), np.int64)
    factor = np.repeat(np.arange(len(of)), counts)
    starts = where[:, 2] + offset[found[factor, 0]]
    columns = [table["home"].to_numpy()[of[factor]], where[:, 0], where[:, 1].astype(np.int32), starts.astype(np.int32), (starts + found[factor, 1]).astype(np.int32), ids[piece[src[factor]]], (first[piece] + offset)[src[factor]].astype(np.int32)]
    return pa.table(columns, schema=schema)


def merged(begin: np.ndarray, end: np.ndarray) -> list[int]:
    """Begins and ends of the union of spans, one after another; spans that touch are one."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return np.column_stack([begin[head], reach[np.append(head[1:], len(begin)) - 1]]).ravel().tolist()


def _cut(docs: pa.Table, factors: pa.Table, digest: bool) -> pa.Table:
    """Each document without the words of its factors."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int32()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("kept", pa.string())])
    if not docs.num_rows:
        return schema.empty_table()
    ids, h = _keys(docs)
    fid, fh, fbegin, fend = (factors[c].to_numpy() for c in ("id", "h", "begin", "end"))
    order = np.lexsort((fh, fid))
    fid, fh, fbegin, fend = fid[order], fh[order], fbegin[order], fend[order]
    new = np.ones(len(fid), bool)
    new[1:] = (fid[1:] != fid[:-1]) | (fh[1:] != fh[:-1])
    head = np.flatnonzero(new)
    own = {(i, k): (a, b) for i, k, a, b in zip(fid[head].tolist(), fh[head].tolist(), head.tolist(), np.append(head[1:], len(fid)).tolist(), strict=False)}
    counts, spans, kept = [], [], []
    for i, k, text in zip(ids.tolist(), h.tolist(), docs["text"].to_pylist(), strict=True):
        words = (text or "").encode().split()
        counts.append(len(words))
        mine = []
        if (i, k) in own:
            a, b = own[(i, k)]
            mine = merged(fbegin[a:b], fend[a:b])
            edge = [0, *mine, len(words)]
            words = [w for a, b in zip(edge[::2], edge[1::2], strict=True) for w in words[a:b]]
        spans.append(mine)
        text = b" ".join(words)
        kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
    return pa.table([docs["doc_id"], docs["h"], counts, spans, kept], schema=schema)


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The texts with their blocks, and the number of blocks."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("h"), F.col(text_col).alias("text"))
    blocks = max(1, math.ceil(total_bytes(docs, text_col) / BLOCK_BYTES))
    return with_block(narrow, blocks, "doc_id", "h"), blocks


def _factored(dealt: DataFrame, blocks: int, span: int) -> DataFrame:
    """(home, id, h, begin, end, source_id, source_begin) of all factors."""
    by_block = dealt.groupBy("block")
    anchors = by_block.applyInArrow(lambda t: _send_anchors(t, span), "block int, anchor long, twice boolean")
    same = Window.partitionBy("anchor")
    known = anchors.select("block", "anchor", (F.count("*").over(same) > 1).alias("many"), F.max("twice").over(same).alias("again")).where("many OR again").select("block", "anchor")
    windows = by_block.cogroup(known.groupBy("block")).applyInArrow(lambda d, a: _send_windows(d, a, span), "hash long, block int, id long, place long, twice boolean")
    same = Window.partitionBy("hash")
    first = F.min(F.struct("id", "place", "block")).over(same)
    placed = windows.select("hash", "block", first.alias("first"), F.count("*").over(same).alias("n"), F.max("twice").over(same).alias("again")).where("n > 1 OR again")
    placed = placed.select("block", "hash", F.col("first.block").alias("source"))
    known = placed.mapInArrow(_pack, "block int, hashes binary, sources binary")
    pieces = by_block.cogroup(known.groupBy("block")).applyInArrow(lambda d, s: _send_pieces(d, s, span), PIECE)
    # how many tasks share the pieces of a reference block; both uses of known read the exchange of windows once
    shares = known.mapInArrow(_count_sources, "source int, n long").groupBy("source").agg(F.ceil(F.sum("n") / PARSED).cast("int").alias("parts"))
    pieces = pieces.join(broadcast_up_to(shares, blocks), "source")  # a row for each block at most
    part = F.when(F.col("is_source"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("home", "id", "start"), F.col("parts")).cast("int")))
    return pieces.withColumn("part", F.explode(part)).repartition("source", "part").groupBy("source", "part").applyInArrow(lambda t: _factors(t, span), "home int, id long, h int, begin int, end int, source_id long, source_begin int")


def factors(docs: DataFrame, span: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, begin, end, source_id, source_begin): the factors of at least span words that occur earlier too, and where."""
    found = _factored(*_dealt(docs, id_col, text_col), span)
    known = lambda c: F.when(F.col(c) < LAST, F.col(c))
    return found.select(known("id").alias("doc_id"), "h", "begin", "end", known("source_id").alias("source_id"), "source_begin")


def duplicate_spans(docs: DataFrame, span: int = 20, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, h, n_words, spans, kept) for each row: spans are begin and end word of each removed span, one after another; kept is the rest, or its SHA-256 with digest."""
    dealt, blocks = _dealt(docs, id_col, text_col)
    found = _factored(dealt, blocks, span).select("home", "id", "h", "begin", "end")
    return dealt.groupBy("block").cogroup(found.groupBy("home")).applyInArrow(lambda d, f: _cut(d, f, digest), "doc_id long, h int, n_words long, spans array<int>, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    parsed = duplicate_spans(load(spark, sf_dir, "documents"), digest=True)
    removed = F.expr("aggregate(spans, 0L, (a, x) -> x - a)")  # end - begin + end - begin ..., folded from the left
    return parsed.select("doc_id", "n_words", removed.alias("n_removed"), F.col("kept").alias("kept_sha256"))
