"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

A document is its ids from a public tokenizer, then END. Documents longer than CAPACITY are cut into pieces of that
size; the rest is what a sequence may hold beside others. Pieces are numbered once, written, and dealt by a hash of the
number into blocks of about BLOCK. Each block is one packing problem, on ISLANDS islands. An island is a row with the
block's sizes and a population of groupings, bred independently:

* the first groupings are best-fit decreasing, of the sizes themselves and of sizes with noise;
* crossover injects some of one parent's well-filled bins whole into the other, takes away the other's bins that share
  a piece with them, and puts the displaced pieces back by best fit, largest first; mutation empties the worst bins;
* fewer bins win, then the larger sum of squared fills (so the free room gathers in few bins).

After each epoch the islands are written, and each gets the elite of the island before it (a join of rows of one
block). An island whose best meets the lower bound breeds no more. The best grouping of a block is kept but for its
least filled bins (one of RELEASED, at least one): their pieces go round again with those of other blocks, until one block
holds the rest, so free room is left in the last block's bins, not in one bin of every block. Every step is a hash
shuffle of numbers and sizes; no task holds more than a block, whatever the ties or copies.

Defined cases: a null text is empty, and an empty text is a lone END; rows that share a doc_id, or are null there, are
documents of their own; a piece of exactly CAPACITY is a sequence alone; other columns don't matter; an empty table
gives an empty result. The same table in the same partitions gives the same packing; another split of it may number
pieces differently, and so pack them differently.
"""

from __future__ import annotations

import math
import zlib
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, pieces, small_batches, written
from .subwords import spread

CAPACITY, END = 4096, 1
#: Pieces of a packing problem; islands of each, epochs between migrations, groupings of an island, children of an epoch.
BLOCK, ISLANDS, EPOCHS, POPULATION, CHILDREN = 8192, 2, 3, 20, 60
#: One bin of so many goes round again, and one in so many of a parent's bins is injected.
RELEASED, INJECTED = 64, 4
#: Distinct words whose ids a worker keeps.
CACHED, LONGEST = 400_000, 256
#: A special token's text can't be cut; texts with its first characters are encoded whole.
_SPECIAL, _GAP = "<|", "<|startoftext|>"
#: The tokenizer parts letters from any ASCII character that is neither letter nor white space.
_CUT = r"([a-z])([.,;:!?()\"/-])"

_cache: dict[str, bytes] = {}
_tokenizers: dict = {}


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer(content: str):
    """The tokenizer, once a worker."""
    if content not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers.clear()
        _cache.clear()
        _tokenizers[content] = Tokenizer.from_str(content)
    return _tokenizers[content]


def _learn_words(tok, words: list[str]) -> list[bytes]:
    """The ids of words without white space, as 16-bit numbers. Words of ASCII letters need only the merges; others share calls, parted by a special token."""
    if len(_cache) + len(words) > CACHED:
        _cache.clear()
    out, rest, model = [_cache.get(w) for w in words], [], tok.model
    for i, (w, known) in enumerate(zip(words, out, strict=True)):
        if known is not None:
            continue
        if w.isascii() and w.isalpha():
            out[i] = array("H", [t.id for t in model.tokenize(w)]).tobytes()
            if len(w) <= LONGEST:
                _cache[w] = out[i]
        else:
            rest.append(i)
    gap = tok.token_to_id(_GAP)
    for at in range(0, len(rest), 4096):
        some = rest[at : at + 4096]
        groups = [some[i : i + 64] for i in range(0, len(some), 64)]
        for group, e in zip(groups, tok.encode_batch_fast([_GAP.join(words[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint16)
            raw, at = ids.tobytes(), (2 * np.flatnonzero(ids == gap)).tolist()
            for i, start, end in zip(group, [0, *(x + 2 for x in at)], [*at, len(raw)], strict=True):
                out[i] = raw[start:end]
                if len(words[i]) <= LONGEST:
                    _cache[words[i]] = out[i]
    return out


def encode(tok, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, END after each, and how many each has."""
    texts = pc.fill_null(texts, "")
    whole = pc.match_substring(texts, _SPECIAL).to_numpy(zero_copy_only=False)
    plain = pc.ascii_lower(pc.if_else(pa.array(whole), "", texts))
    words = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, _CUT, "\\1 \\2"))
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    known = _learn_words(tok, coded.dictionary.to_pylist())
    begin = np.zeros(len(known) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, known), np.int64, len(known)) // 2, out=begin[1:])
    stream, size = spread(np.frombuffer(b"".join(known), np.uint16), begin, coded.indices.to_numpy())
    per = np.bincount(np.repeat(np.arange(len(texts)), counts), weights=size, minlength=len(texts)).astype(np.int64)
    ends = np.cumsum(per)
    if not whole.any():
        return np.insert(stream, ends, END), per + 1
    out, sizes = [], []
    for i, w in enumerate(whole):
        own = np.array(tok.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint16) if w else stream[ends[i] - per[i] : ends[i]]
        out += [own, np.array([END], np.uint16)]
        sizes.append(len(own) + 1)
    return np.concatenate(out), np.array(sizes, np.int64)


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(batches, content, capacity: int):
    """Batches of (doc_id, text) to rows of PIECE."""
    tok = tokenizer(content.value)
    for batch in batches:
        for part in pieces(batch, "text"):
            ids, sizes = encode(tok, part.column("text"))
            raw, ends = ids.astype("<u4"), np.cumsum(sizes)
            n = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            at = (ends - sizes)[doc] + start
            crc = [zlib.crc32(raw[a : a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], schema=PIECE)


# --- one packing problem; a grouping is the bin of each piece ---------------------------------------------------------


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """No grouping has fewer bins: pieces above capacity - t can't be with any of t and more, for each t up to half the capacity."""
    s = np.sort(sizes)
    total = np.concatenate([[0], np.cumsum(s)])
    t = np.unique(np.concatenate([[0], s[2 * s <= capacity]]))
    big, half, small = (np.searchsorted(s, capacity - t, "right"), np.searchsorted(2 * s, capacity, "right"), np.searchsorted(s, t, "left"))
    alone, middle = len(s) - big, big - half
    over = total[half] - total[small] - (middle * capacity - (total[big] - total[half]))
    return int((alone + middle + np.maximum(0, -(-over // capacity))).max()) if len(s) else 0


def best_fit(order: np.ndarray, sizes: list[int], bins: np.ndarray, free: list[int], capacity: int) -> None:
    """Puts the pieces, in order, each into the fullest bin that it fits in, or a new one. Changes bins and free."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has r free
    for b, r in enumerate(free):
        if r:
            room[r].append(b)
            mask |= 1 << r
    for i in order.tolist():
        s = sizes[i]
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(free)
            free.append(capacity)
        bins[i] = b
        free[b] = r = r - s
        if r:
            room[r].append(b)
            mask |= 1 << r


def decreasing(sizes: np.ndarray, capacity: int, rng=None) -> np.ndarray:
    bins = np.empty(len(sizes), np.int32)
    weight = sizes if rng is None else sizes * (1 + 2 * rng.random(len(sizes)))
    best_fit(np.argsort(-weight, kind="stable"), sizes.tolist(), bins, [], capacity)
    return bins


def fitness(sizes: np.ndarray, bins: np.ndarray) -> tuple[int, float]:
    """Less is better."""
    fill = np.bincount(bins, weights=sizes)
    return int((fill > 0).sum()), -float((fill**2).sum())


def _refilled(sizes: np.ndarray, bins: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """The grouping with the loose pieces taken out, empty bins closed up, and the loose ones put back by best fit."""
    out = np.full(len(sizes), -1, np.int32)
    held, out[~loose] = np.unique(bins[~loose], return_inverse=True)
    free = (capacity - np.bincount(out[~loose], weights=sizes[~loose], minlength=len(held))).astype(int).tolist()
    again = np.flatnonzero(loose)
    best_fit(again[np.argsort(-sizes[again], kind="stable")], sizes.tolist(), out, free, capacity)
    return out


def crossover(sizes: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Some of the father's well-filled bins, whole, in the mother's grouping."""
    fill = np.bincount(father, weights=sizes)
    well = np.flatnonzero(fill >= np.median(fill[fill > 0]))
    chosen = rng.choice(well, min(len(well), 1 + len(fill) // INJECTED), replace=False)
    given = np.isin(father, chosen)
    broken = np.isin(mother, np.unique(mother[given]))
    bins = np.where(given, len(mother) + father, mother)  # numbers that the mother has not
    return _refilled(sizes, bins, broken & ~given, capacity)


def mutation(sizes: np.ndarray, bins: np.ndarray, capacity: int, rng) -> np.ndarray:
    """The worst bins and some others are emptied."""
    fill = np.bincount(bins, weights=sizes)
    fill[fill == 0] = capacity
    n = 1 + len(fill) // 50
    emptied = np.concatenate([np.argsort(fill, kind="stable")[:n], rng.integers(0, len(fill), n)])
    return _refilled(sizes, bins, np.isin(bins, emptied), capacity)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, seed: tuple, children: int = CHILDREN, size: int = POPULATION) -> list[np.ndarray]:
    """The population after some children, best first; it stops at the lower bound."""
    rng, least = np.random.default_rng(seed), least_bins(sizes, capacity)
    while len(population) < size and not (population and fitness(sizes, population[0])[0] <= least):
        population.append(decreasing(sizes, capacity, rng))
    ranked = sorted(((fitness(sizes, b), i, b) for i, b in enumerate(population)), key=lambda r: r[:2])
    for child in range(children):
        if ranked[0][0][0] <= least:
            break
        a, b = (min(rng.integers(0, len(ranked), 2)) for _ in range(2))  # of two at random the better
        new = crossover(sizes, ranked[a][2], ranked[b][2], capacity, rng) if a != b else mutation(sizes, ranked[a][2], capacity, rng)
        fit = fitness(sizes, new)
        if fit not in [r[0] for r in ranked]:  # no copies in a population
            ranked = sorted([*ranked, (fit, size + child, new)], key=lambda r: r[:2])[:size]
    return [b for _, _, b in ranked]


# --- blocks and islands on Spark ----------------------------------------------------------------------------------------

STATE = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("done", pa.bool_()), ("bins", pa.int32()), ("squares", pa.float64()), ("population", pa.list_(pa.binary()))])
STATE_DDL = "block long, island int, keys array<long>, sizes array<int>, done boolean, bins int, squares double, population array<binary>"
PLACED = pa.schema([("key", pa.int64()), ("length", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("kept", pa.bool_())])
PLACED_DDL = "key long, length int, sequence_id long, offset long, kept boolean"


def _island(block: int, island: int, keys: list, sizes: list, population: list, capacity: int, epoch: int) -> dict:
    s = np.array(sizes, np.int64)
    after = evolve(s, population, capacity, (block, island, epoch))
    bins, squares = fitness(s, after[0])
    return {"block": block, "island": island, "keys": keys, "sizes": sizes, "done": bins <= least_bins(s, capacity), "bins": bins, "squares": squares, "population": [b.astype("<i4").tobytes() for b in after]}


def _settle(key: tuple, table: pa.Table, capacity: int, islands: int) -> pa.Table:
    """A block's pieces to its islands after their first epoch; no second island where the first meets the bound."""
    table = table.sort_by("key")
    keys, sizes = table["key"].to_pylist(), table["length"].to_pylist()
    block, rows = key[0].as_py(), []
    for island in range(islands):
        first = [] if island else [decreasing(np.array(sizes, np.int64), capacity)]
        rows.append(_island(block, island, keys, sizes, first, capacity, 0))
        if rows[-1]["done"]:
            break
    return pa.Table.from_pylist(rows, schema=STATE)


def _epoch(batches, capacity: int, epoch: int):
    """Islands after another epoch, each with the elite of the one before it as a guest in place of its own last."""
    for batch in batches:
        rows = batch.to_pylist()
        for i, r in enumerate(rows):
            guests = r.pop("guests") or []
            if not r["done"]:
                own = r["population"][: max(1, POPULATION - len(guests))]
                population = [np.frombuffer(b, "<i4").astype(np.int32) for b in own + [g for g in guests if g not in own]]
                rows[i] = _island(r["block"], r["island"], r["keys"], r["sizes"], population, capacity, epoch)
        yield from pa.Table.from_pylist(rows, schema=STATE).to_batches()


def _placed(batches, capacity: int, last: bool):
    """The best island of each block to a row for each piece: its sequence (the least key there), its offset, and whether the bin is kept."""
    for batch in batches:
        for row in batch.to_pylist():
            keys, sizes, bins = np.array(row["keys"], np.int64), np.array(row["sizes"], np.int64), np.frombuffer(row["grouping"], "<i4")
            order = np.lexsort((keys, bins))
            new = np.diff(bins[order], prepend=-1) != 0
            first, which = np.flatnonzero(new), np.cumsum(new) - 1
            before = np.cumsum(sizes[order]) - sizes[order]
            fill = np.add.reduceat(sizes[order], first)
            kept = np.ones(len(first), bool)
            if not last:
                weak = np.argsort(fill, kind="stable")[: max(1, len(first) // RELEASED)]
                kept[weak[fill[weak] < capacity]] = False
            yield pa.RecordBatch.from_arrays([pa.array(keys[order]), pa.array(sizes[order].astype(np.int32)), pa.array(keys[order][first][which]), pa.array(before - before[first][which]), pa.array(kept[which])], schema=PLACED)


def grouped(loose: DataFrame, n: int, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> list[DataFrame]:
    """Tables (key, sequence_id, offset) that together place each of the n rows (key, length) of loose; keys are unique, lengths below capacity."""
    out, turn = [], 0
    while n:
        blocks = math.ceil(n / block)
        dealt = loose.select("key", "length", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(blocks)).alias("block"))
        states = written(dealt.groupBy("block").applyInArrow(lambda k, t: _settle(k, t, capacity, islands), STATE_DDL))
        for epoch in range(1, epochs):
            if states.where("not done").isEmpty():
                break
            guests = states.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("population", 1, 1).alias("guests"))
            states = written(states.join(guests, ["block", "island"], "left").mapInArrow(partial(_epoch, capacity=capacity, epoch=epoch), STATE_DDL))
        elite = F.min_by(F.struct("keys", "sizes", F.col("population")[0].alias("grouping")), F.struct("bins", "squares", "island"))
        best = states.groupBy("block").agg(elite.alias("elite")).select("elite.*")
        placed = written(best.mapInArrow(partial(_placed, capacity=capacity, last=blocks == 1), PLACED_DDL))
        out.append(placed.where("kept").select("key", "sequence_id", "offset"))
        loose, turn = placed.where("not kept").select("key", "length"), turn + 1
        n = 0 if blocks == 1 else loose.count()
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece. how: block, islands and epochs of grouped()."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path or tokenizer_file(), encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = texts.mapInArrow(partial(_cut, content=content, capacity=capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    numbered = written(cut.withColumn("key", F.monotonically_increasing_id()))
    loose = numbered.where(F.col("length") < capacity).select("key", F.col("length").cast("int").alias("length"))
    full = numbered.where(F.col("length") == capacity).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = full
    for part in grouped(loose, loose.count(), capacity, **how):
        places = places.unionByName(part)
    return numbered.join(places, "key").drop("key")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
