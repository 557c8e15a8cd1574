"""Packing: ids against the tokenizer itself, groupings against exhaustive search, the genetic operators, islands on Spark."""

import collections
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandframe.llm import packing

SCHEMA = "doc_id long, text string, key string, length string, piece string, block long"
ODD = [None, "", " \n\t ", "Hello, World! It's 12 o'clock; they'VE (said) \"no\".", "É́te éte̸ naïve STRASSE ſtart İx Kelvin Σίσυφος ΣΑΣ.", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "a<|b 'sabc' ('s x.'t", "x" * 9000, "one " * 5000, "日本語、テスト。   nbsp em", "tail.\x00nul \x85 next", "a.b,c;d:e!f?g(h)i\"j/k-l_m"]


def tokens(text, tok):
    return tok.encode(text or "", add_special_tokens=False).ids + [packing.END]


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_file())


def test_ids(tok):
    rng = random.Random(1)
    letters = "ab'.,sS tT19é́Éß(!)-\n<|"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    ids, sizes = packing.encode(packing.tokenizer(open(packing.tokenizer_file(), encoding="utf-8").read()), pa.array(texts))
    at = 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == tokens(t, tok), t
        at += n
    assert at == len(ids)


def test_words_kept_as_bytes(tok):
    """Ids of words are bytes, whether learned, kept or too long to keep, and those of the tokenizer."""
    own = packing.tokenizer(open(packing.tokenizer_file(), encoding="utf-8").read())
    words = ["token", "é", "x1", "é" * 300, "z" * 300, ",", "naïve", *(f"{i}é" for i in range(70))]
    for _ in range(2):
        assert packing._learn_words(own, words) == [np.array(tok.encode(w, add_special_tokens=False).ids, np.uint16).tobytes() for w in words]
    assert {"token", "é", "69é"} <= set(packing._cache) and not {"é" * 300, "z" * 300} & set(packing._cache)


def check(rows, docs, tok, capacity):
    """Each document's pieces cover its ids once; sequences are gapless and within capacity. Returns the number of sequences."""
    want = collections.Counter()
    for i, t in docs:
        ids = tokens(t, tok)
        for p, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want[i, p, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("how", [{}, {"block": 40, "islands": 3, "epochs": 3}])
def test_pack(spark, tok, how):
    rng = random.Random(2)
    texts = ODD + ["copy of this text"] * 40 + [" ".join(rng.choice(["word", "other", "x1"]) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    docs = [(None if i % 17 == 5 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "k", "l", "p", 3) for i, t in docs], SCHEMA).repartition(3)
    rows = packing.pack(df, capacity=256, **how).collect()
    n = check(rows, docs, tok, 256)
    assert n <= 1.03 * sum(r.length for r in rows) / 256 + 2  # small blocks leave room in more bins


def test_pack_empty(spark):
    got = packing.pack(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.isEmpty()


def fewest(sizes, capacity):
    """Exhaustive search."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity:
                place(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_optimum():
    rng = random.Random(3)
    for case in range(40):
        sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 10))), reverse=True)
        least = fewest(sizes, 100)
        s = np.array(sizes)
        assert packing.least_bins(s, 100) <= least
        assert packing.fitness(s, packing.evolve(s, [], 100, (case, 0, 0), children=60)[0])[0] == least


def triplets(n, seed):
    """3 n sizes that fill n bins of 1000 exactly, where best fit alone wastes room."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = rng.randint(380, 490)
        b = rng.randint((1000 - a) // 2 - 40, (1000 - a) // 2)
        out += [a, b, 1000 - a - b]
    rng.shuffle(out)
    return np.array(out)


def test_genetic_search_beats_best_fit():
    for seed in range(3):
        s = triplets(60, seed)
        greedy = packing.decreasing(s, 1000)
        population = packing.evolve(s, [greedy], 1000, (seed, 0, 0), children=400)
        assert 60 <= packing.fitness(s, population[0])[0] < packing.fitness(s, greedy)[0]


def test_crossover_keeps_whole_bins():
    s, rng = triplets(30, 9), np.random.default_rng(4)
    mother, father = packing.decreasing(s, 1000, rng), packing.decreasing(s, 1000, rng)
    child = packing.crossover(s, mother, father, 1000, rng)
    fill = np.bincount(child, weights=s)
    assert (child >= 0).all() and fill.max() <= 1000
    whole = {tuple(np.flatnonzero(father == b)) for b in set(father.tolist())}
    assert len(whole & {tuple(np.flatnonzero(child == b)) for b in set(child.tolist())}) >= 1 + 30 // packing.INJECTED


def test_islands_migrate(spark):
    """The elite of island 0 reaches island 1, and hard blocks get better than best fit."""
    s = triplets(60, 7)
    loose = spark.createDataFrame([(i, int(x)) for i, x in enumerate(s)], "key long, length int")
    counts = {}
    for epochs in (1, 3):
        parts = packing.grouped(loose, len(s), 1000, block=1000, islands=2, epochs=epochs)
        rows = list(itertools.chain.from_iterable(p.collect() for p in parts))
        assert len({r.key for r in rows}) == len(rows) == len(s)
        counts[epochs] = len({r.sequence_id for r in rows})
    assert counts[3] <= counts[1] <= packing.fitness(s, packing.decreasing(s, 1000))[0]
    guest = packing.decreasing(s, 1000)
    row = {"block": 0, "island": 1, "keys": list(range(len(s))), "sizes": s.tolist(), "done": False, "bins": 0, "squares": 0.0, "population": [], "guests": [guest.astype("<i4").tobytes()]}
    schema = packing.STATE.append(pa.field("guests", pa.list_(pa.binary())))
    after = next(packing._epoch([pa.RecordBatch.from_pylist([row], schema=schema)], 1000, 1)).to_pylist()[0]
    assert after["bins"] <= packing.fitness(s, guest)[0]
