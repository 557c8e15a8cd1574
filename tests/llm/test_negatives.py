"""Hard negatives against brute force in whole numbers, and the bounds that the search relies on."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id long, vec string, block int, anchor int, windows int"


def relabel():
    return F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def brute(rows, every):
    sound = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        hold = lambda c: math.floor(max(-(2**24), min(2**24, 256 * c)))
        sound.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(map(hold, v))))
    out = []
    for i, label, v in {r for r in sound if r[0] % every == 0}:
        others = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in sound if j != i and len(w) == len(v)]
        for p, pid, _ in sorted(o for o in others if o[2] == label)[:5]:
            fits = sorted(o[:2] for o in others if o[2] != label and 50 * -p <= 100 * -o[0] <= 95 * -p)[:3]
            out += [(i, pid, r + 1, n, -p, -s) for r, (s, n) in enumerate(fits)]
    return sorted(out)


def table(n=260, dim=18):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) + 0.1 * (k % 3) for k in range(dim)], rng.randrange(4)) for i in range(n)]
    rows += [(i, rows[i][1], 3) for i in range(0, 60, 3)]  # copies under another label
    rows += [(n + i, rows[11][1], i % 3) for i in range(40)]  # ties
    rows += [rows[50], rows[51], (100, rows[5][1], 2), (None, rows[0][1], 1), (900, None, 1), (950, rows[1][1], None)]
    rows += [(1000, [0.0] * dim, 1), (1001, [None] * dim, 1), (1002, [float("nan")] * dim, 1), (1003, [float("inf")] * dim, 1), (1050, [], 1), (1051, [], 1), (1052, [], 2)]
    rows += [(1100, [1.0, 2.0, 3.0], 1), (1101, [1.0, 2.0, 2.5], 1), (1102, [1.0, 1.0, 1.0], 2), (1103, [1.0, 1.5, 2.0], 3), (1150, [1e300, 1.0], 1), (1151, [1e300, 2.0], 1), (1152, [5e4, 0.0], 2)]
    return rows


@pytest.mark.parametrize("block", [8192, 37])
def test_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 5 if block == 37 else 16_384)
    rows = table()
    df = spark.createDataFrame([(*r, 1, "v", 2, 3, 4) for r in rows], SCHEMA).repartition(3)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, relabel())
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, got.collect()))
    assert got == brute(rows, 10) and len(got) > 50


def test_empty(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0, relabel()).isEmpty()


def test_bounds_hold_and_narrow():
    rng = np.random.default_rng(2)
    x, y = np.floor(rng.normal(3, 20, (40, 21))), np.floor(rng.normal(3, 20, (50, 21)))
    a, b, width = negatives.Summary(x), negatives.Summary(y), []
    i, j = (k.ravel() for k in np.indices((40, 50)))
    for level in range(len(negatives.SEGMENTS)):
        low, high = negatives.bounds(a, b, level)
        assert (low <= x @ y.T).all() and (x @ y.T <= high).all()
        pairs = negatives.pair_bounds(a, b, i, j, level)
        assert np.allclose(pairs[0], low.ravel()) and np.allclose(pairs[1], high.ravel())
        width.append((high - low).mean())
    assert width == sorted(width, reverse=True)


def test_few_pairs_reach_exact_scores():
    """With vectors around centres, as embeddings are, the summaries settle nearly all pairs."""
    rng = np.random.default_rng(3)
    centres = np.repeat(rng.normal(0, 60, (30, 32)), 2, 1)
    near = lambda n: np.floor(centres[rng.integers(0, 30, n)] + rng.normal(0, 4, (n, 64)))
    a, b = negatives.Summary(near(50)), negatives.Summary(near(3000))
    whole = np.array([[-np.inf]] * 50), np.array([[np.inf]] * 50)
    i, j = negatives.survivors(a, b, np.ones((50, 3000), bool), *whole, 5)
    assert len(i) < 0.1 * 50 * 3000
    score = a.x @ b.x.T
    kept = {(p, q) for p, q in zip(i.tolist(), j.tolist(), strict=True)}
    assert all((p, q) in kept for p in range(50) for q in np.flatnonzero(score[p] >= np.sort(score[p])[-5]))


def test_exact_in_whole_numbers():
    a, b = np.full((1, 64), float(2**24)), np.full((1, 64), float(2**24 - 1))
    assert negatives.exact(a, b, np.array([0]), np.array([0]))[0] == 64 * 2**24 * (2**24 - 1)


def test_many_open_pairs():
    """Where many pairs are open they are scored by one product, exactly, and the k best are found by partition: against a loop, with ties and owners out of order."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(-300, 300, (20, 9)).astype(float), rng.integers(-300, 300, (50, 9)).astype(float)
    for share in (1.0, 0.5, 1 / (2 * negatives.DENSE)):
        i, j = np.nonzero(rng.random((20, 50)) < share)
        assert np.array_equal(negatives.exact(a, b, i, j), [int(a[x] @ b[y]) for x, y in zip(i, j, strict=True)])
    owner, value, ids = rng.integers(0, 6, 200), rng.integers(0, 9, 200), rng.permutation(200)
    for k in (1, 3, 60):
        by = [sorted(((-v, n, at) for at, (o, v, n) in enumerate(zip(owner, value, ids, strict=True)) if o == g)) for g in range(7)]
        assert negatives.kth_best(owner, value.astype(float), 7, k).tolist() == [-float(x[k - 1][0]) if len(x) >= k else -np.inf for x in by]
        assert negatives.best(owner, value, ids, k).tolist() == [at for x in by for _, _, at in x[:k]]
