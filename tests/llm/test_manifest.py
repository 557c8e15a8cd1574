"""The manifest against plain recursion, with bands of every height, and what tampering breaks."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandframe.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, lo long, n long, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def climb(levels, k):
    """(sibling or None, whether it stands left) for each level."""
    way = []
    for nodes in levels[:-1]:
        s = k ^ 1
        way.append((nodes[s] if s < len(nodes) else None, s < k))
        k //= 2
    return way


def expected(rows):
    trees = {}
    for i, t, lang, source, n in rows:
        trees.setdefault(lang, []).append((i is not None, i or 0, leaf(i, source, lang, n, t), (i, t, lang, source, n)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: levels_of([r[2] for r in sorted(trees[x], key=lambda r: r[:3])]) for x in names}
    top = levels_of([built[x][-1][0] for x in names])
    out = []
    for place, x in enumerate(names):
        for k, (_, _, own, (i, t, lang, source, n)) in enumerate(sorted(trees[x], key=lambda r: r[:3])):
            way = climb(built[x], k) + climb(top, place)
            hit = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
            d = leaf(i, source, lang, n + 1, t) if hit else own
            for s, left in way:
                d = sha(d) if s is None else sha(s, d) if left else sha(d, s)
            out.append((i, own, built[x][-1][0], top[-1][0], sha(*(s for s, _ in way if s)), d, d == top[-1][0]))
    return out


def documents():
    rng = random.Random(8)
    rows = [(i, rng.choice([None, "", "text", "Ünï\ncode " * 50]), rng.choice([None, "", "en", "en", "en", "é", "z", "Z"]), rng.choice([None, "s"]), rng.choice([None, 3, 40])) for i in range(150)]
    rows += [rows[0], rows[7], (None, "x", "en", "s", 1), (None, "x", "en", "s", 1), (None, None, None, None, None), (5000, "alone", "only", "s", 5), (3, "other text", "en", "s", 1), (9000, "long " * 100_000, "en", "s", 2**62)]
    return rows


@pytest.mark.parametrize("levels", [1, 3, 12])
def test_manifest(spark, levels):
    rows = documents()
    df = spark.createDataFrame([(*r, "t", "d", 1, 2, "p") for r in rows], SCHEMA).repartition(5)
    got = manifest.manifest(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(map(repr, r))
    got = sorted(map(tuple, got.collect()), key=key)
    assert got == sorted(expected(rows), key=key)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few(spark, n):
    rows = [(i, "t", None, None, 1) for i in range(n)]
    df = spark.createDataFrame([(*r, "t", "d", 1, 2, "p") for r in rows], SCHEMA)
    got = manifest.manifest(df, F.lit(False)).collect()
    assert sorted(map(tuple, got)) == sorted(expected(rows)) and all(r.verified for r in got)


def test_many_langs(spark):
    """More langs than a band of their tree holds."""
    rows = [(i, f"t{i}", f"l{i % 40}", "s", i) for i in range(90)]
    df = spark.createDataFrame([(*r, "t", "d", 1, 2, "p") for r in rows], SCHEMA)
    got = manifest.manifest(df, F.col("doc_id") == 11, levels=2)
    assert got.where("not verified").select("doc_id").collect() == [(11,)]
    want = {r[0]: r[:5] for r in expected(rows)}
    assert all(tuple(r)[:5] == want[r.doc_id] for r in got.collect())
