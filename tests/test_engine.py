"""The interval engine against the fixture scenarios and plain Python definitions."""

import hashlib
import math
import random
import struct
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandframe import Dataset
from strandframe.functions import intervals as I
from strandframe.operators import cover as C
from strandframe.operators import genometric as G
from strandframe.operators import matrix as X
from strandframe.operators import metadata as M
from strandframe.operators import regions as R
from strandframe.operators import stripes
from strandframe.sources import files, schema

SCHEMA = "sample_id long, chrom string, start long, stop long, strand string, x double, y double"
#: Scenarios on chr1, strand *: {sample: rows of start, stop, x, y}.
SCENARIOS = {
    "none": ({0: [(1, 20, 0.2, 0.3), (1, 3, 0.2, 0.7)], 1: [(1, 3, 0.7, 0.2), (5, 94, 0.2, 0.2)]}, {0: [(2, 5, 0.2, 0.3)], 1: [(5, 100, 0.7, 9.9), (4, 70, 0.7, 0.2)], 2: [(50, 101, 0.2, 0.3)]}, 8, 12),
    "ref": ({0: [(1, 7, 1, 1), (1, 3, 2, 2)], 1: [(1, 3, 1, 1), (1, 3, 2, 2)]}, {0: [(2, 5, 1, 1)], 1: [(1, 3, 1, 1), (2, 4, 2, 2)]}, 12, 8),
    "exp": ({0: [(1, 7, 1, 1), (1, 3, 2, 2)]}, {0: [(2, 6, 1, 1), (2, 6, 2, 2), (4, 8, 8, 8), (4, 8, 9, 9), (8, 9, 9, 9)], 1: [(2, 5, 5, 5), (2, 6, 6, 6), (8, 9, 7, 7), (4, 8, 2, 2), (4, 9, 8, 8)]}, 12, 4),
    "both": ({0: [(1, 3, 0.2, 0.3), (1, 3, 0.2, 0.7)], 1: [(1, 3, 0.7, 0.2), (2, 4, 0.2, 0.2)]}, {0: [(1, 3, 0.2, 0.3), (1, 3, 0.2, 0.7)], 1: [(1, 3, 0.7, 0.2), (2, 4, 0.2, 0.2)]}, 16, 8),
    "record": ({0: [(1, 3, 1, 1), (1, 3, 1, 1), (1, 5, 5, 5)]}, {0: [(50, 100, 100, 100)], 1: [(1, 6, 6, 6), (2, 4, 4, 4)]}, 6, 6),
}


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(s, "chr1", a, b, "*", float(x), float(y)) for s, r in rows.items() for a, b, x, y in r], schema)


@pytest.mark.parametrize("name", SCENARIOS)
@pytest.mark.parametrize("size", [3, 1000, I.NESTED])
def test_scenarios(spark, name, size):
    left, right, joined, mapped = SCENARIOS[name]
    r, e = frame(spark, left), frame(spark, right)
    hits = [(s, t, a, b, x, y, u, v) for s, rows in left.items() for a, b, x, y in rows for t, others in right.items() for c, d, u, v in others if a < d and c < b]
    got = [(q.ref_id, q.exp_id, q.start, q.stop, q.x, q.y, q.right_x, q.right_y) for q in G.join(r, e, [G.DistLess(0)], bin_size=size).collect()]
    assert Counter(got) == Counter(hits) and len(got) == joined
    counts = [(s, t, a, b, x, y, sum(a < d and c < b for c, d, _, _ in others)) for s, rows in left.items() for a, b, x, y in rows for t, others in right.items()]
    got = [(q.ref_id, q.exp_id, q.start, q.stop, q.x, q.y, q["count"]) for q in G.map_regions(r, e, M.sample_pairs(r, e), bin_size=size).collect()]
    assert Counter(got) == Counter(counts) and len(got) == mapped
    rows = X.crossed(X.matrix_join(X.to_matrix(r), X.to_matrix(e), bin_size=size), ["cells", "right_cells"])
    assert rows.count() == joined


def random_rows(n, seed, samples=2):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randint(0, 120)
        out.append((rng.randrange(samples), rng.choice(["c1", "c2"]), a, a + rng.randint(1, 25), rng.choice("+-*"), float(rng.randint(0, 3)), 0.0))
    return out


def dist(r, e):
    return max(r[2] - e[3], e[2] - r[3])


def agree(r, e):
    return r[1] == e[1] and (r[4] == "*" or e[4] == "*" or r[4] == e[4])


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_conditions_and_bins(spark, size):
    left, right = random_rows(40, 1), random_rows(50, 2)
    r, e = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    up = lambda a, b: b[2] >= a[3] if a[4] == "-" else b[3] <= a[2]
    cases = [([G.DistLess(-2)], lambda a, b: dist(a, b) < -2), ([G.DistLess(9), G.DistGreater(0)], lambda a, b: 0 < dist(a, b) < 9), ([G.DistLess(15), G.Upstream()], lambda a, b: dist(a, b) < 15 and up(a, b))]
    for conditions, holds in cases:
        want = Counter((a[:5], b[:5]) for a in left for b in right if agree(a, b) and holds(a, b))
        got = G.join(r, e, conditions, "BOTH", bin_size=size).collect()
        assert Counter(((q.ref_id, q.chrom, q.start, q.stop, q.strand), (q.exp_id, q.right_chrom, q.right_start, q.right_stop, q.right_strand)) for q in got) == want
    want = Counter()
    for a in left:
        for s in range(2):
            own = [b for b in right if b[0] == s and agree(a, b)]
            least = sorted({dist(a, b) for b in own})[:2]
            want.update((a[:5], b[:5]) for b in own if dist(a, b) in least and dist(a, b) > 1)
    got = G.join(r, e, [G.MinDistance(2), G.DistGreater(1)], "BOTH", bin_size=max(size, 7)).collect()
    assert Counter(((q.ref_id, q.chrom, q.start, q.stop, q.strand), (q.exp_id, q.right_chrom, q.right_start, q.right_stop, q.right_strand)) for q in got) == want
    gone = [a for a in left if not any(agree(a, b) and a[2] < b[3] and b[2] < a[3] for b in right)]
    assert Counter(map(tuple, G.difference(r, e, bin_size=size).collect())) == Counter(gone)


@pytest.mark.parametrize("stripe", [8, 1 << 22])
def test_cover(spark, monkeypatch, stripe):
    monkeypatch.setattr(C, "STRIPE", stripe)
    rows = random_rows(60, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    for low, high in ((1, 99), (2, 4)):
        want, peaks = [], []
        for c in ("c1", "c2"):
            depth = [sum(r[1] == c and r[2] <= p < r[3] for r in rows) for p in range(160)]
            p = 0
            while p < 159:
                q = p
                if low <= depth[p] <= high:
                    while low <= depth[q] <= high:
                        q += 1
                    want.append((c, p, q, max(depth[p:q])))
                p = max(q, p + 1)
            cuts = [i for i in range(160) if i == 0 or depth[i] != depth[i - 1]]
            runs = [(s, t, depth[s]) for s, t in zip(cuts, cuts[1:] + [160], strict=True)]
            ok = lambda d: 0 < d and low <= d <= high
            for i, (s, t, d) in enumerate(runs):
                b, n = runs[i - 1][2] if i else 0, runs[i + 1][2] if i + 1 < len(runs) else 0
                if ok(d) and ((d > b and (n < d or not ok(n))) or (not ok(b) and n < d)):
                    peaks.append((c, s, t, d))
        key = lambda df: sorted((q.chrom, q.start, q.stop, q.accumulation) for q in df.collect())
        assert key(C.cover(df, "COVER", low, high)) == sorted(want)
        assert key(C.cover(df, "SUMMIT", low, high)) == sorted(peaks)


def test_files_and_metadata(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/S_0.gdm").write_text("chr1\t1\t20\t*\t0.2\tabc\nbroken\n\n#c\nchr2\t5\t9\t-\tnull\tq")
    (tmp_path / "in/S_0.gdm.meta").write_text("cell\tKBM7\nleft.age\t7\n")
    (tmp_path / "in/S_1.gdm").write_text("chr1\t1\t20\t*\t0.2\tabc\n")
    (tmp_path / "in/test.schema").write_text('<c><gmqlSchema type="TAB">' + "".join(f'<field type="{t}">{n}</field>' for n, t in [("chr", "STRING"), ("left", "LONG"), ("right", "LONG"), ("strand", "STRING"), ("x", "DOUBLE"), ("name", "STRING")]) + "</gmqlSchema></c>")
    ds = files.read(spark, f"file://{tmp_path}/in")
    assert sorted(tuple(r)[1:] for r in ds.regions.collect()) == [("chr1", 1, 20, "*", 0.2, "abc"), ("chr2", 5, 9, "-", None, "q")]
    for kind in ("tab", "gtf", "parquet"):
        files.write(ds, f"file://{tmp_path}/{kind}", kind)
        back = files.read_written(spark, f"file://{tmp_path}/{kind}", kind)
        assert {(r.chrom, r.start, r.stop, r.strand, r.x, r["name"]) for r in back.regions.collect()} == {("chr1", 1, 20, "*", 0.2, "abc"), ("chr2", 5, 9, "-", None, "q")}
        assert back.meta.count() == 2
    a = M.attribute
    assert ds.select(meta=(a("age") > 5) & (a("cell") == "kbm7") & a("no").missing()).regions.count() == 2
    assert ds.select(meta=a("age") != 7).regions.count() == 0
    both = ds.union(ds)
    assert both.regions.count() == 4 and both.meta.where("attribute = '_provenance'").count() == 2
    assert ds.join(ds, [G.DistLess(0)]).regions.count() == 2
    assert {r.attribute for r in ds.map(ds).meta.collect()} == {"left.cell", "right.cell", "left.left.age", "right.left.age"}
    with pytest.raises(ValueError):
        Dataset.of(spark.range(1))


def little(data):
    return int.from_bytes(hashlib.md5(data).digest()[:8], "little", signed=True)


def test_shuffled_refs(spark):
    """Refs out of a shuffle, whose partitions differ from one plan to another, under small adaptive partitions."""
    left, right = random_rows(300, 3), random_rows(40, 4)
    r = spark.createDataFrame(left * 2, SCHEMA).repartition(16, "start")
    e = spark.createDataFrame(right, SCHEMA)
    hits = lambda a, s=None: [b for b in right if agree(a, b) and a[2] < b[3] and b[2] < a[3] and s in (None, b[0])]
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1k")
    try:
        gone = G.difference(r, e, bin_size=7)
        assert Counter(map(tuple, gone.collect())) == Counter(a for a in left * 2 if not hits(a)) and gone.count() == sum(not hits(a) for a in left * 2)
        counts = G.map_regions(r, e, M.sample_pairs(r, e), {"total": ("SUM", "x")}, bin_size=7, every=True)
        got = counts.select("ref_id", *X.I.COORDS, "exp_id", "count", "total").collect()
        total = lambda a, s: sum(b[5] for b in hits(a, s)) if hits(a, s) else None
        assert Counter(map(tuple, got)) == Counter((*a[:5], s, len(hits(a, s)), total(a, s)) for a in left * 2 for s in range(2))
        near = G.join(r, e, [G.MinDistance(1)], "BOTH", bin_size=2, horizon=60).collect()
        want = Counter()
        for a in left * 2:
            for s in range(2):
                own = [b for b in right if b[0] == s and agree(a, b) and dist(a, b) <= 60]
                want.update((a[:5], b[:5]) for b in own if dist(a, b) == min(dist(a, c) for c in own))
        assert Counter(((q.ref_id, q.chrom, q.start, q.stop, q.strand), (q.exp_id, q.right_chrom, q.right_start, q.right_stop, q.right_strand)) for q in near) == want
    finally:
        spark.conf.set(key, before)


def test_one_bin_and_half(spark):
    left, right = random_rows(30, 6), random_rows(30, 7)
    r, e = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    shape = lambda df: Counter(map(tuple, df.collect()))
    assert shape(G.map_regions(r, e, M.sample_pairs(r, e), bin_size=0)) == shape(G.map_regions(r, e, M.sample_pairs(r, e), bin_size=5))
    assert shape(G.join(r, e, [G.DistLess(4)], bin_size=0)) == shape(G.join(r, e, [G.DistLess(4)], bin_size=5))
    four = spark.createDataFrame(random_rows(80, 8, 4), SCHEMA)
    assert shape(C.cover(four, "COVER", lambda n: n / 2, lambda n: n + 1)) == shape(C.cover(four, "COVER", 2, 5))


@pytest.mark.parametrize("name", SCENARIOS)
def test_golden_ids(spark, name, tmp_path):
    """Scenarios read from files, with the values of mixed types and the broken lines that such files have; ids are the MD5 of names and of pairs of ids."""
    left, right, joined, mapped = SCENARIOS[name]
    fields = [("chr", "STRING"), ("left", "LONG"), ("right", "LONG"), ("strand", "STRING")]
    for side, rows, mixed in (("ref", left, "a string\t2213\t"), ("exp", right, "")):
        (tmp_path / side).mkdir()
        for k, own in rows.items():
            (tmp_path / side / f"S_{k:05d}.gdm").write_text("\n".join(f"chr1\t{a}\t{b}\t*\t{mixed}{x}\t{y}" for a, b, x, y in own) + ("\n\ta string\t2213\t\n\n" if mixed else "\n"))
            (tmp_path / side / f"S_{k:05d}.gdm.meta").write_text("cell\tKBM7\n")
        more = [("string", "STRING"), ("int", "INTEGER")] if mixed else []
        (tmp_path / side / "test.schema").write_text(f'<{schema.COLLECTION}><{schema.SCHEMA} type="TAB">' + "".join(f'<field type="{t}">{n}</field>' for n, t in [*fields, *more, ("x", "DOUBLE"), ("y", "DOUBLE")]) + f"</{schema.SCHEMA}></{schema.COLLECTION}>")
    r, e = (files.read(spark, f"file://{tmp_path}/{side}") for side in ("ref", "exp"))
    name_id = lambda k: little(f"S_{k:05d}.gdm".encode())
    pair = lambda s, t: little(struct.pack("<qq", name_id(s), name_id(t)))
    hit = lambda a, b, c, d: a < d and c < b
    want = Counter((pair(s, t), a, b, "a string", 2213.0, x, y, sum(hit(a, b, c, d) for c, d, _, _ in others)) for s, rows in left.items() for a, b, x, y in rows for t, others in right.items())
    got = Counter((q.sample_id, q.start, q.stop, q.string, q.int, q.x, q.y, q["count"]) for q in r.map(e, bin_size=3).regions.collect())
    assert got == want and sum(got.values()) == mapped
    want = Counter((pair(s, t), a, b, u, v) for s, rows in left.items() for a, b, _, _ in rows for t, others in right.items() for c, d, u, v in others if hit(a, b, c, d))
    got = Counter((q.sample_id, q.start, q.stop, q.right_x, q.right_y) for q in r.join(e, [G.DistLess(0)], bin_size=3).regions.collect())
    assert got == want and sum(got.values()) == joined
    bad = files.bad_lines(spark, f"file://{tmp_path}/ref").collect()
    assert len(bad) == len(left) and all(q.value == "\ta string\t2213\t" for q in bad)
    with pytest.raises(Exception, match="unreadable line"):
        files.read(spark, f"file://{tmp_path}/ref", strict=True).regions.collect()


def test_formats(spark, tmp_path):
    def lines(*text):
        return spark.createDataFrame([(7, t) for t in text], "sample_id long, value string")

    vcf = schema.from_fields([("id", "STRING"), ("ref", "STRING"), ("qual", "DOUBLE")], "vcf")
    assert [tuple(q) for q in files.parsed(lines("#CHROM", "chr1\t100\trs1\tA\t9.5"), vcf).collect()] == [(7, "chr1", 99, 100, "*", "rs1", "A", 9.5)]
    gtf = schema.from_fields([("chr", "STRING"), ("source", "STRING"), ("feature", "STRING"), ("score", "DOUBLE"), ("gene.id", "STRING"), ("n", "INTEGER")], "gtf")
    row = 'chr1\tsrc\texon\t11\t20\t.\t-\t.\tgene_id "x"; gene.id "G1"; N "4"; other "o";'
    assert [tuple(q) for q in files.parsed(lines(row), gtf).collect()] == [(7, "chr1", 10, 20, "-", "src", "exon", None, "G1", 4.0)]
    assert {q.attribute for q in files.unknown_attributes(lines(row), gtf).collect()} == {"gene_id", "other"}
    cells = ["chr1", "1", "9", "n", "5", "+", "6", "7", "8", "9"]
    for preset, known in schema.PRESETS.items():
        own = cells[:3] + ["+"] + cells[3:] if preset == "rnaseq" else cells if preset != "bedscore" else cells[:3] + ["5"]
        (got,) = files.parsed(lines("\t".join(own)), known).collect()
        assert (got.chrom, got.start, got.stop) == ("chr1", 1, 9) and got.strand == ("*" if known.strand is None else "+"), preset
        assert got.asDict().get("score", 5.0) == 5.0 and len(got) == 5 + len(known.values)
    (tmp_path / "d").mkdir()
    for k in range(2):
        (tmp_path / f"d/a{k}.bed").write_text("chr1\t1\t9\n")
        (tmp_path / f"d/a{k}.bed.meta").write_text(f"k\t{k}\nbroken line\n")
    folder = f"file://{tmp_path}/d"
    assert files.read(spark, folder, "BasicParser").regions.count() == 2
    chosen = files.read(spark, folder, "basic", where=M.attribute("k") == 1)
    assert chosen.regions.inputFiles() == [f"{folder}/a1.bed"] and chosen.meta.count() == 1
    assert files.read(spark, folder, "basic", where=M.attribute("k") == 9).regions.count() == 0
    own = files.read(spark, folder, lambda rows: files.parsed(rows, schema.PRESETS["basic"]).withColumn("one", F.lit(1)))
    assert own.values == ["one"] and [q.one for q in own.collect()[0]] == [1, 1] and own.collect()[2] == ["one"]
    with pytest.raises(Exception, match="unreadable metadata"):
        files.read(spark, folder, "basic", strict=True).meta.collect()
    with pytest.warns(UserWarning, match="unknown parser"), pytest.raises(ValueError, match="no schema"):
        files.read(spark, folder, "nosuch")


def test_order_spreads(spark):
    """Numbers over many powers, and strings with a common prefix, fall into even ranges; nothing is sorted by sample."""
    rows = spark.range(40_000).select(F.lit(0).cast("long").alias("sample_id"), F.lit("c").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 1).alias("stop"), F.lit("*").alias("strand"), F.exp(F.rand(3) * 200).alias("v"), F.concat(F.lit("common"), F.hex(F.hash("id"))).alias("s"))
    for key in ("v", "s"):
        out = R.order(rows, [(key, True)])
        assert out.agg(F.min("order"), F.max("order"), F.count_distinct("order")).first()[:] == (1, 40_000, 40_000)
        spread = [r["count"] for r in rows.repartitionByRange(4, key).groupBy(F.spark_partition_id()).count().collect()]
        assert max(spread) < 2 * sorted(spread)[len(spread) // 2]
        last = Window.orderBy("order")
        assert out.withColumn("p", F.lag(key).over(last)).where(F.col("p") > F.col(key)).count() == 0
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "row_number" not in plan


@pytest.mark.parametrize("ranges", [2, 7])
def test_order(spark, ranges):
    """Nulls and NaN, infinities, strings, ties; in several ranges as in one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        _check_order(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def _check_order(spark):
    rng = random.Random(9)
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, 1e300]
    rows = [(rng.randrange(2), "c", i, i + 1, "*", rng.choice([*odd, rng.uniform(-5, 5)]), rng.choice([None, "", "a", "ab", "\u00e9", "\U0001f600z"])) for i in range(200)]
    df = spark.createDataFrame(rows, "sample_id long, chrom string, start long, stop long, strand string, v double, s string")
    for keys in ([("v", True)], [("v", False)], [("s", True), ("v", False)], [("s", False)]):
        whole = Window.partitionBy("sample_id").orderBy(*(F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_last() for k, up in keys), "start")
        want = {(q.start, q.n) for q in df.withColumn("n", F.row_number().over(whole)).collect()}
        assert {(q.start, q.order) for q in R.order(df, keys).collect()} == want, keys
        half = {(q.start, q.order) for q in R.order(df, keys, percent=50).collect()}
        sizes = Counter(r[0] for r in rows)
        assert half == {(q.start, q.n) for q in df.withColumn("n", F.row_number().over(whole)).collect() if q.n <= sizes[q.sample_id] // 2}
    assert R.order(df.limit(0), [("v", True)]).count() == 0


def test_nested_bins(spark):
    """Lengths of 1 to 10^9 in one table: as with one bin, and few copies of a row."""
    rng = random.Random(12)
    def rows(sample, n):
        out = []
        for _ in range(n):
            a = rng.randint(0, 2_000_000_000)
            out.append((sample, rng.choice("cd"), a, a + rng.randint(0, 10 ** rng.choice([0, 2, 4, 6, 8, 9])), rng.choice("+-*"), float(rng.randint(0, 9))))
        return out
    schema = "sample_id long, chrom string, start long, stop long, strand string, v double"
    a, b = spark.createDataFrame(rows(1, 150), schema), spark.createDataFrame(rows(2, 150) + rows(3, 50), schema)
    for conditions in ([G.DistLess(0)], [G.DistLess(5_000_000)], [G.DistGreater(10), G.DistLess(100_000_000), G.Upstream()]):
        want, got = (Counter(map(tuple, G.join(a, b, conditions, bin_size=size).collect())) for size in (0, I.NESTED))
        assert want == got and want
    pairs = M.sample_pairs(a, b)
    want, got = (Counter(map(tuple, G.map_regions(a, b, pairs, {"m": ("MAX", "v")}, bin_size=size, every=True).collect())) for size in (0, I.NESTED))
    assert want == got
    levels = F.array(*(F.lit(n) for n in range(len(I.SIZES))))
    copies = F.size(I.nested_bins(F.col("start"), F.col("stop"), I.level(F.col("start"), F.col("stop")), levels))
    assert a.unionByName(b).agg(F.max(copies)).first()[0] <= 2 * len(I.SIZES)
    assert G.join(a.limit(0), b, [G.DistLess(0)], bin_size=I.NESTED).count() == G.join(a, b.limit(0), [G.DistLess(0)], bin_size=I.NESTED).count() == 0


def test_pruned_store(spark, tmp_path):
    """Samples prune folders, places go down to the scan, a large sample is several files, and rows are those of a plain filter."""
    schema = "sample_id long, chrom string, start long, stop long, strand string, v double"
    regions = spark.createDataFrame(odd_regions(8, 400, [1, 2, 3]), schema)
    meta = spark.createDataFrame([(s, "cell", "K562" if s != 2 else "HeLa") for s in (1, 2, 3)], "sample_id long, attribute string, value string")
    folder, place = f"file://{tmp_path}/store", lambda r: (r.chrom == "c1") & (r.left >= 50) & (r.left < 200)
    files.write(Dataset(regions, meta), folder)
    got = files.read_written(spark, folder, where=M.attribute("cell") == "K562", region=place)
    want = regions.where("sample_id <> 2 AND chrom = 'c1' AND start >= 50 AND start < 200")
    key = lambda rows, names: Counter(tuple(r[n] for n in names) for r in rows)
    assert key(got.regions.collect(), regions.columns) == key(want.collect(), regions.columns)
    assert {r.sample_id for r in got.meta.collect()} == {1, 3}
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        plan = got.regions.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "dynamicpruning" in plan and "GreaterThanOrEqual(start,50)" in plan and "EqualTo(chrom,c1)" in plan


def test_mixed_values_order(spark):
    """Numbers by value, texts after them, samples without the key first ascending and last descending."""
    meta = spark.createDataFrame([(1, "age", "12"), (2, "age", "abc"), (3, "age", "5"), (4, "sex", "f"), (5, "age", "1e1")], "sample_id long, attribute string, value string")
    for ascending, want in ((True, [4, 3, 5, 1, 2]), (False, [2, 1, 5, 3, 4])):
        got = M.order(meta, [("age", ascending)]).where("attribute = '_order'").select("sample_id", F.col("value").cast("int").alias("n")).collect()
        assert [r.sample_id for r in sorted(got, key=lambda r: r.n)] == want


def test_rows_of_many_operands(spark):
    """A chain of three matrices as rows: one id for each three samples, paired from the left on."""
    from strandframe.functions import ids

    schema = "sample_id long, chrom string, start long, stop long, strand string, v double"
    a, b, c = (spark.createDataFrame([(s, "c", 0, 10, "*", float(s)) for s in samples], schema) for samples in ([1, 2], [3], [4, 5]))
    joined = X.matrix_join(X.matrix_join(X.to_matrix(a), X.to_matrix(b)), X.to_matrix(c), column="third")
    got = X.to_rows_multi(joined, ["cells", "right_cells", "third"]).collect()
    trios = spark.createDataFrame([(x, 3, z) for x in (1, 2) for z in (4, 5)], "a long, b long, c long")
    named = trios.select("a", "c", ids.pair_id(ids.pair_id(F.col("a"), F.col("b")), F.col("c")).alias("id")).collect()
    assert {(r.sample_id, r.cells_value.vals.v, r.third_value.vals.v) for r in got} == {(r.id, float(r.a), float(r.c)) for r in named}
    assert len(got) == 4


def test_folders_and_regions_without_metadata(spark, tmp_path):
    """Files in folders below are read if asked for; regions without a .meta are too, if asked for."""
    (tmp_path / "in/deep").mkdir(parents=True)
    for name in ("A", "deep/B", "C"):
        (tmp_path / f"in/{name}.bed").write_text(f"chr1\t1\t20\t{name[-1]}\n")
        if name != "C":
            (tmp_path / f"in/{name}.bed.meta").write_text("cell\tK562\n")
    assert files.read(spark, f"file://{tmp_path}/in", "basic").regions.count() == 1
    assert files.read(spark, f"file://{tmp_path}/in", "basic", with_meta_only=False).regions.count() == 2
    both = files.read(spark, f"file://{tmp_path}/in", "basic", recursive=True)
    assert both.regions.count() == 2 and both.meta.count() == 2
    assert files.read(spark, f"file://{tmp_path}/in", "basic", recursive=True, with_meta_only=False).regions.count() == 3


# --- sweeps, shared steps, functions of the user's own --------------------------------------------------------------------


def odd_regions(seed, n, samples, wide=300):
    """Regions of all strands with ties, empty ones, copies and nested ones, over several stripes."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        start = rng.choice([rng.randint(0, wide), rng.randint(0, wide) + 50_000_000])
        rows.append((rng.choice(samples), rng.choice(["c1", "c2"]), start, start + rng.choice([0, 0, 1, 5, 40, 200]), rng.choice("+-*"), float(rng.randint(0, 9))))
    return rows + rows[:5]


def strands_fit(a, b):
    return a == "*" or b == "*" or a == b


def holds(c, r, e):
    gap = max(r[2] - e[3], e[2] - r[3])
    up, down = (e[2] >= r[3], e[3] <= r[2]) if r[4] == "-" else (e[3] <= r[2], e[2] >= r[3])
    return gap < c.n if isinstance(c, G.DistLess) else gap > c.n if isinstance(c, G.DistGreater) else up if isinstance(c, G.Upstream) else down


def test_counts_without_pairs(spark):
    a, b = odd_regions(1, 120, [0, 1]), odd_regions(2, 150, [2, 3])
    b += [(2, "c1", 0, 60_000_000, "*", 1.0), (2, "c1", 77, 77, "+", 1.0)]
    a += [(0, "c1", 77, 77, "*", 1.0), (1, None, 5, 9, "+", 1.0), (1, "c3", 5, 9, "+", 1.0)]
    schema = "sample_id long, chrom string, start long, stop long, strand string, v double"
    ref, exp = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for every, chosen in ((True, [(i, j) for i in (0, 1) for j in (2, 3)]), (False, [(0, 2), (1, 2), (1, 3)])):
        pairs = spark.createDataFrame(chosen, "ref_id long, exp_id long")
        out = G.map_regions(ref, exp, pairs, {"again": ("COUNT", "v")}, every=every)
        plan = out._jdf.queryExecution().toString()
        assert "first_shared_bin" not in plan and "sequence(" not in plan
        want = sorted((i, j, str(c), s, e, t, v, *[sum(x[0] == j and x[1] == c and x[2] < e and s < x[3] and strands_fit(t, x[4]) for x in b)] * 2) for i, c, s, e, t, v in a for r, j in chosen if r == i)
        assert sorted((r[0], r[1], str(r[2]), *r[3:]) for r in out.collect()) == want


def test_count_under_many(spark):
    """A region under 100,000 others costs no pairs."""
    exp = spark.range(100_000).select(F.lit(2).cast("long").alias("sample_id"), F.lit("c").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 10_000_000).alias("stop"), F.lit("+").alias("strand"))
    ref = spark.range(200).select(F.lit(1).cast("long").alias("sample_id"), F.lit("c").alias("chrom"), (F.col("id") + 5_000_000).alias("start"), (F.col("id") + 5_000_100).alias("stop"), F.lit("*").alias("strand"))
    out = G.map_regions(ref, exp, spark.createDataFrame([(1, 2)], "ref_id long, exp_id long"), every=True)
    assert out.select("count").distinct().collect() == [(100_000,)]


@pytest.mark.parametrize("reach", [30, 700])
def test_nearest_in_stripes(spark, monkeypatch, reach):
    """Over many stripes, with regions longer than these allow, partners of samples, nulls; and each side is read once if none is long."""
    monkeypatch.setattr(stripes, "STRIPE", 640)
    schema = "sample_id long, chrom string, start long, stop long, strand string, v double"
    a, b = odd_regions(41, 90, [0, 1], 3000), odd_regions(42, 160, [2, 3], 3000)
    b += [(2, "c1", 100, 2500, "*", 1.0), (3, "c2", None, 5, "+", 1.0), (2, None, 5, 9, "+", 1.0), (2, "c2", 5, 9, None, 1.0)]
    a += [(0, "c2", 1, 3, "*", 4.0), (0, None, 5, 9, "+", 1.0), (1, "c1", 5, None, "+", 1.0), (1, "c1", 300, 330, "+", None), (0, "c9", 1, 2, "*", 1.0)]
    ref, exp = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for conditions, chosen in (([G.MinDistance(2)], None), ([G.DistLess(reach), G.MinDistance(1), G.DistGreater(2)], None), ([G.Upstream(), G.MinDistance(1), G.Downstream()], None), ([G.DistGreater(4), G.MinDistance(2), G.Upstream()], [(0, 2), (1, 3)])):
        cut = next(i for i, c in enumerate(conditions) if isinstance(c, G.MinDistance))
        most = reach + (4 if isinstance(conditions[0], G.DistGreater) else 0)
        want = []
        for r in a:
            for j in (2, 3):
                if None in r[1:4] or chosen and (r[0], j) not in chosen:
                    continue
                near = [(max(r[2] - e[3], e[2] - r[3]), e) for e in b if e[0] == j and e[1] == r[1] and e[2] is not None and strands_fit(r[4], e[4])]
                near = [(g, e) for g, e in near if g <= most and all(holds(c, r, e) for c in conditions[:cut])]
                least = sorted({g for g, _ in near})[: conditions[cut].k]
                want += [(r[0], j, *r[1:], *e[1:]) for g, e in near if g in least and all(holds(c, r, e) for c in conditions[cut + 1 :])]
        pairs = chosen and spark.createDataFrame(chosen, "ref_id long, exp_id long")
        out = G.join(ref, exp, conditions, "BOTH", pairs, horizon=reach)
        got = out.select("ref_id", "exp_id", "chrom", "start", "stop", "strand", "v", "right_chrom", "right_start", "right_stop", "right_strand", "right_v").collect()
        assert Counter(map(tuple, got)) == Counter(want), conditions
    out = G.join(ref.where("stop - start < 40"), exp, [G.MinDistance(2)], horizon=reach)
    out.collect()
    assert "MapInArrow" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Window" not in plan.split("Initial Plan")[0]


@pytest.mark.parametrize("conditions", [[G.MinDistance(1)], [G.MinDistance(3)], [G.DistGreater(7), G.MinDistance(2)], [G.Upstream(), G.MinDistance(2)], [G.Downstream(), G.DistLess(500), G.MinDistance(1)], [G.DistGreater(-30), G.MinDistance(2), G.DistLess(40)]])
def test_nearest_by_sweep(spark, conditions):
    a, b = odd_regions(3, 60, [0, 1], 3000), odd_regions(4, 130, [2, 3], 3000)
    schema = "sample_id long, chrom string, start long, stop long, strand string, v double"
    out = G.join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), conditions, "BOTH", horizon=1000)
    cut = next(i for i, c in enumerate(conditions) if isinstance(c, G.MinDistance))

    lower = max([c.n for c in conditions[:cut] if isinstance(c, G.DistGreater)], default=0)
    limits = [c.n for c in conditions[:cut] if isinstance(c, G.DistLess)]
    reach = min(limits) if limits else max(1000, lower + 1000) if lower > 0 else 1000
    want = []
    for r in a:
        for j in (2, 3):
            near = [(max(r[2] - e[3], e[2] - r[3]), e) for e in b if e[0] == j and e[1] == r[1] and strands_fit(r[4], e[4])]
            near = [(g, e) for g, e in near if g <= reach and all(holds(c, r, e) for c in conditions[:cut])]
            least = sorted({g for g, _ in near})[: conditions[cut].k]
            want += [(r[0], j, *r[1:5], r[5], *e[1:5], e[5]) for g, e in near if g in least and all(holds(c, r, e) for c in conditions[cut + 1 :])]
    got = [tuple(x) for x in out.select("ref_id", "exp_id", "chrom", "start", "stop", "strand", "v", "right_chrom", "right_start", "right_stop", "right_strand", "right_v").collect()]
    assert sorted(got) == sorted(want) and want


@pytest.mark.parametrize("stripe", [64, 1 << 20])
def test_extremes_without_pairs(spark, monkeypatch, stripe):
    """Counts, least and greatest of odd regions and values, over stripes and by pairs where ref regions are longer than these allow."""
    monkeypatch.setattr(stripes, "STRIPE", stripe)
    nan, inf = float("nan"), float("inf")
    a, b = odd_regions(51, 80, [0, 1]), odd_regions(52, 100, [2, 3])
    b = [(*r[:5], [None, nan, inf, -0.5, 2.5, 7.0][n % 6] if n % 2 else r[5], None if n % 5 == 0 else n % 7) for n, r in enumerate(b)]
    b += [(2, "c1", 20, 400, "*", None, 3), (3, "c2", 130, 110, "+", 1.5, 9), (2, "c1", 60, 60, "-", nan, None), (2, None, 5, 90, "*", 1.0, 1), (3, "c1", 5, None, "*", 1.0, 1), (3, "c1", 5, 300, None, 8.0, 1)]
    a += [(0, "c1", 60, 60, "*", 1.0), (1, "c2", 100, 140, "+", 1.0), (1, "c2", 128, 115, "*", 1.0), (1, None, 5, 9, "+", 1.0), (0, "c1", None, 9, "+", 1.0), (0, "c9", 1, 9, "+", 1.0), (0, "c1", 10, 90, None, 2.0)]
    ref = spark.createDataFrame(a, "sample_id long, chrom string, start long, stop long, strand string, v double")
    exp = spark.createDataFrame(b, "sample_id long, chrom string, start long, stop long, strand string, w double, i int")
    size = lambda v: (math.isnan(v), v)
    kinds = {"m": ("MAX", "w"), "l": ("min", "w"), "n": ("COUNT_NON_NULL", "i"), "k": ("MIN", "i"), "c": ("COUNT", "w"), "p": ("MAX", "start")}
    for every, chosen in ((True, [(i, j) for i in (0, 1) for j in (2, 3, 4)]), (False, [(0, 2), (1, 2), (1, 3), (1, 4)])):
        out = G.map_regions(ref, exp, spark.createDataFrame(chosen, "ref_id long, exp_id long"), kinds, every=every)
        want = []
        for r in a:
            for j in (j for i, j in chosen if i == r[0]):
                over = [e for e in b if e[0] == j and e[1] == r[1] and None not in (*r[1:4], *e[1:4]) and r[2] < e[3] and e[2] < r[3] and strands_fit(r[4], e[4]) and (r[4] or e[4] == "*")]
                w, i = [e[5] for e in over if e[5] is not None], [e[6] for e in over if e[6] is not None]
                want.append((r[0], j, *r[1:], len(over), max(w, key=size, default=None), min(w, key=size, default=None), len(i), min(i, default=None), len(over), max((e[2] for e in over), default=None)))
        assert Counter(map(repr, map(tuple, out.collect()))) == Counter(map(repr, want))


def odd_sides(spark):
    a, b = odd_regions(61, 90, [0, 1]), odd_regions(62, 120, [2, 3])
    b += [(2, "c1", 0, 60_000_000, "*", 1.0), (2, "c1", 77, 77, "+", 1.0), (3, "c2", 100, 50_000_200, None, None), (3, "c1", 50_000_010, 50_000_400, "-", 2.0), (2, None, 5, 90, "*", 1.0), (3, "c1", 5, None, "*", 1.0)]
    a += [(0, "c1", 77, 77, "*", 1.0), (0, "c1", 25_000_000, 25_000_003, "+", 1.0), (1, "c2", 25_000_000, 25_000_003, "*", 1.0), (1, None, 5, 9, "+", 1.0), (1, "c3", 5, 9, "+", 1.0), (0, "c1", None, 9, "+", 1.0), (0, "c1", 62, 65, None, 1.0)]
    schema = "sample_id long, chrom string, start long, stop long, strand string, v double"
    over = lambda r, j: [e for e in b if e[0] == j and e[1] == r[1] and None not in (*r[1:4], *e[1:4]) and r[2] < e[3] and e[2] < r[3] and strands_fit(r[4], e[4]) and (r[4] or e[4] == "*")]
    return a, spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), over


def both_ways(spark):
    """Samples all paired (one without regions), and some of them."""
    for every, chosen in ((True, [(i, j) for i in (0, 1) for j in (2, 3, 4)]), (False, [(0, 2), (1, 2), (1, 3), (1, 4)])):
        yield every, chosen, spark.createDataFrame(chosen, "ref_id long, exp_id long")


@pytest.mark.parametrize("stripe", [64, 1 << 20])
def test_counts_in_stripes(spark, monkeypatch, stripe):
    """Regions over many stripes are carried into each, and no row is made for a region, sample and side."""
    monkeypatch.setattr(stripes, "STRIPE", stripe)
    a, ref, exp, over = odd_sides(spark)
    for every, chosen, pairs in both_ways(spark):
        out = G.map_regions(ref, exp, pairs, {"again": ("COUNT", "v")}, every=every)
        want = [(r[0], j, *r[1:], *[len(over(r, j))] * 2) for r in a for i, j in chosen if i == r[0]]
        assert Counter(map(tuple, out.collect())) == Counter(want)
    out = G.map_regions(ref.where("stop - start <= 4"), exp, pairs, every=False)
    out.collect()
    assert "MapInArrow" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "_row" not in plan.split("Initial Plan")[0]


@pytest.mark.parametrize("stripe", [64, 1 << 20])
def test_merging_in_stripes(spark, monkeypatch, stripe):
    """Each region's hits are merged in its stripe, with one shuffle of each side and none of hits."""
    from strandframe.functions.aggregates import Merging

    monkeypatch.setattr(stripes, "STRIPE", stripe)
    a, ref, exp, over = odd_sides(spark)
    kind = Merging(lambda s: s.max(), lambda m, rows, full: None if m is None else m + 1000 * rows + full)
    for every, chosen, pairs in both_ways(spark):
        out = G.map_merging(ref, exp, pairs, "v", kind, "x", every=every)
        want = []
        for r in a:
            for j in (j for i, j in chosen if i == r[0]):
                found = over(r, j)
                full = [e[5] for e in found if e[5] is not None]
                want.append((r[0], j, *r[1:], len(found), max(full) + 1000 * len(found) + len(full) if full else None))
        got = [t for t in map(tuple, out.collect())]
        assert Counter(got) == Counter(want)
    out = G.map_merging(ref.where("stop - start <= 4"), exp, pairs, "v", kind, "x", every=False)
    out.collect()
    assert "MapInPandas" not in out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_greatest_under_many(spark):
    """The greatest value of 100,000 regions over each of 3,000 costs no pairs, and no bins of the length of the regions."""
    exp = spark.range(100_000).select(F.lit(2).cast("long").alias("sample_id"), F.lit("c").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 10_000_000).alias("stop"), F.lit("+").alias("strand"), F.col("id").alias("v"))
    ref = spark.range(3000).select(F.lit(1).cast("long").alias("sample_id"), F.lit("c").alias("chrom"), (F.col("id") + 5_000_000).alias("start"), (F.col("id") + 5_000_100).alias("stop"), F.lit("*").alias("strand"))
    out = G.map_regions(ref, exp, spark.createDataFrame([(1, 2)], "ref_id long, exp_id long"), {"m": ("MAX", "v")}, bin_size=I.NESTED, every=True)
    assert out.select("count", "m").distinct().collect() == [(100_000, 99_999)]
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_filtered_nearest_in_stripes(spark, monkeypatch):
    """A condition after MinDistance is applied where the nearest are found, and nothing is shuffled after that."""
    monkeypatch.setattr(stripes, "STRIPE", 4096)
    schema = "sample_id long, chrom string, start long, stop long, strand string, v double"
    a, b = odd_regions(71, 60, [0, 1], 3000), odd_regions(72, 130, [2, 3], 3000)
    out = G.join(spark.createDataFrame(a, schema).where("stop - start <= 200"), spark.createDataFrame(b, schema), [G.DistLess(300), G.MinDistance(1), G.DistGreater(5)])
    want = []
    for r in a:
        for j in (2, 3):
            near = [(max(r[2] - e[3], e[2] - r[3]), e) for e in b if e[0] == j and e[1] == r[1] and strands_fit(r[4], e[4])]
            want += [(r[0], j, *r[1:], e[5]) for g, e in near if g == min(g for g, _ in near) and 5 < g < 300]
    assert Counter(map(tuple, out.collect())) == Counter(want) and want
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_shared_steps(spark, tmp_path):
    """What two results read is computed once, and read from a table by both; a step that is read once stays a plan."""
    from strandframe.plans import flow
    from strandframe.sources import files

    schema = "sample_id long, chrom string, start long, stop long, strand string, v double"
    spark.createDataFrame(odd_regions(5, 50, [1, 2]), schema).write.parquet(f"{tmp_path}/in")
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    source = flow.Step(lambda: Dataset.of(spark.read.parquet(f"{tmp_path}/in")))
    shared = source.then(lambda ds: Dataset(ds.regions.mapInPandas(counted, schema), ds.meta))
    left, right = shared.then(lambda ds: ds.select(region=lambda r: r.value("v") > 4)), shared.then(lambda ds: ds.merge())
    flow.write({f"{tmp_path}/a": left, f"{tmp_path}/b": right})
    assert seen.value == 55 and files.read_written(spark, f"{tmp_path}/b").regions.count() == 55
    of = lambda ds: ds.regions._jdf.queryExecution().executedPlan().toString()
    assert all("MapInPandas" not in of(x) for x in flow.run([left, right])) and "MapInPandas" in of(flow.run([left])[0])


def test_merging_aggregate(spark):
    """The user's merge over many batches and partitions, nulls, and regions without a hit."""
    from strandframe.functions.aggregates import Merging

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        schema = "sample_id long, chrom string, start long, stop long, strand string, v double"
        ref = spark.createDataFrame([(1, "c", 0, 100, "*", 0.0), (1, "c", 0, 100, "*", 1.0), (1, "d", 0, 9, "+", 0.0)], schema)
        exp = spark.createDataFrame([(2, "c", k, k + 1, "+", None if k % 4 == 0 else float(k)) for k in range(40)] + [(2, "d", 1, 2, "*", None)], schema).repartition(5)
        pairs = spark.createDataFrame([(1, 2)], "ref_id long, exp_id long")
        for every in (True, False):
            got = G.map_merging(ref, exp, pairs, "v", Merging(lambda s: s.max(), lambda m, rows, full: None if m is None else m + 1000 * rows + full), "x", every=every)
            rows = [(r["chrom"], r["count"], r["x"]) for r in got.collect()]
            assert sorted(rows, key=str) == sorted([("c", 40, 39.0 + 40_000 + 30)] * 2 + [("d", 1, None)], key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_pairs_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(M, "PAIRS", 2)
    schema = "sample_id long, chrom string, start long, stop long, strand string, v double"
    a, b = spark.createDataFrame(odd_regions(6, 30, [0, 1]), schema), spark.createDataFrame(odd_regions(7, 30, [2, 3]), schema)
    few, many = [(0, 2), (1, 3)], [(0, 2), (0, 3), (1, 2)]
    for chosen in (few, many):
        out = G.join(a, b, [G.DistLess(5)], pairs=spark.createDataFrame(chosen, "ref_id long, exp_id long"))
        assert ("ResolvedHint" in out._jdf.queryExecution().analyzed().toString()) == (chosen is few)
        assert {(r.ref_id, r.exp_id) for r in out.collect()} <= set(chosen)


def test_windows(spark):
    """Bins between and beside the windows get no rows; the pairs are those of all regions, for every size of bins."""
    schema = "sample_id long, chrom string, start long, stop long, strand string, v double"
    a, b = odd_regions(21, 60, [0, 1]), odd_regions(22, 60, [2, 3])
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for conditions in ([G.DistGreater(3), G.DistLess(12)], [G.DistGreater(0), G.Upstream(), G.DistLess(9)], [G.Downstream(), G.DistLess(7)], [G.Upstream(), G.Downstream(), G.DistLess(5)], [G.DistGreater(-1), G.DistLess(4)], [G.DistGreater(30), G.DistLess(3)]):
        want = sorted((*r[:6], *e[:6]) for r in a for e in b if e[1] == r[1] and strands_fit(r[4], e[4]) and all(holds(c, r, e) for c in conditions))
        for size in (7, I.NESTED):
            found = G.matches(left, right, conditions, bin_size=size)
            assert sorted(map(tuple, found.select(*left.columns, *(c.replace("e_sample_id", "exp_id") for c in (f"e_{x}" for x in right.columns))).collect()), key=str) == sorted(want, key=str), (conditions, size)
    one = spark.createDataFrame([(1, "c", 10**6, 10**6 + 500, "+", 0.0)], schema)
    rows = lambda *more: one.select(F.inline(G.windows(*more))).select(F.explode(I.bins(F.col("w_start"), F.col("w_stop"), 1000))).count()
    assert rows(60_001) == 122 and rows(60_001, 50_001) <= 24 and rows(60_001, 50_001, G.Upstream) <= 12 and rows(60_001, 0, G.Downstream) <= 62


def test_metadata_index(spark, tmp_path):
    """The index finds the samples that reading all metadata finds, over a million samples and with odd names and values."""
    from strandframe.sources import files, meta_index

    a = M.attribute
    rows = [(1, "cell", "K562"), (1, "x.cell", "hela"), (2, "x.y.cell", "k562"), (2, "n", "3"), (3, "n", "3.0"), (3, "n", "abc"), (4, "n", None), (5, "cells", "K562"), (6, "", "v"), (7, "n", "NaN"), (7, "cell.", "k562"), (8, "a.n", "-7"), (9, ".n", "5")]
    meta = spark.createDataFrame(rows, "sample_id long, attribute string, value string")
    meta_index.build(meta, f"{tmp_path}/odd")
    predicates = [a("cell") == "k562", a("cell") != "K562", a("n") == 3, a("n") == "3.00", a("n") != 3, a("n") > 2, a("n") <= -7, a("n").exists(), a("n").missing(), a("y.cell") == "*", a("none").missing() & (a("n") < 10), ~(a("cell") == "k562") | (a("n") >= 3), a("") == "v", a("cell.").exists()]
    for i, p in enumerate(predicates):
        found, plain = meta_index.samples_where(spark, f"{tmp_path}/odd", p), M.samples_where(meta, p)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())), i
    empty = meta.limit(0)
    meta_index.build(empty, f"{tmp_path}/none")
    assert meta_index.samples_where(spark, f"{tmp_path}/none", a("n").missing()).isEmpty()
    many = spark.range(1_000_000).select(F.col("id").alias("sample_id"), F.inline(F.array(*(F.struct(F.lit(n).alias("attribute"), v.cast("string").alias("value")) for n, v in {"lab.size": F.col("id") % 5000, "cell": F.concat(F.lit("c"), F.col("id") % 300), "batch": F.col("id") % 7}.items()))))
    meta_index.build(many, f"{tmp_path}/many")
    p = (a("size") < 2) & ~(a("batch") == 3) | (a("cell") == "C17") & (a("batch") == 1)
    found = meta_index.samples_where(spark, f"{tmp_path}/many", p)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "In(name, [" in plan and "EqualTo(text,c17)" in plan
    assert found.exceptAll(M.samples_where(many, p)).isEmpty() and found.count() == M.samples_where(many, p).count() > 0
    ds = Dataset.of(spark.createDataFrame([(s, "c", 0, 5, "+") for s in range(1, 9)], "sample_id long, chrom string, start long, stop long, strand string"), meta)
    files.write(ds, f"{tmp_path}/ds", index=True)
    chosen = files.read_written(spark, f"{tmp_path}/ds", where=a("n") == 3, index=True)
    assert {r.sample_id for r in chosen.regions.collect()} == {r.sample_id for r in chosen.meta.collect()} == {2, 3}


def test_sparse_cells(spark):
    """Ten thousand samples: cells grow with hits; zeros can be filled in later."""
    coords = "chrom string, start long, stop long, strand string"
    ref = spark.range(200).select(F.lit(1).cast("long").alias("sample_id"), F.lit("c").alias("chrom"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 50).alias("stop"), F.lit("*").alias("strand"))
    exp = spark.range(10_000).select(F.col("id").alias("sample_id"), F.lit("c").alias("chrom"), (F.col("id") % 200 * 100 + 10).alias("start"), (F.col("id") % 200 * 100 + 20).alias("stop"), F.lit("+").alias("strand"))
    a, b = X.to_matrix(ref), X.to_matrix(exp)
    sparse = X.matrix_map(a, b, bin_size=100, zeros=False)
    assert sparse.agg(F.max(F.size("counts")), F.sum(F.size("counts"))).first()[:] == (50, 10_000)
    full = X.with_zeros(sparse.limit(3), exp.select("sample_id"))
    assert {r[0] for r in full.select(F.size("counts")).collect()} == {10_000} and full.where(F.expr("counts != array_sort(counts)")).isEmpty()
    dense = X.matrix_map(a.limit(3), b, bin_size=100)
    assert dense.select(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["count"])).distinct().collect()[0][0] == 50
    for m in (sparse, X.with_zeros(sparse, exp.select("sample_id"))):
        assert X.sample_totals(m).where("coordinates <> 1 OR hits <> 1").isEmpty()
    none = X.matrix_map(a, X.to_matrix(exp.limit(0)), bin_size=100)
    assert none.count() == 200 and none.where(F.size("counts") > 0).isEmpty()
    assert X.matrix_map(X.to_matrix(spark.createDataFrame([], "sample_id long, " + coords)), b, bin_size=100).isEmpty()


def test_matrix_nearest(spark):
    """Nearest coordinates, and conditions without an upper bound."""
    schema = "sample_id long, chrom string, start long, stop long, strand string, v double"
    a, b = odd_regions(31, 30, [0, 1]), odd_regions(32, 30, [2, 3])
    left, right = X.to_matrix(spark.createDataFrame(a, schema)), X.to_matrix(spark.createDataFrame(b, schema))
    ours, theirs = {r[:5] for r in [(0, *x[1:5]) for x in a]}, {(0, *x[1:5]) for x in b}
    for conditions, reach in (([G.MinDistance(2)], 1000), ([G.DistGreater(2), G.MinDistance(1)], 1002), ([G.Upstream()], 1000), ([G.MinDistance(1), G.Downstream()], 1000)):
        cut = next((i for i, c in enumerate(conditions) if isinstance(c, G.MinDistance)), len(conditions))
        want = set()
        for r in ours:
            near = [(max(r[2] - e[3], e[2] - r[3]), e) for e in theirs if e[1] == r[1] and strands_fit(r[4], e[4]) and all(holds(c, r, e) for c in conditions[:cut])]
            near = [(g, e) for g, e in near if g <= reach]
            least = sorted({g for g, _ in near})[: conditions[cut].k] if cut < len(conditions) else {g for g, _ in near}
            want |= {r[1:5] for g, e in near if g in least and all(holds(c, r, e) for c in conditions[cut + 1 :])}
        got = X.matrix_join(left, right, conditions, bin_size=50, horizon=1000)
        assert {tuple(x) for x in got.select(*I.COORDS).collect()} == want and want


def test_matrix_nearest_in_stripes(spark, monkeypatch):
    """The nearest coordinates with their cells, over stripes, from one shuffle of each matrix."""
    monkeypatch.setattr(stripes, "STRIPE", 8192)
    schema = "sample_id long, chrom string, start long, stop long, strand string, v double"
    a, b = odd_regions(81, 60, [0, 1], 3000), odd_regions(82, 90, [2, 3], 3000)
    joined = X.matrix_join(X.to_matrix(spark.createDataFrame(a, schema)), X.to_matrix(spark.createDataFrame(b, schema)), [G.DistLess(300), G.MinDistance(1)])
    want = Counter()
    for r in a:
        near = [(max(r[2] - e[3], e[2] - r[3]), e) for e in b if e[1] == r[1] and strands_fit(r[4], e[4])]
        want.update((*r, e[0], e[5]) for g, e in near if g == min(g for g, _ in near) and g < 300)
    rows = X.crossed(joined, ["cells", "right_cells"]).select("cells_sample_id", *I.COORDS, "cells_value.vals.v", "right_cells_sample_id", F.col("right_cells_value.vals.v").alias("w"))
    assert Counter(map(tuple, rows.collect())) == want and want
    joined.collect()
    assert "Window" not in joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
