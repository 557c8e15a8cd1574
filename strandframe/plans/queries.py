"""One query for each operator over regions and metadata derived from the star schema, each with its plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..functions import intervals as I
from ..functions.aggregates import Merging
from ..operators import cover as C
from ..operators import genometric as G
from ..operators import matrix as X
from ..operators import metadata as M
from ..operators import regions as R
from ..sources import files, meta_index
from . import flow

BIN = 1000
COORDS = ["chrom", "start", "stop", "strand"]


def region_table(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    start = F.col("l_partkey") * 50 + F.col("l_orderkey") % 50
    strand = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "N", "-").otherwise("*")
    return li.select((F.col("l_suppkey") % 6).cast("long").alias("sample_id"), F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")).alias("chrom"), start.cast("long").alias("start"), (start + F.col("l_quantity").cast("long")).cast("long").alias("stop"), strand.alias("strand"), F.col("l_extendedprice").alias("score"), F.col("l_discount").alias("x"))


def meta_table(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    s = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    values = {"nation": F.col("n_name"), "geo.region": F.col("r_name"), "acctbal": F.floor("s_acctbal").cast("string"), "parity": (F.col("s_suppkey") % 2).cast("string"), "third": (F.col("s_suppkey") % 6 % 3).cast("string")}
    pairs = F.array(*(F.struct(F.lit(k).alias("attribute"), v.alias("value")) for k, v in values.items()))
    return s.select((F.col("s_suppkey") % 6).cast("long").alias("sample_id"), F.inline(pairs)).distinct()


def dataset(spark: SparkSession, d: str, *samples: int) -> Dataset:
    r, m = region_table(spark, d), meta_table(spark, d)
    keep = F.col("sample_id").isin(*samples) if samples else F.lit(True)
    return Dataset(r.where(keep), m.where(keep))


def ref(spark, d) -> Dataset:
    return dataset(spark, d, 0, 1)


def exp(spark, d) -> Dataset:
    return dataset(spark, d, 2, 3, 4, 5)


BASE = """WITH regions AS (SELECT CAST(l_suppkey % 6 AS BIGINT) AS sample_id, 'chr' || l_linenumber AS chrom, CAST(l_partkey * 50 + l_orderkey % 50 AS BIGINT) AS start,
  CAST(l_partkey * 50 + l_orderkey % 50 + CAST(l_quantity AS BIGINT) AS BIGINT) AS stop, CASE l_returnflag WHEN 'A' THEN '+' WHEN 'N' THEN '-' ELSE '*' END AS strand, l_extendedprice AS score, l_discount AS x FROM lineitem),
s0 AS (SELECT CAST(s_suppkey % 6 AS BIGINT) AS sample_id, * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
meta AS (SELECT DISTINCT sample_id, 'nation' AS attribute, n_name AS value FROM s0 UNION SELECT sample_id, 'geo.region', r_name FROM s0 UNION SELECT sample_id, 'acctbal', CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) FROM s0
  UNION SELECT sample_id, 'parity', CAST(s_suppkey % 2 AS VARCHAR) FROM s0 UNION SELECT sample_id, 'third', CAST(sample_id % 3 AS VARCHAR) FROM s0),
ref AS (SELECT *, row_number() OVER () AS rid FROM regions WHERE sample_id < 2), ex AS (SELECT * FROM regions WHERE sample_id >= 2)
"""
STRAND = "(r.strand = '*' OR e.strand = '*' OR r.strand = e.strand)"
OVERLAP = "r.start < e.stop AND e.start < r.stop"
DIST = "greatest(r.start - e.stop, e.start - r.stop)"
UP = "CASE WHEN r.strand = '-' THEN e.start >= r.stop ELSE e.stop <= r.start END"
DOWN = "CASE WHEN r.strand = '-' THEN e.stop <= r.start ELSE e.start >= r.stop END"
LEFT = "r.sample_id AS ref_id, e.sample_id AS exp_id, r.chrom, r.start, r.stop, r.strand, r.score, r.x, e.score AS right_score, e.x AS right_x"
JOINT = "CASE WHEN r.strand = e.strand THEN r.strand ELSE '*' END AS strand"
VALUES = "r.score, r.x, e.score AS right_score, e.x AS right_x"
IDS = "r.sample_id AS ref_id, e.sample_id AS exp_id, r.chrom"

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers the function under its name with its SQL, which follows BASE."""

    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = BASE + sql
        return f

    return put


def _join_sql(condition: str, select: str = LEFT) -> str:
    return f"SELECT {select} FROM ref r JOIN ex e ON r.chrom = e.chrom AND {STRAND} AND {condition}"


def _map_sql(columns: str, pairs: str = "(SELECT DISTINCT r.sample_id AS a, e.sample_id AS b FROM ref r, ex e)") -> str:
    return f"""SELECT r.sample_id AS ref_id, p.b AS exp_id, r.chrom, r.start, r.stop, r.strand, r.score, r.x, count(e.start) AS count{columns}
FROM ref r JOIN {pairs} p ON p.a = r.sample_id LEFT JOIN ex e ON e.sample_id = p.b AND e.chrom = r.chrom AND {OVERLAP} AND {STRAND} GROUP BY r.rid, r.sample_id, p.b, r.chrom, r.start, r.stop, r.strand, r.score, r.x"""


def _mapped(spark, d, aggregates=None, attributes=()) -> DataFrame:
    a, b = ref(spark, d), exp(spark, d)
    return G.map_regions(a.regions, b.regions, a.pairs(b, attributes), aggregates, bin_size=BIN, every=not attributes)


@query(_map_sql(""))
def map_count(spark, d):
    return _mapped(spark, d)


@query(_map_sql(", round(sum(e.score), 2) AS total, max(e.x) AS best, min(e.score) AS least, round(avg(e.x), 6) AS mean, count(e.x) AS n"))
def map_aggs(spark, d):
    return _mapped(spark, d, {"total": (lambda c: F.round(F.sum(c), 2), "score"), "best": ("MAX", "x"), "least": ("MIN", "score"), "mean": (lambda c: F.round(F.avg(c), 6), "x"), "n": ("COUNT_NON_NULL", "x")})


@query(f"""SELECT r.sample_id AS ref_id, p.b AS exp_id, r.chrom, r.start, r.far AS stop, r.strand, r.score, r.x, count(e.start) AS count, max(e.score) AS best
FROM (SELECT *, stop + CASE WHEN start % 97 = 0 THEN 40000 ELSE 0 END AS far FROM ref) r JOIN (SELECT DISTINCT r.sample_id AS a, e.sample_id AS b FROM ref r, ex e) p ON p.a = r.sample_id
LEFT JOIN (SELECT *, stop + CASE WHEN start % 89 = 0 THEN 2000000 ELSE 0 END AS far FROM ex) e ON e.sample_id = p.b AND e.chrom = r.chrom AND r.start < e.far AND e.start < r.far AND {STRAND}
GROUP BY r.rid, r.sample_id, p.b, r.chrom, r.start, r.far, r.strand, r.score, r.x""")
def map_nested(spark, d):
    """Short regions and very long ones in one table: bins by length."""
    a, b = ref(spark, d), exp(spark, d)
    longer = lambda ds, n, by: ds.regions.withColumn("stop", F.col("stop") + F.when(F.col("start") % n == 0, by).otherwise(0))
    return G.map_regions(longer(a, 97, 40_000), longer(b, 89, 2_000_000), a.pairs(b), {"best": ("MAX", "score")}, bin_size=I.NESTED, every=True)


@query(_map_sql("", "(SELECT DISTINCT r.sample_id AS a, e.sample_id AS b FROM meta r JOIN meta e ON r.attribute = 'third' AND e.attribute = 'third' AND r.value = e.value WHERE r.sample_id < 2 AND e.sample_id >= 2)"))
def map_joinby(spark, d):
    return _mapped(spark, d, attributes=["third"])


@query(_map_sql(", round(sum(e.score) / nullif(count(e.score), 0), 4) AS mean"))
def map_user_aggregate(spark, d):
    """An aggregate of the user's own, from a merge and an outcome."""
    a, b = ref(spark, d), exp(spark, d)
    kind = Merging(lambda s: s.sum(), lambda total, rows, full: total / full if full else None)
    out = G.map_merging(a.regions, b.regions, a.pairs(b), "score", kind, "mean", bin_size=BIN, every=True)
    return out.withColumn("mean", F.round("mean", 4))


@query("SELECT sample_id, chrom, start, stop, strand, round(score * (stop - start), 2) AS weight, upper((SELECT min(value) FROM meta m WHERE m.sample_id = regions.sample_id AND attribute = 'third')) AS third FROM regions")
def project_rows(spark, d):
    """Values from the user's own function of rows and metadata."""

    def weigh(f):
        import pandas as pd

        return pd.DataFrame({"weight": (f["score"] * (f["stop"] - f["start"])).round(2), "third": f["meta_third"].str.upper()})

    return dataset(spark, d).project_rows(weigh, "weight double, third string", ["third"]).regions.withColumn("weight", F.round("weight", 2))


def _joined(spark, d, conditions, builder="LEFT", **more) -> DataFrame:
    return G.join(ref(spark, d).regions, exp(spark, d).regions, conditions, builder, bin_size=BIN, **more)


@query(_join_sql(OVERLAP))
def join_distless_left(spark, d):
    return _joined(spark, d, [G.DistLess(0)])


@query(_join_sql(f"{DIST} < 20", f"{IDS}, e.start, e.stop, e.strand, {VALUES}"))
def join_right(spark, d):
    return _joined(spark, d, [G.DistLess(20)], "RIGHT")


@query(_join_sql(OVERLAP, f"{IDS}, least(r.start, e.start) AS start, greatest(r.stop, e.stop) AS stop, {JOINT}, {VALUES}"))
def join_contig(spark, d):
    return _joined(spark, d, [G.DistLess(0)], "CONTIG")


@query(_join_sql(OVERLAP, f"{IDS}, greatest(r.start, e.start) AS start, least(r.stop, e.stop) AS stop, {JOINT}, {VALUES}"))
def join_intersection(spark, d):
    return _joined(spark, d, [G.DistLess(10)], "INTERSECTION")


@query(_join_sql(OVERLAP, "r.sample_id AS ref_id, e.sample_id AS exp_id, r.chrom, r.start, r.stop, r.strand, r.score, r.x, e.chrom AS right_chrom, e.start AS right_start, e.stop AS right_stop, e.strand AS right_strand, e.score AS right_score, e.x AS right_x"))
def join_both(spark, d):
    return _joined(spark, d, [G.DistLess(0)], "BOTH")


@query(_join_sql(OVERLAP, "DISTINCT r.sample_id AS ref_id, e.sample_id AS exp_id, r.chrom, r.start, r.stop, r.strand, r.score, r.x"))
def join_left_distinct(spark, d):
    return _joined(spark, d, [G.DistLess(0)], "LEFT_DISTINCT")


@query(_join_sql(OVERLAP, f"DISTINCT {IDS}, e.start, e.stop, e.strand, e.score, e.x"))
def join_right_distinct(spark, d):
    return _joined(spark, d, [G.DistLess(0)], "RIGHT_DISTINCT")


@query(_join_sql(f"{DIST} > 30 AND {DIST} < 60"))
def join_distgreater(spark, d):
    return _joined(spark, d, [G.DistGreater(30), G.DistLess(60)])


@query(_join_sql(f"{DIST} > 30000 AND {DIST} < 30040"))
def join_far(spark, d):
    """Partners far away on either side: a region goes to the bins of two windows, not to those between them."""
    return _joined(spark, d, [G.DistGreater(30_000), G.DistLess(30_040)])


@query(_join_sql(f"{DIST} > 5000 AND {DIST} < 5050 AND ({UP})"))
def join_far_upstream(spark, d):
    return _joined(spark, d, [G.DistGreater(5000), G.DistLess(5050), G.Upstream()])


@query(_join_sql(f"{DIST} < 50 AND ({UP})"))
def join_upstream(spark, d):
    return _joined(spark, d, [G.DistLess(50), G.Upstream()])


@query(_join_sql(f"{DIST} < 50 AND ({DOWN})"))
def join_downstream(spark, d):
    return _joined(spark, d, [G.DistLess(50), G.Downstream()])


def _nearest_sql(before: str, k: int, after: str = "true") -> str:
    return f"""SELECT ref_id, exp_id, chrom, start, stop, strand, score, x, right_score, right_x FROM (SELECT {LEFT}, {DIST} AS dist, dense_rank() OVER (PARTITION BY r.rid, e.sample_id ORDER BY {DIST}) AS k
FROM ref r JOIN ex e ON r.chrom = e.chrom AND {STRAND} AND {before}) WHERE k <= {k} AND {after}"""


@query(f""", gaps AS (SELECT r.rid, e.sample_id AS s, {DIST} AS gap FROM ref r JOIN ex e ON r.chrom = e.chrom AND {STRAND} AND {DIST} <= 100000 GROUP BY 1, 2, 3), cut AS (SELECT rid, s, list_max(min(gap, 2)) AS most FROM gaps GROUP BY 1, 2)
SELECT {LEFT} FROM ref r JOIN cut ON cut.rid = r.rid JOIN ex e ON e.sample_id = cut.s AND r.chrom = e.chrom AND {STRAND} AND {DIST} <= cut.most""")
def join_min_distance(spark, d):
    return _joined(spark, d, [G.MinDistance(2)])


@query(_nearest_sql(f"{DIST} < 300", 1, "dist > 5"))
def join_md_then_distgreater(spark, d):
    return _joined(spark, d, [G.DistLess(300), G.MinDistance(1), G.DistGreater(5)])


@query(f"{_join_sql(OVERLAP)} UNION ALL SELECT {LEFT} FROM ref r JOIN ex e ON r.chrom = e.chrom AND {STRAND} AND {DIST} > 40 AND {DIST} < 50")
def join_two_quadruples(spark, d):
    return _joined(spark, d, [[G.DistLess(0)], [G.DistGreater(40), G.DistLess(50)]])


@query(_join_sql(f"{DIST} < 100 AND r.x = e.x"))
def join_attr(spark, d):
    return _joined(spark, d, [G.DistLess(100)], on=["x"])


@query(f"SELECT {LEFT} FROM ref r JOIN ex e ON r.chrom = e.chrom AND r.start = e.start AND r.x = e.x")
def join_attr_only(spark, d):
    return _joined(spark, d, [], on=["chrom", "start", "x"])


@query(_join_sql(f"{OVERLAP} AND r.sample_id % 3 = e.sample_id % 3"))
def join_joinby(spark, d):
    a, b = ref(spark, d), exp(spark, d)
    return G.join(a.regions, b.regions, [G.DistLess(0)], pairs=a.pairs(b, ["third"]), bin_size=BIN)


REGION = "sample_id, chrom, start, stop, strand, score, x"


@query(f"SELECT {REGION} FROM ref r WHERE NOT EXISTS (SELECT 1 FROM ex e WHERE r.chrom = e.chrom AND {OVERLAP} AND {STRAND})")
def difference(spark, d):
    return G.difference(ref(spark, d).regions, exp(spark, d).regions, bin_size=BIN)


@query(f"SELECT {REGION} FROM ref r WHERE NOT EXISTS (SELECT 1 FROM ex e WHERE r.chrom = e.chrom AND {OVERLAP} AND {STRAND})")
def difference_shuffled(spark, d):
    """The ref comes out of a shuffle, whose rows have no fixed place."""
    return G.difference(ref(spark, d).regions.repartition("start"), exp(spark, d).regions, bin_size=BIN)


@query(f"SELECT {REGION} FROM ref r WHERE NOT EXISTS (SELECT 1 FROM ex e WHERE r.chrom = e.chrom AND r.start = e.start AND r.stop = e.stop AND {STRAND})")
def difference_exact(spark, d):
    return G.difference(ref(spark, d).regions, exp(spark, d).regions, exact=True)


@query(f"SELECT {REGION} FROM ref r WHERE NOT EXISTS (SELECT 1 FROM ex e WHERE r.chrom = e.chrom AND {OVERLAP} AND {STRAND} AND r.sample_id % 3 = e.sample_id % 3)")
def difference_joinby(spark, d):
    a, b = ref(spark, d), exp(spark, d)
    return G.difference(a.regions, b.regions, a.pairs(b, ["third"]), bin_size=BIN)


@query("SELECT 0 AS side, sample_id, chrom, start, stop, strand, score, x FROM ref UNION ALL SELECT 1, sample_id, chrom, start, stop, strand, NULL, x FROM ex")
def union_regions(spark, d):
    a, b = ref(spark, d), exp(spark, d)
    both = Dataset(a.regions.withColumn("side", F.lit(0)).withColumn("from", F.col("sample_id")), a.meta).union(Dataset(b.regions.drop("score").withColumn("side", F.lit(1)).withColumn("from", F.col("sample_id")), b.meta))
    return both.regions.select("side", F.col("from").alias("sample_id"), *COORDS, "score", "x")


@query("SELECT attribute, value, count(*) AS n FROM (SELECT sample_id, attribute, value FROM meta UNION ALL SELECT DISTINCT sample_id, '_provenance', CASE WHEN sample_id < 2 THEN 'left' ELSE 'right' END FROM meta) GROUP BY ALL")
def union_meta(spark, d):
    return ref(spark, d).union(exp(spark, d)).meta.groupBy("attribute", "value").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT CAST(1 AS BIGINT) AS sample_id, attribute, value FROM meta")
def merge(spark, d):
    return dataset(spark, d).merge().meta


@query("SELECT CAST(sample_id % 3 + 1 AS BIGINT) AS sample_id, count(*) AS n, round(sum(score), 2) AS total FROM regions GROUP BY ALL")
def merge_groupby(spark, d):
    return dataset(spark, d).merge(["third"]).regions.groupBy("sample_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"))


@query(f"SELECT {REGION} FROM regions WHERE chrom = 'chr1' AND strand <> '*' AND (CASE WHEN strand = '-' THEN stop ELSE start END) > 20000 AND NOT x > 0.05")
def region_select(spark, d):
    return dataset(spark, d).select(region=lambda r: (r.chrom == "chr1") & (r.strand != "*") & (r.start > 20000) & ~R.holds(r.value("x") > 0.05)).regions


@query(f"SELECT {REGION.replace(', x', '')}, y FROM (SELECT *, CASE WHEN x > 0.03 THEN x END AS y FROM regions) WHERE NOT coalesce(y > 0.06, false)")
def select_not_null_logic(spark, d):
    ds = dataset(spark, d)
    rows = ds.regions.withColumn("y", F.when(F.col("x") > 0.03, F.col("x"))).drop("x")
    return R.select(rows, lambda r: ~R.holds(r.value("y") > 0.06))


@query(f"SELECT {REGION} FROM regions JOIN (SELECT sample_id AS s, min(value) AS v FROM meta WHERE attribute = 'acctbal' GROUP BY 1) ON s = sample_id WHERE score > 10 * CAST(v AS DOUBLE)")
def select_meta_accessor(spark, d):
    return dataset(spark, d).select(region=lambda r: r.value("score") > 10 * r.meta("acctbal")).regions


def _meta_sql(having: str) -> str:
    return f"SELECT sample_id, attribute, value FROM meta WHERE sample_id IN (SELECT sample_id FROM meta GROUP BY sample_id HAVING {having})"


@query(_meta_sql("bool_or(attribute = 'parity' AND TRY_CAST(value AS DOUBLE) = 1) AND NOT bool_or(attribute = 'third' AND value = '2') OR bool_or(attribute = 'acctbal' AND TRY_CAST(value AS DOUBLE) > 9980)"))
def meta_select(spark, d):
    a = M.attribute
    return dataset(spark, d).select(meta=(a("parity") == 1) & ~(a("third") == 2) | (a("acctbal") > 9980)).meta


@query(_meta_sql("NOT bool_or(attribute = 'parity' AND coalesce(TRY_CAST(value AS DOUBLE) <> 1, true)) OR bool_or((attribute = 'region' OR attribute LIKE '%.region') AND lower(value) = 'europe') AND bool_or(attribute = 'acctbal' AND TRY_CAST(value AS DOUBLE) < -900)"))
def meta_index_select(spark, d):
    """A selection from an index of the metadata, by ranges of its entries."""
    a, ds, folder = M.attribute, dataset(spark, d), files.scratch(spark)
    meta_index.build(ds.meta, folder)
    found = meta_index.samples_where(spark, folder, ~(a("parity") != 1) | (a("region") == "europe") & (a("acctbal") < -900))
    return M.restricted(ds.meta, found)


@query(_meta_sql("bool_or((attribute = 'region' OR attribute LIKE '%.region') AND lower(value) = 'asia') AND NOT bool_or(attribute = 'absent')"))
def meta_suffix_text(spark, d):
    return dataset(spark, d).select(meta=(M.attribute("region") == "Asia") & M.attribute("absent").missing()).meta


@query(_meta_sql("bool_or(attribute = 'third' AND TRY_CAST(value AS DOUBLE) <> 1)"))
def meta_neq_exists(spark, d):
    return dataset(spark, d).select(meta=M.attribute("third") != 1).meta


SEMI = "SELECT sample_id FROM meta m WHERE attribute = 'third' AND value IN (SELECT value FROM meta WHERE attribute = 'third' AND sample_id < 2)"


@query(f"SELECT {REGION} FROM regions WHERE sample_id >= 2 AND sample_id IN ({SEMI})")
def semijoin(spark, d):
    return exp(spark, d).select_in(ref(spark, d), ["third"]).regions


@query(f"SELECT {REGION} FROM regions WHERE sample_id >= 2 AND sample_id NOT IN ({SEMI})")
def antijoin(spark, d):
    return exp(spark, d).select_in(ref(spark, d), ["third"], negated=True).regions


@query("""SELECT DISTINCT 'default' AS how, r.sample_id AS ref_id, e.sample_id AS exp_id FROM meta r JOIN meta e ON r.value = e.value AND (r.attribute = 'region' OR r.attribute LIKE '%.region') AND (e.attribute = 'region' OR e.attribute LIKE '%.region') AND e.sample_id >= 2
UNION ALL SELECT DISTINCT 'full', r.sample_id, e.sample_id FROM meta r JOIN meta e ON r.value = e.value AND r.attribute = e.attribute AND r.attribute LIKE '%.region' AND e.sample_id >= 2
UNION ALL SELECT DISTINCT 'exact', r.sample_id, e.sample_id FROM meta r JOIN meta e ON r.value = e.value AND r.attribute = 'geo.region' AND e.attribute = 'geo.region' AND e.sample_id >= 2""")
def sample_pairs(spark, d):
    """The three ways in which attributes' names agree."""
    meta = meta_table(spark, d)
    right = meta.where("sample_id >= 2")
    ways = {"default": M.By("region"), "full": M.By("region", "full"), "exact": M.By("geo.region", "exact")}
    out = None
    for how, by in ways.items():
        one = M.sample_pairs(meta, right, [by]).select(F.lit(how).alias("how"), "ref_id", "exp_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT sample_id, chrom, start, stop, strand, score FROM regions WHERE sample_id IN (SELECT sample_id FROM meta WHERE attribute = 'parity' AND value = '1') AND chrom IN ('chr6', 'chr7')")
def purge(spark, d):
    ds = dataset(spark, d)
    kept = Dataset(ds.regions.where("chrom IN ('chr6', 'chr7')").drop("x"), ds.meta.where("attribute = 'parity' AND value = '1'"))
    return kept.purge().regions


@query("SELECT sample_id, chrom, greatest(start - 30000, 0) AS start, stop - 30000 AS stop, strand, x, round(score / 2, 3) AS half, score + CAST(v AS DOUBLE) AS moved FROM regions JOIN (SELECT sample_id AS s, min(value) AS v FROM meta WHERE attribute = 'acctbal' GROUP BY 1) ON s = sample_id WHERE stop - 30000 > start - 30000")
def project_extend(spark, d):
    return dataset(spark, d).project(keep=["x"], extend={"start": lambda r: r.left - 30000, "stop": lambda r: r.right - 30000, "half": lambda r: F.round(r.value("score") / 2, 3), "moved": lambda r: r.value("score") + r.meta("acctbal")}).regions


@query("SELECT sample_id, attribute, value FROM meta WHERE attribute IN ('geo.region', 'parity')")
def project_meta(spark, d):
    return dataset(spark, d).project(meta_keep=["region", "parity"]).meta


@query("SELECT sample_id, attribute, value FROM meta WHERE attribute = 'third' UNION ALL SELECT sample_id, 'nations', CAST(count(CASE WHEN attribute = 'nation' THEN 1 END) AS VARCHAR) FROM meta GROUP BY sample_id")
def extend_meta(spark, d):
    ds = dataset(spark, d).project(meta_keep=["third", "nation"])
    return ds.project_meta("nations", ["nation"], lambda v: F.size(v)).meta.where("attribute <> 'nation'")


@query("SELECT sample_id, attribute, value FROM (SELECT sample_id, CAST(count(*) AS VARCHAR) AS regions, CAST(CAST(max(stop) AS BIGINT) AS VARCHAR) AS far FROM regions GROUP BY sample_id) UNPIVOT (value FOR attribute IN (regions, far))")
def extend(spark, d):
    return dataset(spark, d).extend({"regions": ("COUNT", "stop"), "far": ("MAX", "stop")}).meta.where("attribute IN ('regions', 'far')")


@query("SELECT sample_id, chrom, start, stop, strand, count(*) AS n, round(sum(score), 2) AS total, string_agg(CAST(CAST(x * 100 AS INT) AS VARCHAR), ' ' ORDER BY CAST(CAST(x * 100 AS INT) AS VARCHAR)) AS bag FROM regions GROUP BY ALL".replace("CAST(x * 100 AS INT)", "CAST(round(x * 100) AS INT)").replace("GROUP BY ALL", "GROUP BY sample_id, chrom, start, stop, strand"))
def group_regions(spark, d):
    rows = dataset(spark, d).regions.withColumn("p", F.round(F.col("x") * 100).cast("int"))
    return R.group(rows, aggregates={"n": ("COUNT", "score"), "total": (lambda c: F.round(F.sum(c), 2), "score"), "bag": ("BAG", "p")})


@query("SELECT sample_id, attribute, value FROM meta WHERE attribute = 'third' UNION ALL SELECT DISTINCT sample_id, '_group', CAST(sample_id % 3 + 1 AS VARCHAR) FROM meta UNION ALL SELECT DISTINCT sample_id, 'members', '2' FROM meta UNION ALL SELECT m.sample_id, 'top', mx FROM (SELECT DISTINCT sample_id FROM meta) m JOIN (SELECT sample_id % 3 AS g, max(value) AS mx FROM meta WHERE attribute = 'nation' GROUP BY 1) ON g = m.sample_id % 3")
def group_meta(spark, d):
    out = M.group(meta_table(spark, d), ["third"], aggregates={"members": (None, F.count_distinct), "top": ("nation", F.max)})
    return out.where("attribute IN ('third', '_group', 'members', 'top')")


ORDERED = "score DESC, start, chrom, stop, strand, x"


@query(f"SELECT {REGION}, n AS \"order\" FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC NULLS LAST, chrom, start, stop, strand, x) AS n FROM regions) WHERE n <= 5")
def order_top(spark, d):
    return dataset(spark, d).order([("score", False)], top=5).regions


@query(f"SELECT {REGION}, n AS \"order\" FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC NULLS LAST, chrom, start, stop, strand, x) AS n FROM regions WHERE sample_id IN (SELECT sample_id FROM meta WHERE attribute = 'acctbal' GROUP BY 1 ORDER BY max(CAST(value AS DOUBLE)) DESC, 1 LIMIT 4)) WHERE n <= 5")
def order_both(spark, d):
    """Samples and regions ordered in one call."""
    return dataset(spark, d).order([("score", False)], [("acctbal", False)], {"top": 4}, top=5).regions


@query(f"SELECT {REGION}, n AS \"order\" FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, chrom ORDER BY score DESC NULLS LAST, start, stop, strand, x) AS n FROM regions) WHERE n <= 2")
def order_topg(spark, d):
    return dataset(spark, d).order([("chrom", True), ("score", False)], top=2, within_leading=True).regions


@query(f"SELECT {REGION}, n AS \"order\" FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score ASC NULLS LAST, chrom, start, stop, strand, x) AS n, count(*) OVER (PARTITION BY sample_id) AS c FROM regions) WHERE n <= floor(c * 1.5 / 100)")
def order_topp(spark, d):
    return dataset(spark, d).order([("score", True)], percent=1.5).regions


@query("SELECT sample_id, n AS position FROM (SELECT sample_id, row_number() OVER (ORDER BY max(CASE WHEN attribute = 'acctbal' THEN CAST(value AS DOUBLE) END) DESC, sample_id) AS n FROM (SELECT * FROM meta WHERE attribute = 'acctbal') GROUP BY sample_id) WHERE n <= 4")
def order_meta(spark, d):
    return M.order(meta_table(spark, d), [("acctbal", False)], top=4).where("attribute = '_order'").select("sample_id", F.col("value").cast("long").alias("position"))


@query("SELECT sample_id, n AS position FROM (SELECT sample_id, row_number() OVER (PARTITION BY sample_id % 3 ORDER BY max(CAST(value AS DOUBLE)) DESC, sample_id) AS n FROM (SELECT * FROM meta WHERE attribute = 'acctbal') GROUP BY sample_id) WHERE n <= 1")
def order_meta_topg(spark, d):
    return M.order(meta_table(spark, d), [("third", True), ("acctbal", False)], top=1, within_leading=True).where("attribute = '_order'").select("sample_id", F.col("value").cast("long").alias("position"))


# --- datasets as a whole: new ids, in SQL from the MD5 of both ids' bytes, and the metadata of the result ---


def _sql_id(data: str) -> str:
    """The first eight bytes of the MD5, read in little-endian order."""
    u = f"CAST('0x' || {' || '.join(f'substr(md5({data}), {i}, 2)' for i in range(15, 0, -2))} AS UBIGINT)"
    return f"CAST(CASE WHEN {u} > 9223372036854775807 THEN CAST({u} AS HUGEINT) - 18446744073709551616 ELSE {u} END AS BIGINT)"


def _sql_bytes(*ids: str) -> str:
    """Ids below 10 as the bytes of longs."""
    return "unhex(" + " || ".join(f"'0' || CAST({i} AS VARCHAR) || '00000000000000'" for i in ids) + ")"


PAIR = _sql_id(_sql_bytes("r.sample_id", "e.sample_id"))
SINGLE = _sql_id(_sql_bytes("sample_id"))
FILE = _sql_id("encode('S_0000' || CAST(sample_id AS VARCHAR) || '.{0}')")


@query(f", pairs AS (SELECT DISTINCT {PAIR} AS id, r.sample_id AS a, e.sample_id AS b FROM ref r, (SELECT DISTINCT sample_id FROM ex) e), m AS ({_map_sql('')}) SELECT id AS sample_id, chrom, start, stop, strand, score, x, count FROM m JOIN pairs ON a = ref_id AND b = exp_id")
def dataset_map(spark, d):
    return ref(spark, d).map(exp(spark, d), bin_size=BIN).regions


META_PAIRS = "SELECT DISTINCT r.sample_id AS a, e.sample_id AS b, {0} AS id FROM (SELECT DISTINCT sample_id FROM meta WHERE sample_id < 2) r, (SELECT DISTINCT sample_id FROM meta WHERE sample_id >= 2) e".format(PAIR)


@query(f", p AS ({META_PAIRS}) SELECT DISTINCT id AS sample_id, 'left.' || attribute AS attribute, value FROM p JOIN meta ON sample_id = a UNION SELECT DISTINCT id, 'right.' || attribute, value FROM p JOIN meta ON sample_id = b")
def dataset_map_meta(spark, d):
    return ref(spark, d).map(exp(spark, d)).meta


@query(f", p AS ({META_PAIRS}) SELECT DISTINCT id AS sample_id, attribute, value FROM p JOIN meta ON sample_id = a")
def dataset_join_meta(spark, d):
    """A DISTINCT builder keeps one side's metadata, without a prefix."""
    return ref(spark, d).join(exp(spark, d), [G.DistLess(0)], "LEFT_DISTINCT").meta


@query(f"SELECT {SINGLE} AS sample_id, chrom, start, stop, strand, score, x FROM ref r WHERE sample_id = 0 AND NOT EXISTS (SELECT 1 FROM ex e WHERE e.sample_id = 3 AND r.chrom = e.chrom AND {OVERLAP} AND {STRAND})")
def difference_unpaired(spark, d):
    """A ref sample without a partner goes."""
    return ref(spark, d).difference(dataset(spark, d, 3), ["third"]).regions


@query(f"SELECT {SINGLE} AS sample_id, 'left.' || attribute AS attribute, value FROM meta WHERE sample_id = 0")
def difference_meta(spark, d):
    return ref(spark, d).difference(dataset(spark, d, 3), ["third"]).meta


@query(f", u AS (SELECT 0 AS side, * FROM regions WHERE sample_id < 2 UNION ALL SELECT 1, * FROM regions WHERE sample_id >= 2) SELECT {_sql_id(_sql_bytes('side', 'sample_id'))} AS sample_id, chrom, start, stop, strand, score, x FROM u")
def union_ids(spark, d):
    return ref(spark, d).union(exp(spark, d)).regions


@query("SELECT DISTINCT sample_id, attribute, value FROM meta WHERE sample_id < 2 OR sample_id IN (3, 4)")
def union_meta_aggregated(spark, d):
    return ref(spark, d).union_meta(dataset(spark, d, 1, 3, 4)).meta


@query("SELECT DISTINCT CAST(sample_id % 3 + 1 AS BIGINT) AS sample_id, attribute, value FROM meta")
def cover_meta(spark, d):
    return dataset(spark, d).cover(attributes=["third"]).meta


@query("SELECT sample_id, attribute, value FROM meta WHERE sample_id IN (SELECT sample_id FROM regions WHERE chrom = 'chr7' AND x > 0.09 AND sample_id < 4)")
def purge_meta(spark, d):
    ds = dataset(spark, d)
    return Dataset(ds.regions.where("chrom = 'chr7' AND x > 0.09 AND sample_id < 4"), ds.meta).purge().meta


@query(_map_sql(", round(quantile_cont(e.score, 0.5), 4) AS median, round(quantile_cont(e.score, 0.25), 4) AS q1, round(quantile_cont(e.score, 0.75), 4) AS q3, round(stddev_samp(e.score), 4) AS std, coalesce((string_agg(DISTINCT CAST(CAST(round(e.x * 100) AS INT) AS VARCHAR), ' ' ORDER BY CAST(CAST(round(e.x * 100) AS INT) AS VARCHAR))), '') AS bag"))
def map_quantiles(spark, d):
    a, b = ref(spark, d), exp(spark, d)
    rows = b.regions.withColumn("p", F.round(F.col("x") * 100).cast("int"))
    aggs = {"median": ("MEDIAN", "score"), "q1": ("Q1", "score"), "q3": ("Q3", "score"), "std": ("STD", "score"), "bag": ("BAGD", "p")}
    return G.map_regions(a.regions, rows, a.pairs(b), aggs, bin_size=BIN, every=True).withColumns({n: F.round(n, 4) for n in ("median", "q1", "q3", "std")})


@query(f"SELECT {REGION}, row_number() OVER (PARTITION BY sample_id ORDER BY score ASC NULLS LAST, chrom, start, stop, strand, x) AS \"order\" FROM regions")
def order_all(spark, d):
    return dataset(spark, d).order([("score", True)]).regions


@query("SELECT sample_id, chrom, start, stop, strand, score, y, row_number() OVER (PARTITION BY sample_id, chrom ORDER BY y DESC NULLS LAST, start, stop, strand, score) AS \"order\" FROM (SELECT *, CASE WHEN x > 0.03 THEN x END AS y FROM regions)")
def order_nulls(spark, d):
    rows = dataset(spark, d).regions.withColumn("y", F.when(F.col("x") > 0.03, F.col("x"))).drop("x")
    return R.order(rows, [("chrom", True), ("y", False)], within_leading=True)


@query(f"SELECT {REGION}, row_number() OVER (PARTITION BY sample_id ORDER BY chrom DESC NULLS LAST, score, start, stop, strand, x) AS \"order\" FROM regions")
def order_strings(spark, d):
    return dataset(spark, d).order([("chrom", False), ("score", True)]).regions


@query("SELECT sample_id, value FROM (SELECT DISTINCT sample_id, CAST(sample_id % 3 + 1 AS VARCHAR) AS value FROM meta)")
def order_meta_group_id(spark, d):
    return M.order(meta_table(spark, d), [("third", True), ("acctbal", False)], within_leading=True).where("attribute = 'acctbal_groupId'").select("sample_id", "value")


@query("SELECT sample_id, row_number() OVER (ORDER BY v ASC NULLS FIRST, sample_id) AS position FROM (SELECT sample_id, min(CASE WHEN attribute = 'acctbal' AND sample_id <> 4 THEN CAST(value AS DOUBLE) END) AS v FROM meta GROUP BY 1) QUALIFY position <= floor(count(*) OVER () * 50 / 100)")
def order_meta_missing(spark, d):
    """A sample without the key comes first ascending; half of the samples stay."""
    meta = meta_table(spark, d).where("NOT (sample_id = 4 AND attribute = 'acctbal')")
    return M.order(meta, [("acctbal", True)], percent=50).where("attribute = '_order'").select("sample_id", F.col("value").cast("long").alias("position"))


# --- files: what is written to the shared folder is read again ---


def _stored(spark, d, kind: str, **options) -> Dataset:
    folder = files.scratch(spark)
    files.write(dataset(spark, d), folder, kind)
    return files.read(spark, f"{folder}/files", **options) if options else files.read_written(spark, folder, kind)


@query(f"SELECT {FILE.format('gdm')} AS sample_id, chrom, start, stop, strand, score, x FROM regions")
def files_tab(spark, d):
    return _stored(spark, d, "tab").regions


@query(f"SELECT {FILE.format('gdm')} AS sample_id, attribute, value FROM meta")
def files_meta(spark, d):
    return _stored(spark, d, "tab").meta


@query(f"SELECT {FILE.format('gtf')} AS sample_id, chrom, start, stop, strand, score, x FROM regions")
def files_gtf(spark, d):
    return _stored(spark, d, "gtf").regions


@query(f"SELECT {REGION} FROM regions")
def files_parquet(spark, d):
    return _stored(spark, d, "parquet").regions.select(*REGION.split(", "))


@query(f"SELECT {FILE.format('gdm')} AS sample_id, chrom, start, stop, strand, score, x FROM regions WHERE sample_id % 3 = 1")
def files_select(spark, d):
    """Only the files of samples that satisfy the predicate are opened."""
    return _stored(spark, d, "tab", where=M.attribute("third") == 1).regions


@query(f"SELECT {REGION} FROM regions WHERE sample_id % 3 <> 1 AND chrom = 'chr2'")
def files_index(spark, d):
    """A stored dataset with an index of its metadata, by which samples are chosen."""
    folder = files.scratch(spark)
    files.write(dataset(spark, d), folder, index=True)
    return files.read_written(spark, folder, where=~(M.attribute("third") == 1), region=lambda r: r.chrom == "chr2", index=True).regions.select(*REGION.split(", "))


@query(f"SELECT {REGION} FROM regions WHERE sample_id % 3 = 1 AND chrom = 'chr2' AND start < 50000")
def files_where(spark, d):
    """Of a stored dataset, the folders of some samples and the row groups of some places are read."""
    folder = files.scratch(spark)
    files.write(dataset(spark, d), folder)
    return files.read_written(spark, folder, where=M.attribute("third") == 1, region=lambda r: (r.chrom == "chr2") & (r.left < 50_000)).regions.select(*REGION.split(", "))


@query(f"SELECT {REGION} FROM regions")
def files_matrix_values(spark, d):
    """Every cell of the written matrix, read back from its line."""
    folder = files.scratch(spark)
    files.write_matrix(dataset(spark, d).to_matrix(), folder)
    cell = F.split("value", "\t")
    values = F.split(cell[5], ", ")
    kinds = {"sample_id": (cell[0], "long"), "chrom": (cell[1], "string"), "start": (cell[2], "long"), "stop": (cell[3], "long"), "strand": (cell[4], "string"), "score": (values[0], "double"), "x": (values[1], "double")}
    return spark.read.text(folder).select(*(c.cast(t).alias(n) for n, (c, t) in kinds.items()))


@query("SELECT sample_id, count(*) AS lines FROM regions GROUP BY 1")
def files_matrix(spark, d):
    folder = files.scratch(spark)
    files.write_matrix(dataset(spark, d).to_matrix(), folder)
    return spark.read.text(folder).groupBy(F.split("value", "\t")[0].cast("long").alias("sample_id")).agg(F.count("*").alias("lines"))


# --- coverage: in SQL by a running sum over all events, without stripes ---


def _cover_sql(kind: str, low: str, high: str, group: str = "CAST(0 AS BIGINT)") -> str:
    ok = lambda v: f"({v} > 0 AND {v} >= {low} AND {v} <= {high})"
    p = "PARTITION BY g, chrom"
    head = f""", rows0 AS (SELECT {group} AS g, chrom, start, stop FROM regions), nets AS (SELECT g, chrom, pos, sum(net) AS net FROM (SELECT g, chrom, start AS pos, 1 AS net FROM rows0 UNION ALL SELECT g, chrom, stop, -1 FROM rows0) GROUP BY 1, 2, 3 HAVING sum(net) <> 0),
runs AS (SELECT g, chrom, pos AS start, lead(pos) OVER ({p} ORDER BY pos) AS stop, sum(net) OVER ({p} ORDER BY pos) AS d, sum(net) OVER ({p} ORDER BY pos) - net AS b, sum(net) OVER ({p} ORDER BY pos) + lead(net) OVER ({p} ORDER BY pos) AS a FROM nets),
good AS (SELECT *, {ok("b")} AS okb, {ok("a")} AS oka FROM runs WHERE stop IS NOT NULL AND {ok("d")})
"""
    if kind == "HISTOGRAM":
        return head + "SELECT g AS sample_id, chrom, start, stop, '*' AS strand, CAST(d AS BIGINT) AS accumulation FROM good"
    if kind == "SUMMIT":
        return head + "SELECT g AS sample_id, chrom, start, stop, '*' AS strand, CAST(d AS BIGINT) AS accumulation FROM good WHERE (d > b AND (a < d OR NOT oka)) OR (NOT okb AND a < d)"
    islands = head + f", isl AS (SELECT *, sum(CASE WHEN okb THEN 0 ELSE 1 END) OVER ({p} ORDER BY start) AS k FROM good), cov AS (SELECT g, chrom, min(start) AS start, max(stop) AS stop, CAST(max(d) AS BIGINT) AS accumulation FROM isl GROUP BY g, chrom, k)\n"
    if kind == "FLAT":
        return islands + "SELECT c.g AS sample_id, c.chrom, min(e.start) AS start, max(e.stop) AS stop, '*' AS strand, accumulation FROM cov c JOIN rows0 e ON e.g = c.g AND e.chrom = c.chrom AND e.start < c.stop AND c.start < e.stop GROUP BY c.g, c.chrom, c.start, c.stop, accumulation"
    if kind == "JACCARD":
        return islands + """SELECT c.g AS sample_id, c.chrom, c.start, c.stop, '*' AS strand, accumulation, round((c.stop - c.start) / (max(e.stop) - min(e.start)), 9) AS jaccard_intersect,
round(greatest(min(e.stop) - max(e.start), 0) / (max(e.stop) - min(e.start)), 9) AS jaccard_result, count(*) AS n FROM cov c JOIN rows0 e ON e.g = c.g AND e.chrom = c.chrom AND e.start < c.stop AND c.start < e.stop GROUP BY c.g, c.chrom, c.start, c.stop, accumulation"""
    return islands + "SELECT g AS sample_id, chrom, start, stop, '*' AS strand, accumulation FROM cov"


@query(_cover_sql("COVER", "2", "2147483647"))
def cover(spark, d):
    return dataset(spark, d).cover("COVER", 2, C.ANY).regions


@query(_cover_sql("COVER", "1", "2", "sample_id % 3 + 1"))
def cover_groupby(spark, d):
    return dataset(spark, d).cover("COVER", C.ANY, C.ALL, ["third"]).regions


@query(_cover_sql("COVER", "3", "2147483647"))
def cover_half(spark, d):
    """At least half of the samples."""
    return dataset(spark, d).cover("COVER", lambda n: n / 2, C.ANY).regions


@query(_cover_sql("HISTOGRAM", "1", "2147483647"))
def histogram(spark, d):
    return dataset(spark, d).cover("HISTOGRAM").regions


@query(_cover_sql("FLAT", "3", "2147483647"))
def flat(spark, d):
    return C.cover(region_table(spark, d), "FLAT", 3, bin_size=BIN)


@query(_cover_sql("SUMMIT", "2", "6"))
def summit(spark, d):
    return dataset(spark, d).cover("SUMMIT", 2, C.ALL).regions


@query(_cover_sql("JACCARD", "2", "4"))
def cover_jaccard(spark, d):
    out = C.cover(region_table(spark, d), "COVER", 2, 4, aggregates={"n": ("COUNT", "score")}, jaccard=True, bin_size=BIN)
    return out.withColumns({c: F.round(c, 9) for c in ("jaccard_intersect", "jaccard_result")})


@query(f"SELECT {REGION} FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY chrom, start, stop, strand, score, x) AS n FROM regions) WHERE n <= 3")
def take_per_sample(spark, d):
    return dataset(spark, d).take(3).regions


@query(f"SELECT {REGION} FROM regions")
def matrix_roundtrip(spark, d):
    return X.to_rows(dataset(spark, d).to_matrix())


@query(f"""SELECT chrom, start, stop, strand, sample_id, CAST(sum(n) AS BIGINT) AS count FROM (SELECT r.chrom, r.start, r.stop, r.strand, s.sample_id, CASE WHEN e.start IS NULL THEN 0 ELSE 1 END AS n FROM (SELECT DISTINCT chrom, start, stop, strand FROM ref) r
CROSS JOIN (SELECT DISTINCT sample_id FROM ex) s LEFT JOIN ex e ON e.sample_id = s.sample_id AND e.chrom = r.chrom AND {OVERLAP} AND {STRAND}) GROUP BY 1, 2, 3, 4, 5""")
def matrix_map(spark, d):
    a, b = ref(spark, d).to_matrix(), exp(spark, d).to_matrix()
    return X.matrix_map(a, b, bin_size=BIN).select(*COORDS, F.inline("counts"))


@query(_join_sql(OVERLAP))
def matrix_join(spark, d):
    joined = X.matrix_join(ref(spark, d).to_matrix(), exp(spark, d).to_matrix(), bin_size=BIN)
    return _matrix_rows(joined)


@query(f"""SELECT r.sample_id AS ref_id, e.sample_id AS exp_id, t.sample_id AS third_id, r.chrom, r.start, r.stop, r.strand, r.score, e.score AS right_score, t.score AS third_score
FROM ref r JOIN ex e ON e.sample_id < 4 AND r.chrom = e.chrom AND {STRAND} AND {OVERLAP}
JOIN ex t ON t.sample_id >= 4 AND r.chrom = t.chrom AND {STRAND.replace("e.", "t.")} AND {OVERLAP.replace("e.", "t.")}""")
def matrix_join_three(spark, d):
    """Three operands; their cross product is only made where rows are."""
    two = X.matrix_join(ref(spark, d).to_matrix(), dataset(spark, d, 2, 3).to_matrix(), bin_size=BIN)
    three = X.matrix_join(two, dataset(spark, d, 4, 5).to_matrix(), column="third_cells", bin_size=BIN)
    rows = X.crossed(three, ["cells", "right_cells", "third_cells"])
    cells = {"ref_id": "cells_sample_id", "exp_id": "right_cells_sample_id", "third_id": "third_cells_sample_id", "score": "cells_value.vals.score", "right_score": "right_cells_value.vals.score", "third_score": "third_cells_value.vals.score"}
    return rows.select(*COORDS, *(F.col(c).alias(n) for n, c in cells.items()))


@query(f"""SELECT e.sample_id, CAST(count(DISTINCT (r.chrom, r.start, r.stop, r.strand)) AS BIGINT) AS coordinates, CAST(count(*) AS BIGINT) AS hits
FROM (SELECT DISTINCT chrom, start, stop, strand FROM ref) r JOIN ex e ON e.chrom = r.chrom AND {OVERLAP} AND {STRAND} GROUP BY 1""")
def matrix_sparse(spark, d):
    """Cells of the samples that hit a coordinate alone, summed by sample."""
    return X.sample_totals(X.matrix_map(ref(spark, d).to_matrix(), exp(spark, d).to_matrix(), bin_size=BIN, zeros=False))


@query(f"""SELECT r.sample_id AS ref_id, e.sample_id AS exp_id, r.chrom, r.start, r.stop, r.strand, {VALUES} FROM ref r JOIN (SELECT *, dense_rank() OVER (PARTITION BY chrom, start, stop, strand ORDER BY gap) AS k
FROM (SELECT r.chrom, r.start, r.stop, r.strand, e.start AS e_start, e.stop AS e_stop, e.strand AS e_strand, {DIST} AS gap FROM (SELECT DISTINCT chrom, start, stop, strand FROM ref) r JOIN (SELECT DISTINCT chrom, start, stop, strand FROM ex) e ON r.chrom = e.chrom AND {STRAND} AND {DIST} < 300)) n
ON n.k = 1 AND r.chrom = n.chrom AND r.start = n.start AND r.stop = n.stop AND r.strand = n.strand JOIN ex e ON e.chrom = n.chrom AND e.start = n.e_start AND e.stop = n.e_stop AND e.strand = n.e_strand""")
def matrix_nearest(spark, d):
    """The nearest coordinates of the right matrix."""
    return _matrix_rows(X.matrix_join(ref(spark, d).to_matrix(), exp(spark, d).to_matrix(), [G.DistLess(300), G.MinDistance(1)], bin_size=BIN))


def _matrix_rows(joined: DataFrame) -> DataFrame:
    rows = X.crossed(joined, ["cells", "right_cells"])
    return rows.select(F.col("cells_sample_id").alias("ref_id"), F.col("right_cells_sample_id").alias("exp_id"), *COORDS, "cells_value.vals.score", "cells_value.vals.x", F.col("right_cells_value.vals.score").alias("right_score"), F.col("right_cells_value.vals.x").alias("right_x"))


@query(_join_sql(OVERLAP, f"{IDS}, e.start, e.stop, e.strand, {VALUES}"))
def matrix_join_right(spark, d):
    return _matrix_rows(X.matrix_join(ref(spark, d).to_matrix(), exp(spark, d).to_matrix(), builder="RIGHT", bin_size=BIN))


@query(_join_sql(OVERLAP, f"{PAIR} AS sample_id, r.chrom, least(r.start, e.start) AS start, greatest(r.stop, e.stop) AS stop, {JOINT}, {VALUES}"))
def matrix_join_regrouped(spark, d):
    """The matches as a matrix by the builder's coordinates, under the pairs' ids."""
    joined = X.matrix_join(ref(spark, d).to_matrix(), exp(spark, d).to_matrix(), builder="CONTIG", bin_size=BIN)
    return X.to_rows(X.regrouped(joined))


@query(f", j AS ({_join_sql(OVERLAP, f'{PAIR} AS sample_id, r.chrom, least(r.start, e.start) AS start, greatest(r.stop, e.stop) AS stop, {JOINT}')}) SELECT c.chrom, c.start, c.stop, c.strand, CAST(count(e.start) AS BIGINT) AS hits FROM (SELECT DISTINCT chrom, start, stop, strand FROM j) c LEFT JOIN (SELECT * FROM regions WHERE sample_id = 5) e ON e.chrom = c.chrom AND c.start < e.stop AND e.start < c.stop AND (c.strand = '*' OR e.strand = '*' OR c.strand = e.strand) GROUP BY ALL")
def matrix_chain(spark, d):
    """A join's matrix, mapped further."""
    joined = X.regrouped(X.matrix_join(ref(spark, d).to_matrix(), exp(spark, d).to_matrix(), builder="CONTIG", bin_size=BIN))
    return X.matrix_map(joined, dataset(spark, d, 5).to_matrix(), bin_size=BIN).select(*COORDS, F.col("counts")[0]["count"].alias("hits"))


# --- chains of MAP and JOIN over the samples A to F ---


def _one(spark, d, sample: int) -> DataFrame:
    return region_table(spark, d).where(F.col("sample_id") == sample).select("sample_id", *COORDS)


def _source(spark, d, sample: int) -> flow.Step:
    return flow.Step(lambda: _one(spark, d, sample))


def _chain_map(a: flow.Step, b: flow.Step, ids: tuple[int, int], aggregates=None, count="count") -> flow.Step:
    """ids: the sample on each side; a chain keeps the left one's."""

    def make(ref: DataFrame, exp: DataFrame) -> DataFrame:
        pairs = ref.sparkSession.range(1).select(*(F.lit(i).cast("long").alias(n) for i, n in zip(ids, ("ref_id", "exp_id"), strict=True)))
        return G.map_regions(ref, exp, pairs, aggregates, count, bin_size=BIN, every=True).drop("exp_id").withColumnRenamed("ref_id", "sample_id")

    return a.then(make, b, reads=flow.READS["map"])


def _chain_join(a: flow.Step, b: flow.Step) -> flow.Step:
    make = lambda ref, exp: G.join(ref, exp, [G.DistLess(0)], bin_size=BIN).drop("exp_id").withColumnRenamed("ref_id", "sample_id")
    return a.then(make, b, reads=flow.READS["join"])


def _t(sample: int) -> str:
    return f"(SELECT sample_id, chrom, start, stop, strand FROM regions WHERE sample_id = {sample})"


def _sql_map(a: str, b: str, keep: str = "", extra: str = "", count: str = "count") -> str:
    own = f"r.sample_id, r.chrom, r.start, r.stop, r.strand{keep}"
    return f"(SELECT {own}, count(e.start) AS {count}{extra} FROM (SELECT *, row_number() OVER () AS rid FROM {a}) r LEFT JOIN {b} e ON e.chrom = r.chrom AND {OVERLAP} AND {STRAND} GROUP BY r.rid, {own})"


def _sql_join(a: str, b: str, values: str) -> str:
    return f"(SELECT r.sample_id, r.chrom, r.start, r.stop, r.strand{values} FROM {a} r JOIN {b} e ON r.chrom = e.chrom AND {OVERLAP} AND {STRAND})"


@query(f"SELECT * FROM {_sql_map(_t(0), _sql_map(_t(1), _t(2)), extra=', CAST(sum(e.count) AS BIGINT) AS inner_hits')}")
def complex_1(spark, d):
    a, b, c = (_source(spark, d, k) for k in range(3))
    return flow.run([_chain_map(a, _chain_map(b, c, (1, 2)), (0, 1), {"inner_hits": ("SUM", "count")})])[0]


@query(f"SELECT * FROM {_sql_join(_sql_map(_t(0), _t(1)), _t(2), ', r.count')}")
def complex_2(spark, d):
    a, b, c = (_source(spark, d, k) for k in range(3))
    return flow.run([_chain_join(_chain_map(a, b, (0, 1)), c)])[0]


@query(f"SELECT * FROM {_sql_map(_sql_join(_sql_map(_t(0), _t(1), count='n1'), _t(2), ', r.n1'), _t(3), ', r.n1', count='n2')}")
def complex_3(spark, d):
    a, b, c, e = (_source(spark, d, k) for k in range(4))
    return flow.run([_chain_map(_chain_join(_chain_map(a, b, (0, 1), count="n1"), c), e, (0, 3), count="n2")])[0]


@query(f"SELECT * FROM {_sql_join(_sql_join(_sql_map(_t(0), _t(1), count='n1'), _sql_map(_t(2), _t(3), count='n2'), ', r.n1, e.n2'), _sql_map(_t(4), _t(5), count='n3'), ', r.n1, r.n2, e.n3')}")
def complex_4(spark, d):
    a, b, c, e, f, g = (_source(spark, d, k) for k in range(6))
    first = _chain_join(_chain_map(a, b, (0, 1), count="n1"), _chain_map(c, e, (2, 3), count="n2"))
    return flow.run([_chain_join(first, _chain_map(f, g, (4, 5), count="n3"))])[0]


@query(_map_sql(", round(sum(e.score), 2) AS total").replace("SELECT r.sample_id AS ref_id, p.b AS exp_id", "SELECT 'map' AS part, r.sample_id * 10 + p.b AS sample_id").replace("r.score, r.x, count(e.start) AS count", "count(e.start) AS count") + f" UNION ALL SELECT 'difference', r.sample_id, r.chrom, r.start, r.stop, r.strand, NULL, NULL FROM ref r WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM ex WHERE sample_id = 5) e WHERE e.chrom = r.chrom AND {OVERLAP} AND {STRAND})")
def several_results(spark, d):
    """A MAP and a DIFFERENCE of the same selection, which is computed once."""
    source = flow.Step(lambda: dataset(spark, d))
    left = source.then(lambda ds: ds.select(meta=M.attribute("third") < 3))
    ours = left.then(lambda ds: Dataset(ds.regions.where("sample_id < 2"), ds.meta.where("sample_id < 2")))
    theirs = left.then(lambda ds: Dataset(ds.regions.where("sample_id >= 2"), ds.meta.where("sample_id >= 2")))
    last = left.then(lambda ds: Dataset(ds.regions.where("sample_id = 5"), ds.meta.where("sample_id = 5")))
    mapped = ours.then(lambda a, b: G.map_regions(a.regions, b.regions, a.pairs(b), {"total": (lambda c: F.round(F.sum(c), 2), "score")}, bin_size=BIN, every=True), theirs, reads=flow.READS["map"])
    other = ours.then(lambda a, b: G.difference(a.regions, b.regions, bin_size=BIN), last, reads=flow.READS["difference"])
    hits, rest = flow.run([mapped, other])
    none = F.lit(None)
    first = hits.select(F.lit("map").alias("part"), (F.col("ref_id") * 10 + F.col("exp_id")).alias("sample_id"), *COORDS, "count", "total")
    return first.unionByName(rest.select(F.lit("difference").alias("part"), "sample_id", *COORDS, none.cast("long").alias("count"), none.cast("double").alias("total")))
