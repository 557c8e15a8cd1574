"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a share of the words of all sources, in proportion to its weight, but at most ``cap`` times its
own words; what is cut off goes to the other sources by weight until none is above its cap. A document is taken
floor(rate) times, and once more with the probability f of the fraction, decided by a hash of seed and doc_id. The taken
words of a source thus have the target as their mean and the sum of size * size * f * (1 - f) over its documents as
their variance: near the target where a source has many documents, while one of 50 documents of 1 to 20,000 words can be
off by a third. Only whole documents are taken, so nothing closer can be had without favouring some of them.

Defined cases: null or blank text counts 0 words and is taken like any other document of its source; a null source
is a source of its own, last in order; rows that share a doc_id draw alike; a null doc_id draws as the text
``null``; an empty table gives an empty result; a source without words has target and rate 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_up_to, checkpointed, packed, unpacked

#: The plan, a row for each source, is broadcast up to so many rows.
BROADCAST = 200_000


def n_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space: one more than the spaces, once white space is single spaces. No array of words is made."""
    t = F.coalesce(text, F.lit(""))
    for blank in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(blank), F.lit(" "))
    t = F.btrim(F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " +", " ")).otherwise(t), F.lit(" "))
    return F.when(t == "", F.lit(0)).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(_source, _source_size) to the same with _target. One row per source, so the windows here see sources, not documents.

    The water level is found in closed form: with the sources in order of cap/weight, the first at which the level
    that the rest would share stays under its own cap gives the level of all that follow.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    ranked = sizes.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long"))
    order = [F.col("_source_size") / F.col("_weight"), F.col("_source").asc_nulls_last()]
    before, rest, every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumn("_level", (F.sum("_source_size").over(every) - F.lit(cap) * F.coalesce(F.sum("_source_size").over(before), F.lit(0))).cast("double") / F.sum("_weight").over(rest))
    fits = F.col("_level") <= (F.lit(cap) * F.col("_source_size")).cast("double") / F.col("_weight")
    level = F.min(F.when(fits, F.struct((F.col("_source_size") / F.col("_weight")).alias("r"), F.col("_source").isNull().alias("z"), F.col("_source").alias("s"), F.col("_level").alias("level")))).over(every)["level"]
    return levels.select("_source", "_source_size", F.least((F.lit(cap) * F.col("_source_size")).cast("double"), level * F.col("_weight")).alias("_target"))


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) that hangs on the seed and the document's id alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def assign_copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(_row, _size, _source_size, _target, _copies) for each row; _copies is the number of times that the mix takes it."""
    sized = packed(docs, _size=n_words(F.col(text_col)), _from=F.col(source_col), _of=F.col(id_col))
    # partial sums keep a hot source from being one task's work; the plan has one row per source
    plan = checkpointed(source_targets(sized.groupBy(F.col("_from").alias("_source")).agg(F.sum("_size").alias("_source_size")), weights, cap))
    rows, salts = plan.count(), 16
    if rows <= BROADCAST:
        joined = sized.join(broadcast_up_to(plan, rows), F.col("_from").eqNullSafe(F.col("_source")))
    else:  # a shuffle join with the hot source's rows spread
        plan = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        sized = sized.withColumn("_deal", F.pmod(F.xxhash64("_of"), F.lit(salts)).cast("int"))
        joined = sized.join(plan, F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_deal") == F.col("_salt"))).drop("_salt", "_deal")
    rate = F.when(F.col("_source_size") > 0, F.least(F.lit(float(cap)), F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0.0))
    return joined.withColumn("_copies", (F.floor(rate) + F.when(draw("_of", seed) < rate - F.floor(rate), 1).otherwise(0)).cast("int")).select("_row", "_size", "_source_size", "_target", "_copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each as often as assign_copies says, with the columns of docs."""
    taken = assign_copies(docs, **options).where("_copies > 0")
    return unpacked(taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))), docs)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import load

    return assign_copies(load(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("_row.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
b AS (SELECT level FROM l WHERE level <= CAST(3 * source_size AS DOUBLE) / w ORDER BY source_size / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), b.level * w) AS target FROM l, b),
x AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, t.target / t.source_size) ELSE 0::DOUBLE END AS rate,
  CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""
