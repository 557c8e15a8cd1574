"""Counts and neighbours from sorted positions, without making pairs.

Positions of two sides are put in one order, in stripes of the coordinate: a window runs inside a stripe, and what the
stripes before hold (their sums, or their last positions) is carried over by a window with one row for each stripe. So the work
is linear in rows, however many regions lie over each other, and a chromosome is as many tasks as it has stripes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRIPE = 1 << 22


def _striped(df: DataFrame) -> DataFrame:
    return df.withColumn("_stripe", F.floor(F.col("_pos") / STRIPE))


def _entry(side: int, pos: Column, order: Column) -> Column:
    return F.struct(F.lit(side).alias("_side"), pos.cast("long").alias("_pos"), order.cast("int").alias("_ord"))


def overlap_counts(asked: DataFrame, exp: DataFrame, count: str = "count") -> DataFrame:
    """asked (chrom, start, stop, strand, exp_id and more columns; no row twice) with the number of strand-compatible regions of the sample exp_id that overlap each row.

    Regions overlap if one starts below the other's stop and stops above its start. So the number is that of starts
    below the row's stop less that of stops up to the row's start, counted by strand. Where the row and a region are both
    empty and at one place, the region's stop stands behind the row's start, as its start does.
    """
    axis = ["exp_id", "chrom", "_side"]
    known = exp.where(F.col("chrom").isNotNull() & F.col("start").isNotNull() & F.col("stop").isNotNull())
    marks = known.select(F.col("sample_id").alias("exp_id"), "chrom", F.col("strand").alias("_s"), F.inline(F.array(_entry(0, F.col("start"), F.lit(1)), _entry(1, F.col("stop"), F.when(F.col("start") < F.col("stop"), 0).otherwise(2)))))
    of = lambda strand: F.count(F.when(F.col("_s") == strand, 1))
    sums = {"_plus": of("+"), "_minus": of("-"), "_star": of("*"), "_all": F.count(F.lit(1))}
    marks = marks.groupBy(*axis, "_pos", "_ord").agg(*(c.alias(n) for n, c in sums.items()))
    # the row's own columns travel in a struct, so that none can clash
    rows = asked.select("exp_id", "chrom", F.struct(*asked.columns).alias("_row"), F.inline(F.array(_entry(0, F.col("stop"), F.lit(0)), _entry(1, F.col("start"), F.when(F.col("start") < F.col("stop"), 3).otherwise(1)))))
    both = _striped(marks.unionByName(rows, allowMissingColumns=True))
    stripes = both.groupBy(*axis, "_stripe").agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums))
    before = Window.partitionBy(*axis).orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    carried = stripes.select(*axis, "_stripe", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in sums))
    inside = Window.partitionBy(*axis, "_stripe").orderBy("_pos", "_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.select("*", *(F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"{n}_here") for n in sums)).where(F.col("_row").isNotNull())
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*axis, "_stripe")]
    met = met.alias("m").join(carried.alias("c"), same, "left")
    n = {c: F.coalesce(F.col(f"m.{c}_here") + F.col(f"c.{c}_before"), F.lit(0)) for c in sums}
    strand = F.col("m._row.strand")
    fit = F.when(strand == "*", n["_all"]).when(strand == "+", n["_plus"] + n["_star"]).when(strand == "-", n["_minus"] + n["_star"]).otherwise(n["_star"])
    found = met.select(F.col("m._row").alias("_row"), F.when(F.col("m._side") == 0, fit).otherwise(-fit).alias("_n")).groupBy("_row").agg(F.sum("_n").alias("_n"))
    whole = F.col("_row.chrom").isNotNull() & F.col("_row.start").isNotNull() & F.col("_row.stop").isNotNull()
    return found.select("_row.*", F.when(whole, F.col("_n")).otherwise(0).cast("long").alias(count))


def neighbours(asked: DataFrame, exp: DataFrame, k: int, apart: int = 0, on: list[str] = ()) -> DataFrame:
    """asked with _side and _pos: the k nearest distinct stops of strand-compatible regions of exp_id at or below start - apart (side 0), and, negated, starts at or above stop + apart (side 1).

    on lists columns that must be equal on both sides.
    """
    axis = ["exp_id", "chrom", *on, "_axis", "_side"]
    strand = F.col("strand")
    # a region with a strand is seen by rows of that strand and by unstranded ones; an unstranded region by all
    axes = F.when(strand == "*", F.array(F.lit("+"), F.lit("-"), F.lit("*"))).otherwise(F.array(strand, F.lit("*")))
    marks = exp.select(F.col("sample_id").alias("exp_id"), "chrom", *on, F.explode(axes).alias("_axis"), "start", "stop")
    marks = marks.select("exp_id", "chrom", *on, "_axis", F.inline(F.array(_entry(0, F.col("stop"), F.lit(0)), _entry(1, -F.col("start"), F.lit(0))))).where("_pos is not null").distinct()
    last = Window.partitionBy(*axis, "_stripe").orderBy("_pos").rowsBetween(1 - k, Window.currentRow)
    marks = _striped(marks).withColumn("_near", F.collect_list("_pos").over(last))
    rows = asked.select("exp_id", "chrom", *on, strand.alias("_axis"), F.struct(*asked.columns).alias("_row"), F.inline(F.array(_entry(0, F.col("start") - apart, F.lit(1)), _entry(1, -(F.col("stop") + apart), F.lit(1)))))
    rows = _striped(rows)
    # the last k positions up to each stripe's end: every stripe with marks has one at least, so the k before it are enough
    tails = Window.partitionBy(*axis).orderBy("_stripe").rowsBetween(1 - k, Window.currentRow)
    ends = marks.groupBy(*axis, "_stripe").agg(F.max_by("_near", "_pos").alias("_tail"))
    ends = ends.withColumn("_tail", F.slice(F.reverse(F.flatten(F.collect_list("_tail").over(tails))), 1, k))
    stripes = ends.unionByName(rows.select(*axis, "_stripe").distinct(), allowMissingColumns=True).groupBy(*axis, "_stripe").agg(F.first("_tail", ignorenulls=True).alias("_tail"))
    before = Window.partitionBy(*axis).orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    carried = stripes.select(*axis, "_stripe", F.last("_tail", ignorenulls=True).over(before).alias("_before"))
    inside = Window.partitionBy(*axis, "_stripe").orderBy("_pos", "_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marks.unionByName(rows, allowMissingColumns=True).withColumn("_here", F.last("_near", ignorenulls=True).over(inside)).where(F.col("_row").isNotNull())
    none = F.array().cast("array<bigint>")
    found = both.join(carried, [*axis, "_stripe"]).select("_row", "_side", F.slice(F.concat(F.reverse(F.coalesce("_here", none)), F.coalesce("_before", none)), 1, k).alias("_found"))
    return found.select("_row.*", "_side", F.explode("_found").alias("_pos"))
