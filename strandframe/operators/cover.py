"""COVER, FLAT, SUMMIT and HISTOGRAM: regions by the number of input regions that lie over each place.

Starts and stops become events; net changes at one place are summed before anything is sorted, and places without a
change go. The running sum is taken in two levels, inside wide stripes of the coordinate and over the stripes' totals,
so a chromosome is as many tasks as it has stripes, not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions.aggregates import Aggregate, aggregate
from .genometric import BIN, interval_pairs
from .metadata import per_sample

ANY, ALL = "ANY", "ALL"
STRIPE = 1 << 22
AXIS = ["group_id", "chrom", "strand"]


def _grouped(regions: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Regions with group_id; if any region is unstranded, all are."""
    rows = regions.withColumn("group_id", F.lit(0).cast("long")) if groups is None else regions.join(per_sample(groups), "sample_id")
    unstranded = regions.agg(F.coalesce(F.bool_or(F.col("strand") == "*"), F.lit(False)).alias("_any"))  # one row
    return rows.crossJoin(F.broadcast(unstranded)).withColumn("strand", F.when(F.col("_any"), F.lit("*")).otherwise(F.col("strand"))).drop("_any")


def segments(rows: DataFrame) -> DataFrame:
    """(group_id, chrom, strand, start, stop, depth, before, after): maximal runs of equal depth, with their neighbours' depths."""
    events = rows.select(*AXIS, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("net")), F.struct(F.col("stop").alias("pos"), F.lit(-1).alias("net")))).alias("_e"))
    events = events.select(*AXIS, "_e.pos", "_e.net").groupBy(*AXIS, "pos").agg(F.sum("net").alias("net")).where("net <> 0").withColumn("_stripe", F.floor(F.col("pos") / STRIPE))
    stripes = events.groupBy(*AXIS, "_stripe").agg(F.sum("net").alias("_sum"), F.min(F.struct("pos", "net")).alias("_head"))
    along = Window.partitionBy(*AXIS).orderBy("_stripe")
    stripes = stripes.select(*AXIS, "_stripe", F.coalesce(F.sum("_sum").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.lead("_head").over(along).alias("_next_head"))
    inside = Window.partitionBy(*AXIS, "_stripe").orderBy("pos")
    placed = events.join(stripes, [*AXIS, "_stripe"]).withColumn("depth", F.col("_base") + F.sum("net").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("_next", F.coalesce(F.lead(F.struct("pos", "net")).over(inside), F.col("_next_head")))
    return placed.where("_next IS NOT NULL").select(*AXIS, "_stripe", F.col("pos").alias("start"), F.col("_next.pos").alias("stop"), "depth", (F.col("depth") - F.col("net")).alias("before"), (F.col("depth") + F.col("_next.net")).alias("after"))


def _bounds(rows: DataFrame, groups: DataFrame | None, least, most) -> tuple[Column, Column, DataFrame | None]:
    """Columns for both bounds, and the samples of each group, if a bound is ALL or a function of it."""
    sizes = None
    if any(callable(b) or b == ALL for b in (least, most)):
        sizes = (rows if groups is None else groups).groupBy(*([] if groups is None else ["group_id"])).agg(F.count_distinct("sample_id").alias("_samples"))
    column = lambda b, free: F.floor(b(F.col("_samples"))) if callable(b) else F.col("_samples") if b == ALL else F.lit(free) if b == ANY else F.lit(b)
    return column(least, 1), column(most, 2**31 - 1), sizes


def _islands(runs: DataFrame) -> DataFrame:
    """Touching runs fused. Where a run begins an island is known from the depth before it; the others look back, over stripes too."""
    begun = F.when(~F.col("_ok_before"), F.col("start"))
    inside = Window.partitionBy(*AXIS, "_stripe").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*AXIS).orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    last = runs.groupBy(*AXIS, "_stripe").agg(F.max(begun).alias("_last")).withColumn("_carried", F.max("_last").over(along)).drop("_last")
    owned = runs.withColumn("_own", F.max(begun).over(inside)).join(last, [*AXIS, "_stripe"]).withColumn("_island", F.coalesce("_own", "_carried"))
    return owned.groupBy(*AXIS, F.col("_island").alias("start")).agg(F.max("stop").alias("stop"), F.max("depth").alias("depth"))


def cover(regions: DataFrame, kind: str = "COVER", least=1, most=ANY, groups: DataFrame | None = None, aggregates: dict[str, tuple[Aggregate, str]] | None = None, jaccard: bool = False, bin_size: int = BIN) -> DataFrame:
    """(sample_id = group or 0, coordinates, accumulation, aggregates, and with jaccard jaccard_intersect and jaccard_result).

    least and most are numbers, ANY (1 and no bound), ALL (the group's number of samples) or a function of ALL's column, such as
    lambda n: n / 2; its value is rounded down.
    """
    rows = _grouped(regions, groups)
    low, high, sizes = _bounds(regions, groups, least, most)
    runs = segments(rows)
    if sizes is not None:
        runs = runs.crossJoin(F.broadcast(sizes)) if groups is None else runs.join(per_sample(sizes), "group_id")
    ok = lambda c: (F.col(c) > 0) & (F.col(c) >= low) & (F.col(c) <= high)
    runs = runs.withColumns({"_ok": ok("depth"), "_ok_before": ok("before"), "_ok_after": ok("after")}).where("_ok")
    match kind.upper():
        case "HISTOGRAM":
            out = runs
        case "SUMMIT":
            out = runs.where("(depth > before AND (after < depth OR NOT _ok_after)) OR (NOT _ok_before AND after < depth)")
        case "COVER" | "FLAT":
            out = _islands(runs)
        case _:
            raise ValueError(f"unknown kind {kind!r}")
    out = out.select(F.col("group_id").alias("sample_id"), "chrom", "start", "stop", "strand", F.col("depth").alias("accumulation"))
    if kind.upper() != "FLAT" and not aggregates and not jaccard:
        return out
    inputs = rows.drop("sample_id").withColumnRenamed("group_id", "sample_id").select("sample_id", *(c for c in regions.columns if c != "sample_id"))
    overlap = I.overlaps(F.col("start"), F.col("stop"), F.col("e_start"), F.col("e_stop")) & (F.col("sample_id") == F.col("exp_id"))
    found = interval_pairs(out, inputs, 0, overlap, bin_size=bin_size)
    own = [c for c in out.columns if c not in ("start", "stop")]
    spans = [F.min("e_start").alias("_lo"), F.max("e_stop").alias("_hi"), F.max("e_start").alias("_in_lo"), F.min("e_stop").alias("_in_hi")]
    sums = [aggregate(k, F.col(f"e_{v}")).alias(n) for n, (k, v) in (aggregates or {}).items()]
    met = found.groupBy(*own, "start", "stop").agg(*spans, *sums)
    span = F.col("_hi") - F.col("_lo")
    shares = [((F.col("stop") - F.col("start")) / span).alias("jaccard_intersect"), F.when(F.col("_in_hi") > F.col("_in_lo"), (F.col("_in_hi") - F.col("_in_lo")) / span).otherwise(F.lit(0.0)).alias("jaccard_result")] if jaccard else []
    ends = [F.col("_lo").alias("start"), F.col("_hi").alias("stop")] if kind.upper() == "FLAT" else [F.col("start"), F.col("stop")]
    return met.select("sample_id", "chrom", *ends, "strand", "accumulation", *shares, *(aggregates or {}))
