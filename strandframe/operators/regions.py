"""Region operators on one dataset: selection, projection, extension, grouping, order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import Aggregate, aggregate
from ..functions.shared import stored
from . import metadata

COORDS = ["chrom", "start", "stop", "strand"]


class Scope:
    """What a region predicate or extension may use: coordinates, values and the sample's own metadata."""

    def __init__(self):
        self.used: dict[str, str] = {}

    chrom, left, right, strand = (property(lambda self, c=c: F.col(c)) for c in ("chrom", "start", "stop", "strand"))

    @property
    def start(self) -> Column:
        """The end at which reading begins: the right one on the - strand."""
        return F.when(F.col("strand") == "-", F.col("stop")).otherwise(F.col("start"))

    @property
    def stop(self) -> Column:
        return F.when(F.col("strand") == "-", F.col("start")).otherwise(F.col("stop"))

    def value(self, name: str) -> Column:
        return F.col(name)

    def meta(self, name: str, numeric: bool = True) -> Column:
        alias = self.used.setdefault(name, f"_meta{len(self.used)}")
        return F.col(alias).try_cast("double") if numeric else F.col(alias)


def holds(condition: Column) -> Column:
    """Two-valued: a comparison with null is false, so that its negation is true."""
    return F.coalesce(condition, F.lit(False))


def _scoped(regions: DataFrame, meta: DataFrame | None, scope: Scope) -> DataFrame:
    for name, alias in scope.used.items():
        if meta is None:
            raise ValueError(f"metadata attribute {name!r} is asked for, but there is no metadata")
        regions = regions.join(metadata.per_sample(metadata.first_value(meta, name, alias)), "sample_id", "left")
    return regions


def select(regions: DataFrame, predicate: Callable[[Scope], Column], meta: DataFrame | None = None) -> DataFrame:
    scope = Scope()
    condition = predicate(scope)
    return _scoped(regions, meta, scope).where(condition).select(*regions.columns)  # bare, so that its parts reach the scan


def project(regions: DataFrame, keep: list[str] | None = None, extend: dict[str, Callable[[Scope], Column]] | None = None, meta: DataFrame | None = None) -> DataFrame:
    """Computes new columns, all from the input row, then keeps the named values (all, if only extended; none, if neither).

    A new start, stop, chrom or strand rewrites the coordinate; rows left without extent go, and starts are cut at 0.
    """
    scope, extend = Scope(), extend or {}
    fresh = {name: f(scope) for name, f in extend.items()}
    out = _scoped(regions, meta, scope).withColumns(fresh) if fresh else regions
    if set(fresh) & {"start", "stop"}:
        out = out.where("start < stop").withColumn("start", F.greatest(F.col("start"), F.lit(0).cast("long")))
    values = [c for c in regions.columns if c not in ("sample_id", *COORDS)]
    added = [c for c in fresh if c not in COORDS and c not in values]
    kept = [c for c in values if c in keep or c in fresh] if keep is not None else values if fresh else []
    return out.select("sample_id", *COORDS, *kept, *added)


def project_rows(regions: DataFrame, function: Callable, returns: str, meta: DataFrame | None = None, names: list[str] = ()) -> DataFrame:
    """The coordinates with the values that a function of the user's gives, in place of the old ones.

    function gets a pandas frame of some rows (coordinates, values, and metadata attributes names of the rows' samples as
    meta_<name>) and returns a frame of as many rows with the columns of returns, a DDL string. Rows go in Arrow batches.
    """
    import pandas as pd

    for n in names:
        regions = regions.join(metadata.per_sample(metadata.first_value(meta, n, f"meta_{n}")), "sample_id", "left")
    fixed = ["sample_id", *COORDS]
    kinds = ", ".join(f"{c} {regions.schema[c].dataType.simpleString()}" for c in fixed)

    def apply(frames):
        for f in frames:
            got = function(f)
            if len(got) != len(f):
                raise ValueError(f"the function gave {len(got)} rows for {len(f)}")
            yield pd.concat([f[fixed].reset_index(drop=True), got.reset_index(drop=True)], axis=1)

    return regions.mapInPandas(apply, f"{kinds}, {returns}")



def group(regions: DataFrame, by: list[str] | None = None, aggregates: dict[str, tuple[Aggregate, str]] | None = None) -> DataFrame:
    """One row for each sample, coordinate and value of by, with aggregates {name: (kind, value)}."""
    keys = ["sample_id", *COORDS, *(by or [])]
    if not aggregates:
        return regions.select(*keys).distinct()
    return regions.groupBy(*keys).agg(*(aggregate(kind, F.col(v)).alias(n) for n, (kind, v) in aggregates.items()))


def extend_metadata(regions: DataFrame, meta: DataFrame, aggregates: dict[str, tuple[Aggregate, str]]) -> DataFrame:
    """Aggregates of each sample's regions as further metadata."""
    wide = regions.groupBy("sample_id").agg(*(aggregate(kind, F.col(v)).cast("string").alias(n) for n, (kind, v) in aggregates.items()))
    long = wide.unpivot("sample_id", list(aggregates), "attribute", "value").where("value IS NOT NULL")
    return meta.unionByName(long)


def _numbered(regions: DataFrame, part: list[str], sorts: list[Column], position: str) -> DataFrame:
    """regions with their number in the group (part) and the group's size, _all.

    One range exchange along groups and sorts, with borders that Spark samples from the rows themselves, so values in any
    scale, common prefixes and a group of any size spread alike; only rows equal in every column stay together. The sorted rows are
    stored with their places, since a recomputed exchange might draw other borders. A place less its stretch's first (a stretch is
    a group's rows in one range) plus the rows in the group's earlier stretches is the number, so no row is sorted again.
    """
    groups = [F.col(p).asc_nulls_last() for p in part]
    line = regions.repartitionByRange(*groups, *sorts).sortWithinPartitions(*groups, *sorts)
    line = stored(line.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    stretches = line.groupBy(*part, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*part)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = [*part, "_range"]
    sizes = stretches.select(*(F.col(c).alias(f"_of_{c}") for c in keys), (before - F.col("_first") + 1).alias("_shift"), F.sum("_n").over(whole).alias("_all"))
    met = line.join(sizes, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
    return met.select(*regions.columns, (F.col("_at") + F.col("_shift")).cast("long").alias(position), "_all")


def order(regions: DataFrame, keys: list[tuple[str, bool]], top: int | None = None, percent: float | None = None, within_leading: bool = False, position: str = "order") -> DataFrame:
    """Numbers each sample's regions by the keys, (column, ascending) each, nulls last and ties by coordinates.

    top keeps the first of each sample, percent that share; within_leading restarts for each value of all keys but the last.
    Without top, sorting runs at once and its result is stored in the shared folder (see _numbered).
    """
    lead = [k for k, _ in keys[:-1]] if within_leading else []
    sorts = [F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_last() for k, up in keys[len(lead) :]]
    ties = [F.col(c) for c in regions.columns if c not in ("sample_id", *(k for k, _ in keys))]
    part = ["sample_id", *lead]
    if top is not None and percent is None:  # Spark keeps the first of each task before it shuffles
        rank = F.row_number().over(Window.partitionBy(*part).orderBy(*sorts, *ties))
        return regions.withColumn(position, rank).where(F.col(position) <= top).withColumn(position, F.col(position).cast("long"))
    out = _numbered(regions, part, [*sorts, *ties], position)
    if top is not None:
        out = out.where(F.col(position) <= top)
    if percent is not None:
        out = out.where(F.col(position) <= F.floor(F.col("_all") * percent / 100))
    return out.drop("_all")


def take(regions: DataFrame, n: int) -> DataFrame:
    """n regions of each sample, the first by coordinates."""
    order_by = [F.col(c) for c in regions.columns if c != "sample_id"]
    return regions.withColumn("_n", F.row_number().over(Window.partitionBy("sample_id").orderBy(*order_by))).where(F.col("_n") <= n).drop("_n")


def merge(regions: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """All samples as one, with id 1, or one for each group."""
    if groups is None:
        return regions.withColumn("sample_id", F.lit(1).cast("long"))
    return regions.join(metadata.per_sample(groups), "sample_id").withColumn("sample_id", F.col("group_id")).drop("group_id")
