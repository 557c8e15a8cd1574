"""Column expressions on intervals: 0-based, half-open, with strands + - and the wildcard *."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COORDS = ["chrom", "start", "stop", "strand"]


def overlaps(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """Strict: touching intervals don't overlap."""
    return (a_start < b_stop) & (b_start < a_stop)


def strands_agree(a: Column, b: Column) -> Column:
    return (a == "*") | (b == "*") | (a == b)


def distance(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """The gap, 0 if they touch, negative if they overlap."""
    return F.greatest(a_start - b_stop, b_start - a_stop)


def bins(start: Column, stop: Column, size: int) -> Column:
    """Numbers of the bins that [start, stop) meets; one bin for an empty interval, and one bin in all if size is 0."""
    if not size:
        return F.array(F.lit(0).cast("long"))
    low = F.floor(F.greatest(start, F.lit(0)) / size).cast("long")
    high = F.floor(F.greatest(stop - 1, start, F.lit(0)) / size).cast("long")
    return F.sequence(low, high)


#: As a bin size: nested bins, for tables that mix short and very long intervals.
NESTED = "nested"
#: The sizes of nested bins, level by level; the last holds everything.
SIZES = [1000 * 32**level for level in range(5)] + [1 << 62]


def level(start: Column, stop: Column) -> Column:
    """The first level whose bins are no shorter than the interval, which so meets one or two of them."""
    out = F.lit(len(SIZES) - 1)
    for n in reversed(range(len(SIZES) - 1)):
        out = F.when(stop - start <= SIZES[n], n).otherwise(out)
    return out


def nested_bins(start: Column, stop: Column, own: Column, others: Column) -> Column:
    """(level, bin) on the interval's own level, and on each coarser one that others, an array of levels, holds."""
    def on(n: int) -> Column:
        placed = F.transform(bins(start, stop, SIZES[n]), lambda b: F.struct(F.lit(n).alias("level"), b.alias("bin")))
        return F.when((own == n) | ((own < n) & F.array_contains(others, n)), placed).otherwise(F.array().cast("array<struct<level:int,bin:bigint>>"))

    return F.concat(*(on(n) for n in range(len(SIZES))))


def first_shared_bin(a_start: Column, b_start: Column, size: int | Column) -> Column:
    """The lowest bin in which two intervals that share one can meet, so a pair is made once."""
    if isinstance(size, Column):
        return F.floor(F.greatest(a_start, b_start, F.lit(0)) / size).cast("long")
    return F.floor(F.greatest(a_start, b_start, F.lit(0)) / size).cast("long") if size else F.lit(0).cast("long")


def upstream(r_start: Column, r_stop: Column, r_strand: Column, e_start: Column, e_stop: Column) -> Column:
    return F.when(r_strand == "-", e_start >= r_stop).otherwise(e_stop <= r_start)


def downstream(r_start: Column, r_stop: Column, r_strand: Column, e_start: Column, e_stop: Column) -> Column:
    return F.when(r_strand == "-", e_stop <= r_start).otherwise(e_start >= r_stop)


def joint_strand(a: Column, b: Column) -> Column:
    return F.when(a == b, a).otherwise(F.lit("*"))
