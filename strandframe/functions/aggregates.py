"""The catalogue of aggregates for MAP, COVER, GROUP and EXTEND. All are built in, with partial aggregation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATALOGUE: dict[str, Callable[[Column], Column]] = {
    "COUNT": lambda c: F.count(F.lit(1)),
    "COUNT_NON_NULL": F.count,
    "SUM": F.sum,
    "AVG": F.avg,
    "MIN": F.min,
    "MAX": F.max,
    "STD": F.stddev_samp,
    "MEDIAN": lambda c: F.percentile(c, F.lit(0.5)),
    "Q1": lambda c: F.percentile(c, F.lit(0.25)),
    "Q2": lambda c: F.percentile(c, F.lit(0.5)),
    "Q3": lambda c: F.percentile(c, F.lit(0.75)),
    "BAG": lambda c: F.array_join(F.array_sort(F.collect_list(c.cast("string"))), " "),
    "BAGD": lambda c: F.array_join(F.array_sort(F.collect_set(c.cast("string"))), " "),
}

#: What a caller may pass: a name of the catalogue, or a function from the value's column to an aggregate of its own.
Aggregate = str | Callable[[Column], Column]


def aggregate(kind: Aggregate, value: Column) -> Column:
    if callable(kind):
        return kind(value)
    try:
        return CATALOGUE[kind.upper()](value)
    except KeyError:
        raise ValueError(f"unknown aggregate {kind!r}; one of {', '.join(CATALOGUE)}, or a function") from None


@dataclass(frozen=True)
class Merging:
    """An aggregate of the user's own, in two phases: merge makes one number of a pandas series of numbers, and again one of such
    results, in any grouping; out(merged, rows, non_null) gives the outcome. Nulls aren't merged; merged is None where
    there is nothing to merge."""

    merge: Callable
    out: Callable = lambda merged, rows, non_null: merged


def _combined(f, keys: list[str], kind: Merging):
    """One row for each group of a frame of keys, _merged, _rows and _full."""
    groups = f.groupby(keys, dropna=False, sort=False)
    sums = groups[["_rows", "_full"]].sum().reset_index()
    some = f[f["_full"] > 0].groupby(keys, dropna=False, sort=False)["_merged"].agg(kind.merge).rename("_merged").reset_index()
    return sums.merge(some, on=keys, how="left")[[*keys, "_merged", "_rows", "_full"]]


def partly(found: DataFrame, keys: list[str], value: str, kind: Merging) -> DataFrame:
    """(keys, _merged, _rows, _full): rows of found merged within each Arrow batch, in the tasks that make them, before any shuffle."""
    types = ", ".join(f"{k} {found.schema[k].dataType.simpleString()}" for k in keys)

    def apply(frames):
        for f in frames:
            if len(f):
                full = f["_merged"].notna().astype("int64")
                yield _combined(f.assign(_rows=1, _full=full), keys, kind)

    return found.select(*keys, F.col(value).cast("double").alias("_merged")).mapInPandas(apply, f"{types}, _merged double, _rows long, _full long")


def merged(parts: DataFrame, keys: list[str], kind: Merging, name: str) -> DataFrame:
    """(keys, name): the outcome of each group of parts. A task holds a batch and one group at a time, and that group as one row."""
    import pandas as pd

    types = ", ".join(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys)

    def outcomes(f):
        values = [kind.out(m if n else None, int(r), int(n)) for m, r, n in zip(f["_merged"], f["_rows"], f["_full"], strict=True)]
        return f[keys].assign(**{name: pd.Series([None if v is None else float(v) for v in values], dtype="float64", index=f.index)})

    def apply(frames):
        open_ = None  # the last group of a batch may go on in the next
        for f in frames:
            if len(f):
                f = _combined(f if open_ is None else pd.concat([open_, f]), keys, kind)
                open_ = f.tail(1)
                yield outcomes(f.iloc[:-1])
        if open_ is not None:
            yield outcomes(open_)

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(apply, f"{types}, {name} double")
