"""JOIN, MAP and DIFFERENCE: two datasets matched by interval.

Both sides are cut into bins of the coordinate, so Spark plans a plain equi-join on (chromosome, bin) with the rest as
a residual condition: an interval join without a Cartesian product. A pair is made in its first shared bin only,
so no distinct is needed. Results don't hang on the bin size. Where no pairs are wanted (MAP that only counts) or only the
nearest (MinDistance), sorted positions are swept instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import intervals as I
from ..functions.aggregates import Aggregate, Merging, aggregate, merged, partly
from . import stripes, sweep
from .metadata import per_pair, per_sample

BIN = 10_000
HORIZON = 100_000


@dataclass(frozen=True)
class DistLess:
    """Closer than n; DistLess(0) is overlap."""

    n: int


@dataclass(frozen=True)
class DistGreater:
    n: int


@dataclass(frozen=True)
class Upstream:
    pass


@dataclass(frozen=True)
class Downstream:
    pass


@dataclass(frozen=True)
class MinDistance:
    """The k least distances of each left region in each right sample, ties kept. Conditions after it filter what it leaves."""

    k: int


Condition = DistLess | DistGreater | Upstream | Downstream | MinDistance


def _values(df: DataFrame, *other: str) -> list[str]:
    return [c for c in df.columns if c not in ("sample_id", *I.COORDS, *other)]


def _right(exp: DataFrame) -> DataFrame:
    """The right side with e_ before every column."""
    return exp.select(*(F.col(c).alias("exp_id" if c == "sample_id" else f"e_{c}") for c in exp.columns))


def _atom(c: Condition) -> Column:
    r, e = (F.col("start"), F.col("stop")), (F.col("e_start"), F.col("e_stop"))
    match c:
        case DistLess(n):
            return I.distance(*r, *e) < n
        case DistGreater(n):
            return I.distance(*r, *e) > n
        case Upstream():
            return I.upstream(*r, F.col("strand"), *e)
        case Downstream():
            return I.downstream(*r, F.col("strand"), *e)
    raise ValueError(f"not a condition: {c!r}")


def _and(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def windows(reach: int, apart: int = 0, side: type | None = None) -> Column:
    """Where partners of a region lie, as an array of (w_start, w_stop, w_side): all within reach of it (side 0), or the stretches before (-1) and after it (1).

    With apart (a least gap of 1 or more) the region and what is closer to it is left out between these; with side, Upstream or Downstream, only
    the stretch on that side of the region's strand is there.
    """
    start, stop = F.col("start"), F.col("stop")
    window = lambda a, b, n: F.struct(a.alias("w_start"), b.alias("w_stop"), F.lit(n).alias("w_side"))
    before, after = window(start - reach, start - apart + 1, -1), window(stop + apart, stop + reach, 1)
    if side is not None:
        left, right = (after, before) if side is Upstream else (before, after)
        return F.when(F.col("strand") == "-", F.array(left)).otherwise(F.array(right))
    return F.array(before, after) if apart > 0 else F.array(window(start - reach, stop + reach, 0))


def _apart_and_side(conditions: list[Condition]) -> tuple[int, type | None]:
    """The least gap that the conditions ask for, and the one side that they allow."""
    sides = {type(c) for c in conditions if isinstance(c, Upstream | Downstream)}
    return max([0, *(c.n + 1 for c in conditions if isinstance(c, DistGreater))]), sides.pop() if len(sides) == 1 else None


def interval_pairs(ref: DataFrame, exp: DataFrame, reach: int, condition: Column, pairs: DataFrame | None = None, how: str = "inner", bin_size: int | str = BIN, equal: list[tuple[str, str]] = (), paired: bool = False, apart: int = 0, side: type | None = None) -> DataFrame:
    """Rows of ref beside rows of exp (columns e_*) on the same chromosome that come within reach and satisfy condition.

    pairs (ref_id, exp_id) restricts and multiplies the samples; with paired, each row of ref names its partner already, in
    pair_exp. equal lists further equal columns (left, right). bin_size: a number, 0 for one bin, or NESTED, where a row is copied
    at most twice for each level of bins that the other side's lengths need, however long it is. apart and side: what condition
    rules out already (see windows), so that ref rows aren't copied to bins where no partner can be.
    """
    left = ref
    if pairs is not None:
        left = left.join(per_pair(pairs.select(F.col("ref_id").alias("sample_id"), F.col("exp_id").alias("pair_exp"))), "sample_id")
    left = left.select("*", F.inline(windows(reach, apart, side)))
    wide_start, wide_stop = F.col("w_start"), F.col("w_stop")
    right = _right(exp)
    on = [F.col("chrom") == F.col("e_chrom"), F.col("bin") == F.col("e_bin")]
    if bin_size == I.NESTED:  # a pair meets on the longer one's level, in its one or two bins
        e_start, e_stop = F.col("e_start"), F.col("e_stop")
        known = right.agg(F.collect_set(I.level(e_start, e_stop)).alias("_levels"))  # one row each
        e_known = ref.select(F.inline(windows(reach, apart, side))).agg(F.collect_set(I.level(wide_start, wide_stop)).alias("_levels"))
        left = left.withColumn("_own", I.level(wide_start, wide_stop)).crossJoin(F.broadcast(known))
        left = left.select("*", F.inline(I.nested_bins(wide_start, wide_stop, F.col("_own"), F.col("_levels")))).drop("_levels")
        right = right.withColumn("e_own", I.level(e_start, e_stop)).crossJoin(F.broadcast(e_known))
        right = right.select("*", F.inline(I.nested_bins(e_start, e_stop, F.col("e_own"), F.col("_levels"))).alias("e_level", "e_bin")).drop("_levels")
        size = F.element_at(F.array(*(F.lit(s).cast("long") for s in I.SIZES)), F.col("level") + 1)
        on += [F.col("level") == F.col("e_level"), F.col("level") == F.greatest("_own", "e_own")]
    else:
        left = left.withColumn("bin", F.explode(I.bins(wide_start, wide_stop, bin_size)))
        right = right.withColumn("e_bin", F.explode(I.bins(F.col("e_start"), F.col("e_stop"), bin_size)))
        size = bin_size
    if pairs is not None or paired:
        on.append(F.col("pair_exp") == F.col("exp_id"))
    on += [F.col(a) == F.col(f"e_{b}") for a, b in equal]
    rest = [F.col("bin") == I.first_shared_bin(wide_start, F.col("e_start"), size), I.strands_agree(F.col("strand"), F.col("e_strand")), condition]
    if apart or side is not None:  # in its own window, so a pair is made once
        rest.append(F.when(F.col("w_side") < 0, F.col("e_stop") <= F.col("start") - apart).otherwise(F.col("e_start") >= F.col("stop") + apart))
    return left.join(right, _and(on + rest), how).drop("bin", "e_bin", "level", "e_level", "_own", "e_own", "w_start", "w_stop", "w_side")


def _outcome(found: DataFrame, ref: DataFrame, exp: DataFrame, builder: str) -> DataFrame:
    """Coordinates and values by the builder. Right values whose names the left has too get right_ before them."""
    lv, rv = _values(ref), _values(exp)
    taken = {*lv, *I.COORDS, "sample_id", "ref_id", "exp_id"}
    left = [F.col(v) for v in lv]
    right = [F.col(f"e_{v}").alias(f"right_{v}" if v in taken else v) for v in rv]
    ids = [F.col("sample_id").alias("ref_id"), F.col("exp_id")]
    lc = [F.col(c) for c in I.COORDS]
    rc = [F.col(f"e_{c}").alias(c) for c in I.COORDS]
    joint = I.joint_strand(F.col("strand"), F.col("e_strand")).alias("strand")
    match builder.upper():
        case "LEFT":
            return found.select(*ids, *lc, *left, *right)
        case "RIGHT":
            return found.select(*ids, *rc, *left, *right)
        case "LEFT_DISTINCT":
            return found.select(*ids, *lc, *left).distinct()
        case "RIGHT_DISTINCT":
            return found.select(*ids, *rc, *(F.col(f"e_{v}").alias(v) for v in rv)).distinct()
        case "CONTIG":
            return found.select(*ids, F.col("chrom"), F.least("start", "e_start").alias("start"), F.greatest("stop", "e_stop").alias("stop"), joint, *left, *right)
        case "INTERSECTION":
            cut = found.where(I.overlaps(F.col("start"), F.col("stop"), F.col("e_start"), F.col("e_stop")))
            return cut.select(*ids, F.col("chrom"), F.greatest("start", "e_start").alias("start"), F.least("stop", "e_stop").alias("stop"), joint, *left, *right)
        case "BOTH":
            return found.select(*ids, *lc, *left, *(F.col(f"e_{c}").alias(f"right_{c}") for c in I.COORDS), *right)
    raise ValueError(f"unknown builder {builder!r}")


def join(ref: DataFrame, exp: DataFrame, conditions: list[Condition] | list[list[Condition]] = (), builder: str = "LEFT", pairs: DataFrame | None = None, on: list[str] = (), bin_size: int | str = BIN, horizon: int = HORIZON) -> DataFrame:
    """(ref_id, exp_id, coordinates, values) of matching regions. Several lists of conditions give the union of their results.

    on lists columns that must be equal on both sides; without conditions it is an equi-join. Without an upper bound on the
    distance, regions farther than horizon aren't looked for (DistGreater(n): n + horizon).
    """
    lists = conditions if conditions and isinstance(conditions[0], list | tuple) else [list(conditions)]
    out = None
    for atoms in lists:
        one = _join_once(ref, exp, list(atoms), builder, pairs, on, bin_size, horizon)
        out = one if out is None else out.unionByName(one)
    return out


def _join_once(ref, exp, atoms, builder, pairs, on, bin_size, horizon) -> DataFrame:
    if not atoms:
        if not on:
            raise ValueError("a join needs conditions or columns to be equal on")
        right = _right(exp)
        found = ref.join(right, _and([F.col(c) == F.col(f"e_{c}") for c in on]))
        if pairs is not None:
            found = found.join(pairs.select(F.col("ref_id").alias("_r"), F.col("exp_id").alias("_e")), (F.col("sample_id") == F.col("_r")) & (F.col("exp_id") == F.col("_e")), "left_semi")
        return _outcome(found, ref, exp, builder)
    return _outcome(matches(ref, exp, atoms, pairs, on, bin_size, horizon), ref, exp, builder)


def matches(ref: DataFrame, exp: DataFrame, atoms: list[Condition], pairs: DataFrame | None = None, on: list[str] = (), bin_size: int | str = BIN, horizon: int = HORIZON) -> DataFrame:
    """Rows of ref beside the rows of exp (columns e_*) that satisfy the conditions in their order."""
    cut = next((i for i, a in enumerate(atoms) if isinstance(a, MinDistance)), len(atoms))
    before, after = atoms[:cut], atoms[cut + 1 :]
    limits = [a.n for a in before if isinstance(a, DistLess)]
    lower = max([a.n for a in before if isinstance(a, DistGreater)], default=0)
    bounds = [_atom(a) for a in before]
    if limits:
        reach = max(0, min(limits))
    else:
        late = min([a.n for a in after if isinstance(a, DistLess)], default=0)
        reach = max(lower + horizon if lower > 0 else horizon, late)
        bounds.append(I.distance(F.col("start"), F.col("stop"), F.col("e_start"), F.col("e_stop")) <= reach)
    # bins meet only if the widened left interval reaches into the right one, so a distance of exactly reach needs one more
    if cut < len(atoms):
        return _nearest(ref, exp, atoms[cut].k, reach, before, after, _and(bounds), pairs, on, bin_size)
    apart, side = _apart_and_side(before)
    return interval_pairs(ref, exp, reach + 1, _and(bounds), pairs, bin_size=bin_size, equal=[(c, c) for c in on], apart=apart, side=side)


def _fit(conditions: list[Condition], gap: np.ndarray, minus: bool, r_start: np.ndarray, r_stop: np.ndarray, e_start: np.ndarray, e_stop: np.ndarray) -> np.ndarray:
    """Which of the pairs satisfy the conditions, as _atom has them; minus: the left regions' strand is -."""
    out = np.ones(len(gap), bool)
    for c in conditions:
        match c:
            case DistLess(n):
                out &= gap < n
            case DistGreater(n):
                out &= gap > n
            case Upstream() | Downstream():
                out &= e_start >= r_stop if isinstance(c, Upstream) == minus else e_stop <= r_start
            case _:
                raise ValueError(f"not a condition: {c!r}")
    return out


def _nearest(ref: DataFrame, exp: DataFrame, k: int, reach: int, before: list[Condition], after: list[Condition], condition: Column, pairs: DataFrame | None, on: list[str], bin_size: int | str) -> DataFrame:
    """Pairs of ref and exp rows whose distance is among the k least of the ref region in the exp sample, up to reach, as far as they satisfy after.

    In stripes, where each side is shuffled once; by a sweep of positions and joins for ref regions that are too long for stripes, and with on.
    condition has before and the reach.
    """
    greater = [a.n for a in before if isinstance(a, DistGreater)]
    later = _and([_atom(a) for a in after])
    if on:
        return _nearest_swept(ref, exp, k, reach, condition, pairs, on, bin_size, greater).where(later)
    short, long, exp_long = stripes.split(ref, exp, reach)
    answers = stripes.nearest(k, max([0, *(n + 1 for n in greater)]), reach, not greater or max(greater) < 0, partial(_fit, before), partial(_fit, after))
    if pairs is not None:
        short = short.join(per_pair(pairs.select(F.col("ref_id").alias("sample_id"), F.col("exp_id").alias("_partner"))), "sample_id")
        exp = exp.withColumn("_partner", F.col("sample_id"))
    met = stripes.beside(short, exp, reach, answers).drop("_partner")
    return met.unionByName(_nearest_swept(long, exp_long, k, reach, condition, pairs, on, bin_size, greater).where(later))


def _nearest_swept(ref: DataFrame, exp: DataFrame, k: int, reach: int, condition: Column, pairs: DataFrame | None, on: list[str], bin_size: int | str, greater: list[int]) -> DataFrame:
    """_nearest for regions of any length.

    What is near a region hangs on its coordinates (and on, and its sample where pairs restricts), so equal regions are
    searched for once. Regions apart from it come from a sweep: the k nearest positions on each side, beyond the largest
    of the bounds in greater, whatever the distance; only regions at those positions are paired. Overlapping ones come
    from an interval join, unless a bound rules them out. A condition beside such bounds rules out a whole side, or all from some distance on.
    """
    keys = [*I.COORDS, *on, *(["sample_id"] if pairs is not None else [])]
    places = ref.select(*keys).distinct()
    if pairs is None:
        ids = exp.select(F.col("sample_id").alias("exp_id")).distinct()
        todo = places.crossJoin(F.broadcast(ids))  # a row for each region and exp sample
    else:
        todo = places.join(per_pair(pairs.select(F.col("ref_id").alias("sample_id"), "exp_id")), "sample_id")
    apart = max([0, *(n + 1 for n in greater)])
    gap = I.distance(F.col("start"), F.col("stop"), F.col("e_start"), F.col("e_stop"))
    spots = sweep.neighbours(todo, exp, k, apart, on).withColumnRenamed("exp_id", "pair_exp")
    far = F.when(F.col("_side") == 0, F.col("start") - F.col("_pos")).otherwise(-F.col("_pos") - F.col("stop"))
    right = _right(exp).withColumn("_there", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("e_stop").cast("long").alias("pos")), F.struct(F.lit(1).alias("side"), (-F.col("e_start")).cast("long").alias("pos")))))
    at = [F.col("pair_exp") == F.col("exp_id"), F.col("chrom") == F.col("e_chrom"), F.col("_side") == F.col("_there.side"), F.col("_pos") == F.col("_there.pos"), *(F.col(c) == F.col(f"e_{c}") for c in on)]
    once = (F.col("_side") == 0) | (F.col("e_stop") > F.col("start") - apart)  # an empty region beside an empty one is on both sides
    met = spots.where(far <= reach).join(right, _and([*at, I.strands_agree(F.col("strand"), F.col("e_strand")), once, condition])).drop("_side", "_pos", "_there")
    if not greater or max(greater) < 0:
        over = I.overlaps(F.col("start"), F.col("stop"), F.col("e_start"), F.col("e_stop"))
        asked = todo.withColumnRenamed("exp_id", "pair_exp")
        met = met.unionByName(interval_pairs(asked, exp, 0, over & condition, bin_size=bin_size, equal=[(c, c) for c in on], paired=True))
    least = Window.partitionBy(*keys, "exp_id").orderBy("_gap")
    done = met.withColumn("_gap", gap).where(F.col("_gap") <= reach).withColumn("_rank", F.dense_rank().over(least)).where(F.col("_rank") <= k)
    return ref.join(done.select(*keys, *_right(exp).columns), keys)


def map_regions(ref: DataFrame, exp: DataFrame, pairs: DataFrame, aggregates: dict[str, tuple[Aggregate, str]] | None = None, count: str = "count", bin_size: int | str = BIN, every: bool = False) -> DataFrame:
    """Each ref region for each paired sample, with the number of overlapping exp regions and aggregates of their values.

    Rows are preserved: equal ref regions stay apart, and regions without a hit have count 0 and the aggregates of no
    rows. Hits hang on the coordinates (and the sample where pairs restricts); with every,
    pairs are all combinations of samples and the regions aren't multiplied by them before the match. A region gathers
    one entry for each exp sample that hits it; the samples that don't are filled in where rows are made. With no
    aggregates but counts, least and greatest no pair is made: hits are found from sorted starts and stops.
    """
    if all(kind == "COUNT" for kind, _ in (aggregates or {}).values()):
        return _map_counts(ref, exp, pairs, [count, *(aggregates or {})], every)
    if all(_plain(exp, *a) for a in aggregates.values()):
        return _map_extremes(ref, exp, pairs, aggregates, count, bin_size, every)
    return _map_paired(ref, exp, pairs, aggregates, count, bin_size, every)


def _plain(exp: DataFrame, kind: Aggregate, value: str) -> bool:
    """Whether stripes.extremes has the aggregate."""
    return isinstance(kind, str) and value != "chrom" and (kind.upper() in ("COUNT", "COUNT_NON_NULL") or kind.upper() in ("MIN", "MAX") and isinstance(exp.schema[value].dataType, T.IntegralType | T.FloatType | T.DoubleType))


def _map_extremes(ref: DataFrame, exp: DataFrame, pairs: DataFrame, aggregates: dict[str, tuple[Aggregate, str]], count: str, bin_size: int | str, every: bool) -> DataFrame:
    """In stripes; ref regions that are too long for these by pairs."""
    short, long, exp_long = stripes.split(ref, exp, 0)
    kinds = [(kind.upper(), None if kind.upper() == "COUNT" else value) for kind, value in aggregates.values()]
    sums = [(count, T.LongType()), *((n, T.LongType() if k.startswith("COUNT") else exp.schema[v].dataType) for n, (k, v) in zip(aggregates, kinds, strict=True))]
    values = sorted({v for _, v in kinds if v is not None} - {"sample_id", *I.COORDS})
    answers = stripes.extremes([n for n, _ in sums], kinds)
    nothing = F.struct(*(F.lit(0 if k.startswith("COUNT") else None).cast(t).alias(n) for (n, t), (k, _) in zip(sums, [("COUNT", None), *kinds], strict=True)))
    met = _map_striped(short, exp.select("sample_id", *I.COORDS, *values), pairs, every, answers, sums, nothing)
    return met.unionByName(_map_paired(long, exp_long, pairs, aggregates, count, bin_size, every))


def _map_striped(ref: DataFrame, exp: DataFrame, pairs: DataFrame, every: bool, answers: Callable, sums: list[tuple[str, T.DataType]], nothing: Column, at: Column | None = None, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each ref region for each paired sample, with the sums that answers finds in its stripe, or nothing. at: stripes of exp regions; more makes further rows of them."""
    cells = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("sums", T.StructType([T.StructField(n, t) for n, t in sums]))]))
    ids = per_sample(pairs.select(F.col("exp_id").alias("sample_id")).distinct())
    right = exp.join(ids, "sample_id", "left_semi")
    if every:  # all ref samples have the same partners, in one row
        known = ref.join(per_sample(pairs.select(F.col("ref_id").alias("sample_id")).distinct()), "sample_id", "left_semi")
        met = stripes.beside(known, right, 0, answers, cells, at, more and more(right)).crossJoin(F.broadcast(ids.agg(F.collect_list("sample_id").alias("_partners"))))
    else:
        known = ref.join(per_pair(pairs.select(F.col("ref_id").alias("sample_id"), F.col("exp_id").alias("_partner"))), "sample_id")
        right = right.withColumn("_partner", F.col("sample_id"))
        met = stripes.beside(known, right, 0, answers, cells, at, more and more(right)).withColumn("_partners", F.array("_partner"))
    hit = F.col("_hits")
    missed = F.transform(F.array_except("_partners", hit["id"]), lambda i: F.struct(i.alias("id"), nothing.alias("sums")))
    own = [c for c in ref.columns if c != "sample_id"]
    rows = met.select(F.col("sample_id").alias("ref_id"), *own, F.inline(F.concat(hit, missed)))
    return rows.select("ref_id", F.col("id").alias("exp_id"), *own, *(F.col(f"sums.{n}").alias(n) for n, _ in sums))


def _map_paired(ref: DataFrame, exp: DataFrame, pairs: DataFrame, aggregates: dict[str, tuple[Aggregate, str]] | None, count: str, bin_size: int | str, every: bool) -> DataFrame:
    """MAP from pairs: each place is matched once, and a place gathers one entry for each exp sample that hits it."""
    keys = [*I.COORDS, *([] if every else ["sample_id"])]
    places = ref.select(*keys).distinct()
    partner_ids = pairs.select("exp_id").distinct()
    right = exp.join(per_sample(partner_ids.withColumnRenamed("exp_id", "sample_id")), "sample_id", "left_semi")
    overlap = I.overlaps(F.col("start"), F.col("stop"), F.col("e_start"), F.col("e_stop"))
    found = interval_pairs(places, right, 0, overlap, None if every else pairs, bin_size=bin_size)
    sums = [F.count(F.lit(1)).alias(count)]
    for name, (kind, value) in (aggregates or {}).items():
        sums.append(F.count(F.lit(1)).alias(name) if kind == "COUNT" else aggregate(kind, F.col(f"e_{value}")).alias(name))
    names = [count, *(aggregates or {})]
    nothing = _right(exp).limit(0).agg(*sums).select(F.struct(*names).alias("_nothing"))  # one row
    hits = found.groupBy(*keys, "exp_id").agg(*sums).groupBy(*keys).agg(F.collect_list(F.struct(F.col("exp_id").alias("id"), F.struct(*names).alias("sums"))).alias("_hits"))
    own = [c for c in ref.columns if c != "sample_id"]
    hits = hits.select(*(F.col(c).alias(f"_k_{c}") for c in keys), "_hits")
    at = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) if c == "strand" else F.col(c) == F.col(f"_k_{c}") for c in keys]
    whole = ref.join(hits, _and(at), "left").crossJoin(F.broadcast(nothing))
    if every:  # all ref samples have the same partners, in one row
        known = pairs.select(F.col("ref_id").alias("sample_id")).distinct()
        whole = whole.join(per_sample(known), "sample_id", "left_semi").crossJoin(F.broadcast(partner_ids.agg(F.collect_list("exp_id").alias("_partners"))))
    else:
        whole = whole.join(per_sample(pairs.groupBy(F.col("ref_id").alias("sample_id")).agg(F.collect_list("exp_id").alias("_partners"))), "sample_id")
    hit = F.coalesce("_hits", F.array())
    missed = F.transform(F.array_except("_partners", F.transform(hit, lambda h: h["id"])), lambda i: F.struct(i.alias("id"), F.col("_nothing").alias("sums")))
    rows = whole.select(F.col("sample_id").alias("ref_id"), *own, F.inline(F.concat(hit, missed)))
    return rows.select("ref_id", F.col("id").alias("exp_id"), *own, *(F.col(f"sums.{n}").alias(n) for n in names))


def map_merging(ref: DataFrame, exp: DataFrame, pairs: DataFrame, value: str, kind: Merging, name: str, count: str = "count", bin_size: int | str = BIN, every: bool = False) -> DataFrame:
    """MAP with an aggregate of the user's own over a value of the exp regions; null for regions without a hit."""
    short, long, exp_long = stripes.split(ref, exp, 0)
    right = exp.select("sample_id", *I.COORDS, F.col(value).cast("double").alias("_value"))
    nothing = F.struct(F.lit(0).cast("long").alias(count), F.lit(None).cast("double").alias(name))
    met = _map_striped(short, right, pairs, every, stripes.merging([count, name], kind), [(count, T.LongType()), (name, T.DoubleType())], nothing)
    return met.unionByName(_merging_paired(long, exp_long, pairs, value, kind, name, count, bin_size, every))


def _merging_paired(ref: DataFrame, exp: DataFrame, pairs: DataFrame, value: str, kind: Merging, name: str, count: str, bin_size: int | str, every: bool) -> DataFrame:
    """map_merging for regions of any length: pairs merged in the tasks that make them, then again by region."""
    keys = [*I.COORDS, *([] if every else ["sample_id"]), "exp_id"]
    counted = _map_swept(ref, exp, pairs, [count], every)
    overlap = I.overlaps(F.col("start"), F.col("stop"), F.col("e_start"), F.col("e_stop"))
    right = exp.join(per_sample(pairs.select(F.col("exp_id").alias("sample_id")).distinct()), "sample_id", "left_semi")
    found = interval_pairs(ref.select(*(k for k in keys if k != "exp_id")).distinct(), right, 0, overlap, None if every else pairs, bin_size=bin_size)
    outcome = merged(partly(found, keys, f"e_{value}", kind), keys, kind, name)
    on = keys if every else [k for k in keys if k != "sample_id"] + ["ref_id"]
    return counted.join(outcome if every else outcome.withColumnRenamed("sample_id", "ref_id"), on, "left").select(*counted.columns, name)


def _map_counts(ref: DataFrame, exp: DataFrame, pairs: DataFrame, names: list[str], every: bool) -> DataFrame:
    """In stripes, where each side is shuffled once; ref regions that are too long for these by a sweep."""
    short, long, exp_long = stripes.split(ref, exp, 0)
    right = exp.select("sample_id", *I.COORDS, F.lit(None).cast("long").alias("_before"))
    nothing = F.struct(*(F.lit(0).cast("long").alias(n) for n in names))
    met = _map_striped(short, right, pairs, every, stripes.counts(names), [(n, T.LongType()) for n in names], nothing, stripes.ends(), lambda right: stripes.carried(short, right))
    return met.unionByName(_map_swept(long, exp_long, pairs, names, every))


def _map_swept(ref: DataFrame, exp: DataFrame, pairs: DataFrame, names: list[str], every: bool) -> DataFrame:
    keys = [*I.COORDS, *([] if every else ["sample_id"])]
    rows, places = ref, ref.select(*keys).distinct()
    if every:
        rows = ref.join(per_sample(pairs.select(F.col("ref_id").alias("sample_id")).distinct()), "sample_id", "left_semi")
        asked = places.crossJoin(F.broadcast(pairs.select("exp_id").distinct()))  # a short row for each sample
    else:
        asked = places.join(per_pair(pairs.select(F.col("ref_id").alias("sample_id"), "exp_id")), "sample_id")
    counted = sweep.overlap_counts(asked, exp, "_hits").select(*(F.col(c).alias(f"_k_{c}") for c in keys), "exp_id", "_hits")
    own = [c for c in ref.columns if c != "sample_id"]
    met = rows.join(counted, _and([F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]))
    return met.select(F.col("sample_id").alias("ref_id"), "exp_id", *own, *(F.col("_hits").alias(n) for n in names))


def difference(ref: DataFrame, exp: DataFrame, pairs: DataFrame | None = None, exact: bool = False, keep_unmatched: bool = False, bin_size: int | str = BIN) -> DataFrame:
    """The ref regions that no strand-compatible exp region overlaps, or with exact, none with the same coordinates.

    With pairs only paired samples count; ref samples without a partner are dropped, unless keep_unmatched. Whether a
    region goes hangs on its coordinates (and its sample, with pairs) alone, so these are matched and anti-joined.
    """
    kept = ref
    if pairs is not None and not keep_unmatched:
        kept = ref.join(per_sample(pairs.select(F.col("ref_id").alias("sample_id")).distinct()), "sample_id", "left_semi")
    keys = [*I.COORDS, *(["sample_id"] if pairs is not None else [])]
    places = ref.select(*keys).distinct()
    if exact:
        right = _right(exp.select("sample_id", *I.COORDS).distinct())
        if pairs is not None:
            places = places.join(per_pair(pairs.select(F.col("ref_id").alias("sample_id"), F.col("exp_id").alias("pair_exp"))), "sample_id")
        on = [F.col(c) == F.col(f"e_{c}") for c in ("chrom", "start", "stop")] + [I.strands_agree(F.col("strand"), F.col("e_strand"))]
        on += [F.col("pair_exp") == F.col("exp_id")] if pairs is not None else []
        found = places.join(right, _and(on))
    else:
        overlap = I.overlaps(F.col("start"), F.col("stop"), F.col("e_start"), F.col("e_stop"))
        found = interval_pairs(places, exp.select("sample_id", *I.COORDS).distinct(), 0, overlap, pairs, bin_size=bin_size)
    return kept.join(found.select(*keys).distinct(), keys, "left_anti").select(*ref.columns)
