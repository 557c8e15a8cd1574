"""Regions beside those that can reach them, one stripe of the coordinate at a time: each side is shuffled once, and numpy matches them in the task.

A ref region belongs to the stripe of its start. An exp region is copied to the stripes with ref regions that it may reach, that is to one
of them if it is short. Rows arrive sorted by stripe, exp first: a task holds the exp regions of one stripe, reads the ref
regions batch by batch and makes at most some PAIRS of pairs at once. Ref regions longer than longest(reach), which would have partners in many stripes,
aren't for here: split() tells them apart, and what is done for them reads nothing if there are none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

STRIPE = 1 << 20
PAIRS = 1 << 20


def width(reach: int) -> int:
    return max(STRIPE, 8 * reach)


def longest(reach: int) -> int:
    """Ref regions up to this length are matched in one stripe."""
    return width(reach) // 16


def split(ref: DataFrame, exp: DataFrame, reach: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(short, long, exp for long): ref regions for beside() and the others, with the exp regions, of which there are none if nothing is long."""
    short = F.coalesce((F.col("stop") - F.col("start")).between(0, longest(reach)), F.lit(True))
    some = F.broadcast(ref.where(~short).agg((F.count(F.lit(1)) > 0).alias("_some")).where("_some"))
    return ref.where(short), ref.where(~short).join(some, F.lit(True), "left_semi"), exp.join(some, F.lit(True), "left_semi")


def _stripe(pos: Column, wide: int) -> Column:
    return F.floor(pos / wide).cast("long")


def beside(ref: DataFrame, exp: DataFrame, reach: int, answers: Callable[[Regions, Exp], Iterator[tuple]], adds: T.DataType | None = None, stripes: Column | None = None, more: DataFrame | None = None) -> DataFrame:
    """ref's columns and what answers adds, from each batch of ref regions and the exp regions that come within reach of its stripe.

    answers yields (numbers of ref rows, numbers of exp rows), and rows beside each other come out, exp as e_*; or, with adds (its
    type), (numbers of ref rows, an array), and the array comes out as _hits. If both sides have a column _partner, only regions that are equal in it are
    beside each other. stripes: other stripes than those an exp region reaches; more: rows in exp's shape with chrom and _stripe of their own.
    """
    wide = width(reach)
    keys = ["chrom", *(["_partner"] if "_partner" in exp.columns else []), "_stripe"]
    held = [c for c in exp.columns if c not in keys]
    own = [c for c in ref.columns if c not in keys]
    whole = lambda: F.col("chrom").isNotNull() & F.col("start").isNotNull() & F.col("stop").isNotNull()
    if stripes is None:
        stripes = F.sequence(_stripe(F.col("start") - (reach + longest(reach)), wide), _stripe(F.greatest("start", "stop") + reach, wide))
    right = exp.where(whole()).withColumn("_stripe", F.explode(stripes))
    right = right if more is None else right.unionByName(more)
    right = right.select(*keys, F.lit(0).alias("_side"), F.struct(*held).alias("_e"))
    left = ref.withColumn("_stripe", F.when(whole(), _stripe(F.col("start"), wide))).select(*keys, F.lit(1).alias("_side"), F.struct(*own).alias("_r"))
    both = right.unionByName(left, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, "_side")
    shape = left.select(*(k for k in keys if k != "_stripe"), "_r").schema
    shape = shape.add("_e", right.schema["_e"].dataType) if adds is None else shape.add("_hits", adds)

    names, kind = shape.names, to_arrow_type(shape[-1].dataType)

    def task(batches):
        at, parts, index = None, [], None
        for b in batches:
            cuts = _runs(b, [*keys, "_side"])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                run = b.slice(lo, hi - lo)
                key = tuple(run.column(k)[0].as_py() for k in keys)
                if key != at:
                    at, parts, index = key, [], None
                if run.column("_side")[0].as_py() == 0:
                    parts.append(run.column("_e"))
                    continue
                if index is None:
                    index, parts = Exp(parts, key[-1], wide), []
                for rows, found in answers(Regions(run.column("_r")), index):
                    if len(rows):
                        taken = [run.column(c).take(pa.array(rows)) for c in names[:-1]]
                        yield pa.RecordBatch.from_arrays([*taken, index.rows.take(pa.array(found)) if adds is None else found.cast(kind)], names)

    out = both.mapInArrow(task, shape)
    mine = [F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in ref.columns]
    if adds is not None:
        return out.select(*mine, "_hits")
    theirs = [F.col("chrom").alias("e_chrom") if c == "chrom" else F.col(f"_e.{c}").alias("exp_id" if c == "sample_id" else f"e_{c}") for c in exp.columns if c != "_partner"]
    return out.select(*mine, *theirs)


def _runs(b: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where runs of rows with equal keys begin, and the end."""
    n = b.num_rows
    new = np.zeros(max(n - 1, 0), bool)
    for k in keys if n > 1 else ():
        a, c = b.column(k).slice(1), b.column(k).slice(0, n - 1)
        differs = pc.or_(pc.fill_null(pc.not_equal(a, c), False), pc.not_equal(pc.is_null(a), pc.is_null(c)))
        new |= differs.to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(new) + 1, [n])) if n else np.zeros(1, int)


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


class Regions:
    """Rows with start, stop and strand. known tells those whose start and stop aren't null."""

    def __init__(self, rows: pa.StructArray):
        self.rows = rows
        self.start, self.stop = _numbers(self["start"]), _numbers(self["stop"])
        self.known = pc.and_(self["start"].is_valid(), self["stop"].is_valid()).to_numpy(zero_copy_only=False)
        encoded = self["strand"].dictionary_encode()
        self.strands, self.strand = encoded.dictionary.to_pylist(), pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False)

    def __getitem__(self, name: str) -> pa.Array:
        return pc.struct_field(self.rows, name)

    def by_strand(self) -> Iterator[tuple[str | None, np.ndarray]]:
        """Each strand with the numbers of its rows, as far as they are known."""
        for n in np.unique(self.strand[self.known]):
            yield None if n < 0 else self.strands[n], np.flatnonzero(self.known & (self.strand == n))


class Exp:
    """The exp regions of a stripe, which begins at low."""

    def __init__(self, parts: list[pa.StructArray], stripe: int | None, wide: int):
        self.empty, self.wide = not parts, wide
        self.low = None if stripe is None else stripe * wide
        self._lanes = {}
        if parts:
            all_ = Regions(pa.concat_arrays(parts))
            self.rows, self.start, self.stop, self.known, self._all = all_.rows, all_.start, all_.stop, all_.known, all_
            self.sample = _numbers(all_["sample_id"])

    def __getitem__(self, name: str) -> pa.Array:
        return self._all[name]

    def lanes(self, strand: str | None) -> list[Lane]:
        """The regions that agree with the strand, sample by sample."""
        if self.empty:
            return []
        if strand not in self._lanes:
            fits = np.array([strand == "*" or s in ("*", strand) for s in self._all.strands] + [strand == "*"], bool)
            rows = np.flatnonzero(fits[self._all.strand])
            rows = rows[np.argsort(self.sample[rows], kind="stable")]
            ids, first = np.unique(self.sample[rows], return_index=True)
            self._lanes[strand] = [Lane(self, int(i), rows[a:b]) for i, a, b in zip(ids, first, [*first[1:], len(rows)], strict=False)]
        return self._lanes[strand]


class Lane:
    """The exp regions of one sample that agree with a strand; rows are their numbers."""

    def __init__(self, exp: Exp, sample: int, rows: np.ndarray):
        self.exp, self.sample, self.rows = exp, sample, rows
        self.start, self.stop = exp.start[rows], exp.stop[rows]
        self.made = {}  # what answers make of the lane once

    @cached_property
    def odd(self) -> np.ndarray:
        """Those with the start above the stop, which overlap what holds both."""
        return np.flatnonzero(self.start > self.stop)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.sort(self.start[self.start <= self.stop])

    @cached_property
    def stops(self) -> np.ndarray:
        return np.sort(self.stop[self.start <= self.stop])

    @cached_property
    def points(self) -> np.ndarray:
        """Places of empty regions."""
        return np.sort(self.start[self.start == self.stop])

    @cached_property
    def classes(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(most length, order by start, starts) of regions of lengths alike, so that long ones don't widen the search for short ones."""
        size = np.maximum(self.stop - self.start, 0)
        power = np.maximum(np.frexp(size.astype(float))[1], 6)
        out = []
        for p in np.unique(power):
            own = np.flatnonzero(power == p)
            own = own[np.argsort(self.start[own], kind="stable")]
            out.append((int(size[own].max()), own, self.start[own]))
        return out

    def near(self, start: np.ndarray, stop: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(order, from, to) of each class: the regions among which are those that overlap [start, stop)."""
        return [(own, a := np.searchsorted(starts, start - most, "right"), np.maximum(a, np.searchsorted(starts, stop, "left"))) for most, own, starts in self.classes]

    def overlapping(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the asked, numbers in the lane) of overlapping pairs."""
        found = [(q, own[n]) for own, a, b in self.near(start, stop) for q, n in (spread(a, b),)]
        q, n = (np.concatenate(x) for x in zip(*found, strict=True))
        fits = (start[q] < self.stop[n]) & (self.start[n] < stop[q])
        return q[fits], n[fits]

    def odd_over(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """overlapping, of odd ones alone."""
        if not len(self.odd):
            return np.zeros(0, int), np.zeros(0, int)
        q, n = Lane(self.exp, self.sample, self.rows[self.odd]).overlapping(start, stop)
        return q, self.odd[n]


def spread(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, n) for each i and each n of a[i] to b[i] - 1."""
    size = b - a
    i = np.repeat(np.arange(len(a)), size)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)


def chunks(sizes: np.ndarray) -> list[slice]:
    """Slices of rows of which each has at most PAIRS by sizes, or is one row."""
    total, out, at = np.cumsum(sizes), [], 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        out.append(slice(at, end))
        at = end
    return out


def hits(rows: int, found: list[tuple[np.ndarray, int, list[pa.Array]]], names: list[str]) -> pa.Array:
    """For each of the rows an array of (id, sums) from (numbers of rows, sample, the sums beside them)."""
    if not found:
        return pa.array([[]] * rows, pa.list_(pa.null()))
    number = np.concatenate([f[0] for f in found])
    ids = np.concatenate([np.full(len(f[0]), f[1]) for f in found])
    sums = pa.StructArray.from_arrays([pa.concat_arrays([f[2][n] for f in found]) for n in range(len(names))], names)
    cells = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), sums], ["id", "sums"])
    ends = np.concatenate(([0], np.cumsum(np.bincount(number, minlength=rows))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells.take(pa.array(np.argsort(number, kind="stable"))))


# --- MAP: counts, least and greatest without pairs -----------------------------------------------------------------------


def counted(lane: Lane, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """How many of the lane's regions overlap each of the asked: starts below the stop less stops up to the start. An empty region beside an empty one is in both or in none."""
    both = np.searchsorted(lane.points, start, "right") - np.searchsorted(lane.points, start, "left")
    return np.searchsorted(lane.starts, stop, "left") - np.searchsorted(lane.stops, start, "right") + np.where(start == stop, both, 0)


class Ranks:
    """The greatest rank of the regions that overlap an asked one, 0 if there is none: of those over its start, and of those that start inside it."""

    def __init__(self, start: np.ndarray, stop: np.ndarray, rank: np.ndarray):
        order = np.argsort(start, kind="stable")
        self.starts, self.levels = start[order], [rank[order]]
        # places are doubled, so that an empty region has one of its own, between two bases
        low, high, rank = 2 * start[start < stop] + 1, 2 * stop[start < stop], rank[start < stop]
        self.points = np.unique(np.concatenate((low, high)))
        a, b = np.searchsorted(self.points, low), np.searchsorted(self.points, high)
        level = np.frexp((b - a).astype(float))[1] - 1  # each is two stretches of a power of two, and these are halved down to points
        over = np.zeros(len(self.points), np.int64)
        for n in range(int(level.max(initial=0)), -1, -1):
            wide, over = over, over.copy()
            np.maximum(over[1 << n :], wide[: max(len(wide) - (1 << n), 0)], out=over[1 << n :])
            own = level == n
            np.maximum.at(over, a[own], rank[own])
            np.maximum.at(over, b[own] - (1 << n), rank[own])
        self.over = np.concatenate(([0], over))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = self.over[np.searchsorted(self.points, 2 * start + (start < stop), "right")]
        a, b = np.searchsorted(self.starts, start, "right"), np.searchsorted(self.starts, stop, "left")
        inside = np.flatnonzero(a < b)
        a, b = a[inside], b[inside]
        level = np.frexp((b - a).astype(float))[1] - 1
        for n in np.unique(level):
            while len(self.levels) <= n:  # the greatest of the next 2, 4, 8...
                last, half = self.levels[-1], 1 << (len(self.levels) - 1)
                self.levels.append(np.maximum(last[: len(last) - half], last[half:]))
            at = level == n
            most = np.maximum(self.levels[n][a[at]], self.levels[n][b[at] - (1 << n)])
            out[inside[at]] = np.maximum(out[inside[at]], most)
        return out


def extremes(names: list[str], kinds: list[tuple[str, str | None]]) -> Callable:
    """Answers of MAP with the kinds COUNT, COUNT_NON_NULL, MIN and MAX of values that are numbers."""

    def part(lane: Lane, value: str | None) -> Lane:
        """The regions of which the value isn't null."""
        if value is None:
            return lane
        if value not in lane.made:
            lane.made[value] = Lane(lane.exp, lane.sample, lane.rows[lane.exp[value].is_valid().to_numpy(zero_copy_only=False)[lane.rows]])
        return lane.made[value]

    def ranks(lane: Lane, kind: str, value: str) -> tuple[np.ndarray, np.ndarray, Ranks]:
        """(values by rank from 1, ranks of the regions, the finder of the greatest)."""
        if kind not in lane.made:
            values, rank = np.unique(lane.exp[value].take(pa.array(lane.rows)).to_numpy(zero_copy_only=False), return_inverse=True)
            if kind == "MIN":
                values, rank = values[::-1], len(values) - 1 - rank
            rank, usual = rank + 1, lane.start <= lane.stop
            lane.made[kind] = values, rank, Ranks(lane.start[usual], lane.stop[usual], rank[usual])
        return lane.made[kind]

    def column(lane: Lane, start: np.ndarray, stop: np.ndarray, kind: str, value: str | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Numbers, and which of them are null."""
        lane = part(lane, value)
        q, n = lane.odd_over(start, stop)
        if kind != "MAX" and kind != "MIN":
            return counted(lane, start, stop) + np.bincount(q, minlength=len(start)), None
        values, rank, finder = ranks(lane, kind, value)
        found = finder.of(start, stop)
        np.maximum.at(found, q, rank[n])
        return values[np.maximum(found, 1) - 1] if len(values) else found, found == 0

    def answers(r: Regions, e: Exp):
        found = []
        for strand, rows in r.by_strand():
            start, stop = r.start[rows], r.stop[rows]
            for lane in e.lanes(strand):
                columns = [column(lane, start, stop, *k) for k in [("COUNT", None), *kinds]]
                hit = np.flatnonzero(columns[0][0] > 0)
                if len(hit):
                    found.append((rows[hit], lane.sample, [pa.array(v[hit], mask=None if null is None else null[hit]) for v, null in columns]))
        yield np.arange(len(r.start)), hits(len(r.start), found, names)

    return answers


# --- MAP: counts alone, and the user's merging aggregates ------------------------------------------------------------------


def ends(reach: int = 0) -> Column:
    """Stripes of a region's stop and of the ref regions that may have its start inside; none of those between them."""
    wide = width(reach)
    return F.array_distinct(F.array(_stripe(F.col("start") - longest(reach), wide), _stripe(F.col("start"), wide), _stripe(F.col("stop"), wide)))


def carried(ref: DataFrame, exp: DataFrame) -> DataFrame:
    """Rows for beside() in the stripes of ref regions: _before is how many exp regions of the sample and strand begin before the stripe and stop in or after it."""
    wide, axis = width(0), ["sample_id", "chrom", "strand"]
    whole = F.col("chrom").isNotNull() & (_stripe(F.col("start"), wide) != _stripe(F.col("stop"), wide))
    at = lambda name, n: F.struct(_stripe(F.col(name), wide).alias("_stripe"), F.lit(n).cast("long").alias("_before"))
    marks = exp.where(whole).select(*axis, F.inline(F.array(at("start", 1), at("stop", -1)))).groupBy(*axis, "_stripe").agg(F.sum("_before").alias("_before"))
    asked = ref.select("chrom", _stripe(F.col("start"), wide).alias("_stripe")).distinct()
    asked = marks.select(*axis).distinct().join(asked, "chrom").withColumns({"_before": F.lit(0).cast("long"), "_asked": F.lit(True)})
    before = Window.partitionBy(*axis).orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    sums = marks.withColumn("_asked", F.lit(False)).unionByName(asked).groupBy(*axis, "_stripe").agg(F.sum("_before").alias("_before"), F.max("_asked").alias("_asked"))
    out = sums.withColumn("_before", F.sum("_before").over(before)).where("_asked and _before != 0").drop("_asked")
    out = out.withColumns({"start": F.lit(None).cast(exp.schema["start"].dataType), "stop": F.lit(None).cast(exp.schema["stop"].dataType)})
    return out.withColumn("_partner", F.col("sample_id")) if "_partner" in exp.columns else out


def counts(names: list[str]) -> Callable:
    """Answers of MAP with counts alone, all under names, from exp regions in their ends() and carried()."""

    def inside(lane: Lane) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(regions over the stripe's begin, starts, stops and places of empty regions in it)."""
        if "ends" not in lane.made:
            known, low = lane.exp.known[lane.rows], lane.exp.low
            start, stop = lane.start[known], lane.stop[known]
            before = _numbers(lane.exp["_before"])[lane.rows].sum()
            lane.made["ends"] = int(before), np.sort(start[start >= low]), np.sort(stop[(stop >= low) & (stop < low + lane.exp.wide)]), np.sort(start[start == stop])
        return lane.made["ends"]

    def answers(r: Regions, e: Exp):
        found = []
        for strand, rows in r.by_strand():
            start, stop = r.start[rows], r.stop[rows]
            for lane in e.lanes(strand):
                before, starts, stops, points = inside(lane)
                both = np.searchsorted(points, start, "right") - np.searchsorted(points, start, "left")
                n = before + np.searchsorted(starts, stop, "left") - np.searchsorted(stops, start, "right") + np.where(start == stop, both, 0)
                hit = np.flatnonzero(n)
                found.append((rows[hit], lane.sample, [pa.array(n[hit], pa.int64())] * len(names)))
        yield np.arange(len(r.start)), hits(len(r.start), found, names)

    return answers


def merging(names: list[str], kind) -> Callable:
    """Answers of MAP with a count and the outcome of kind, a Merging, over the column _value."""

    def answers(r: Regions, e: Exp):
        import pandas as pd

        asked = [(rows, lane) for strand, rows in r.by_strand() for lane in e.lanes(strand)]
        sizes = np.zeros(len(r.start), int)
        for rows, lane in asked:
            sizes[rows] += sum(b - a for _, a, b in lane.near(r.start[rows], r.stop[rows]))
        for part in chunks(sizes):
            found = []
            for rows, lane in asked:
                rows = rows[(rows >= part.start) & (rows < part.stop)]
                q, n = lane.overlapping(r.start[rows], r.stop[rows])
                if not len(q):
                    continue
                f = pd.DataFrame({"q": q, "v": e["_value"].take(pa.array(lane.rows[n])).to_numpy(zero_copy_only=False)})
                hit, size = np.unique(q, return_counts=True)
                full = np.bincount(q[f["v"].notna()], minlength=len(rows))[hit]
                merged = f[f["v"].notna()].groupby("q")["v"].agg(kind.merge).reindex(hit)
                values = [kind.out(m if some else None, int(all_), int(some)) for m, all_, some in zip(merged, size, full, strict=True)]
                found.append((rows[hit] - part.start, lane.sample, [pa.array(size, pa.int64()), pa.array([None if v is None else float(v) for v in values], pa.float64())]))
            yield np.arange(part.start, part.stop), hits(part.stop - part.start, found, names)

    return answers


# --- nearest -----------------------------------------------------------------------------------------------------------


def _least(q: np.ndarray, gap: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the entries whose gap is among the k least of their q, ties kept."""
    order = np.lexsort((gap, q))
    q, gap = q[order], gap[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = q[1:] != q[:-1]
    other = fresh.copy()
    other[1:] |= gap[1:] != gap[:-1]
    rank = np.cumsum(other)
    return order[rank - np.maximum.accumulate(np.where(fresh, rank, 0)) < k]


def nearest(k: int, apart: int, reach: int, over: bool, before: Callable, after: Callable) -> Callable:
    """Answers of MinDistance(k): pairs whose gap is among the k least up to reach, of those that before tells to be fit; after filters what is left.

    Beside a region the k nearest stops up to its start - apart and the k nearest starts from its stop + apart are enough; with over,
    overlapping ones are looked at as well. before and after take a gap and the coordinates of both sides.
    """

    def ties(lane: Lane, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, distinct positions, where each begins in order, and the end)."""
        if name not in lane.made:
            order = np.argsort(getattr(lane, name), kind="stable")
            at, first = np.unique(getattr(lane, name)[order], return_index=True)
            lane.made[name] = order, at, np.append(first, len(order))
        return lane.made[name]

    def windows(lane: Lane, start: np.ndarray, stop: np.ndarray) -> list[tuple]:
        """(side, order, from, to): regions before, after and about the asked."""
        order, at, first = ties(lane, "stop")
        n = np.searchsorted(at, start - apart, "right")
        out = [(-1, order, first[np.maximum(n - k, 0)], first[n])]
        order, at, first = ties(lane, "start")
        n = np.searchsorted(at, stop + apart, "left")
        out.append((1, order, first[n], first[np.minimum(n + k, len(at))]))
        return out + [(0, *w) for w in lane.near(start, stop)] if over else out

    def found(lane: Lane, found: list[tuple], part: slice, start: np.ndarray, stop: np.ndarray, minus: bool) -> tuple[np.ndarray, np.ndarray]:
        qs, ns = [], []
        for side, order, a, b in found:
            q, n = spread(a[part], b[part])
            n = order[n]
            if side >= 0:
                fits = lane.stop[n] > start[q] - apart  # an empty region beside an empty one is on both sides
                if side == 0:
                    fits &= lane.start[n] < stop[q]
                q, n = q[fits], n[fits]
            qs.append(q)
            ns.append(n)
        q, n = np.concatenate(qs), np.concatenate(ns)
        places = lambda: (np.maximum(start[q] - lane.stop[n], lane.start[n] - stop[q]), minus, start[q], stop[q], lane.start[n], lane.stop[n])
        gap, *rest = places()
        fits = (gap <= reach) & before(gap, *rest)
        q, n = q[fits], n[fits]
        kept = _least(q, gap[fits], k)
        q, n = q[kept], n[kept]
        fits = after(*places())
        return q[fits], n[fits]

    def answers(r: Regions, e: Exp):
        for strand, rows in r.by_strand():
            start, stop = r.start[rows], r.stop[rows]
            lanes = [(lane, windows(lane, start, stop)) for lane in e.lanes(strand)]
            for part in chunks(sum((b - a for _, w in lanes for *_, a, b in w), np.zeros(len(rows), int))) if lanes else ():
                met = [(found(lane, w, part, start[part], stop[part], strand == "-"), lane) for lane, w in lanes]
                yield rows[part][np.concatenate([q for (q, _), _ in met])], np.concatenate([lane.rows[n] for (_, n), lane in met])

    return answers
