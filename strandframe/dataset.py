"""The fluent API: a dataset is a DataFrame of regions and one of metadata, and every operator makes a new one, lazily."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import ids
from .operators import cover as cover_ops
from .operators import genometric, matrix, metadata, regions


@dataclass(frozen=True)
class Dataset:
    """regions: sample_id, chrom, start, stop, strand, values...; meta: sample_id, attribute, value."""

    regions: DataFrame
    meta: DataFrame

    @classmethod
    def of(cls, regions: DataFrame, meta: DataFrame | None = None) -> Dataset:
        """From DataFrames; without metadata each sample gets none."""
        if missing := {"sample_id", "chrom", "start", "stop", "strand"} - set(regions.columns):
            raise ValueError(f"regions lack {', '.join(sorted(missing))}")
        empty = regions.sparkSession.createDataFrame([], "sample_id long, attribute string, value string")
        return cls(regions, empty if meta is None else meta.select("sample_id", "attribute", "value"))

    @property
    def values(self) -> list[str]:
        return [c for c in self.regions.columns if c not in ("sample_id", "chrom", "start", "stop", "strand")]

    def samples(self) -> DataFrame:
        """The ids in the metadata, or of the regions if there is no metadata. Lazily: whether there is any is a one-row table of the plan."""
        listed = self.meta.select("sample_id").distinct()
        none = self.meta.agg((F.count("*") == 0).alias("_none")).where("_none")
        return listed.unionByName(self.regions.select("sample_id").distinct().join(F.broadcast(none), F.col("_none"), "left_semi"))

    # --- one dataset -------------------------------------------------------------------------------------------

    def select(self, meta: metadata.Predicate | None = None, region: Callable[[regions.Scope], Column] | None = None) -> Dataset:
        """Samples by a metadata predicate, then regions by a predicate of their own."""
        out = self
        if meta is not None:
            found = metadata.samples_where(self.meta, meta)
            out = Dataset(metadata.restricted(self.regions, found), metadata.restricted(self.meta, found))
        return Dataset(regions.select(out.regions, region, out.meta), out.meta) if region is not None else out

    def select_in(self, external: Dataset, attributes, negated: bool = False) -> Dataset:
        found = metadata.semi_join(self.meta, external.meta, attributes, negated)
        return Dataset(metadata.restricted(self.regions, found), metadata.restricted(self.meta, found))

    def purge(self) -> Dataset:
        """Drops regions of samples without metadata, and metadata of samples without regions."""
        return Dataset(metadata.restricted(self.regions, self.meta), metadata.restricted(self.meta, self.regions))

    def project(self, keep: list[str] | None = None, extend: dict[str, Callable[[regions.Scope], Column]] | None = None, meta_keep: list[str] | None = None, meta_drop: list[str] | None = None) -> Dataset:
        out = regions.project(self.regions, keep, extend, self.meta) if keep is not None or extend else self.regions
        meta = metadata.project(self.meta, meta_keep) if meta_keep is not None else metadata.project(self.meta, meta_drop, keep=False) if meta_drop is not None else self.meta
        return Dataset(out, meta)

    def project_rows(self, function, returns: str, meta: list[str] = ()) -> Dataset:
        """Values from a function of one's own: pandas columns in, pandas columns out (see regions.project_rows)."""
        return Dataset(regions.project_rows(self.regions, function, returns, self.meta, meta), self.meta)

    def project_meta(self, name: str, inputs: list[str], value: Callable[..., Column]) -> Dataset:
        return Dataset(self.regions, metadata.extend(self.meta, name, inputs, value))

    def extend(self, aggregates: dict) -> Dataset:
        return Dataset(self.regions, regions.extend_metadata(self.regions, self.meta, aggregates))

    def group(self, attributes=(), by: list[str] | None = None, aggregates: dict | None = None, meta_aggregates: dict | None = None, group_name: str = "_group") -> Dataset:
        meta = metadata.group(self.meta, attributes, group_name, meta_aggregates) if attributes else self.meta
        return Dataset(regions.group(self.regions, by, aggregates) if by is not None or aggregates else self.regions, meta)

    def order(self, keys: list[tuple[str, bool]] | None = None, meta_keys: list[tuple[str, bool]] | None = None, meta_cut: dict | None = None, **cut) -> Dataset:
        """Orders regions within samples by keys, and samples by meta_keys; cut: top, percent, within_leading, position.

        With both, meta_cut cuts samples and cut the regions of those that are left; with meta_keys alone, cut is theirs.
        """
        out = self
        if meta_keys:
            meta = metadata.order(self.meta, meta_keys, **(meta_cut or ({} if keys else cut)))
            out = Dataset(metadata.restricted(self.regions, meta), meta)
        return Dataset(regions.order(out.regions, keys, **cut), out.meta) if keys or not meta_keys else out

    def merge(self, attributes=()) -> Dataset:
        groups = metadata.sample_groups(self.meta, attributes) if attributes else None
        return Dataset(regions.merge(self.regions, groups), metadata.merge(self.meta, groups))

    def cover(self, kind: str = "COVER", least=1, most=cover_ops.ANY, attributes=(), aggregates: dict | None = None, jaccard: bool = False) -> Dataset:
        groups = metadata.sample_groups(self.meta, attributes) if attributes else None
        meta = metadata.merge(self.meta, groups) if groups is not None else self.meta.select(F.lit(0).cast("long").alias("sample_id"), "attribute", "value").distinct()
        return Dataset(cover_ops.cover(self.regions, kind, least, most, groups, aggregates, jaccard), meta)

    # --- two datasets --------------------------------------------------------------------------------------------

    def pairs(self, other: Dataset, attributes=()) -> DataFrame:
        if attributes:
            return metadata.sample_pairs(self.meta, other.meta, attributes)
        return metadata.sample_pairs(self.samples(), other.samples())

    def _paired(self, found: DataFrame, meta: DataFrame) -> Dataset:
        """Both ids become one."""
        one = ids.pair_id(F.col("ref_id"), F.col("exp_id")).alias("sample_id")
        return Dataset(found.select(one, *(c for c in found.columns if c not in ("ref_id", "exp_id"))), meta.select(one, "attribute", "value"))

    def join(self, other: Dataset, conditions=(), builder: str = "LEFT", attributes=(), on: list[str] = (), **options) -> Dataset:
        pairs = self.pairs(other, attributes)
        found = genometric.join(self.regions, other.regions, conditions, builder, pairs if attributes else None, on, **options)
        keep = {"LEFT_DISTINCT": "left", "RIGHT_DISTINCT": "right"}.get(builder.upper(), "both")
        return self._paired(found, metadata.combine(self.meta, other.meta, pairs, keep))

    def map(self, other: Dataset, aggregates: dict | None = None, attributes=(), count: str = "count", **options) -> Dataset:
        pairs = self.pairs(other, attributes)
        return self._paired(genometric.map_regions(self.regions, other.regions, pairs, aggregates, count, every=not attributes, **options), metadata.combine(self.meta, other.meta, pairs))

    def difference(self, other: Dataset, attributes=(), exact: bool = False, keep_unmatched: bool = False) -> Dataset:
        pairs = self.pairs(other, attributes) if attributes else None
        out = genometric.difference(self.regions, other.regions, pairs, exact, keep_unmatched)
        meta = self.meta if pairs is None or keep_unmatched else self.meta.join(pairs.select(F.col("ref_id").alias("sample_id")).distinct(), "sample_id", "left_semi")
        fresh = ids.single_id(F.col("sample_id"))
        return Dataset(out.withColumn("sample_id", fresh), meta.select(fresh.alias("sample_id"), F.concat(F.lit("left."), "attribute").alias("attribute"), "value"))

    def union(self, other: Dataset, names: tuple[str, str] = ("left", "right")) -> Dataset:
        """Both datasets' samples under new ids; values by name, null where a side lacks one; _provenance tells the side."""
        sides = []
        for side, (name, ds) in enumerate(zip(names, (self, other), strict=True)):
            fresh = ids.pair_id(F.lit(side), F.col("sample_id"))
            listed = ds.meta.select("sample_id").distinct().select("sample_id", F.lit("_provenance").alias("attribute"), F.lit(name).alias("value"))
            sides.append((ds.regions.withColumn("sample_id", fresh), ds.meta.unionByName(listed).withColumn("sample_id", fresh)))
        (r0, m0), (r1, m1) = sides
        return Dataset(r0.unionByName(r1, allowMissingColumns=True), m0.unionByName(m1).distinct())

    def union_meta(self, other: Dataset) -> Dataset:
        """Distinct union of the metadata, ids unchanged."""
        return Dataset(self.regions, self.meta.unionByName(other.meta).distinct())

    # --- results -------------------------------------------------------------------------------------------------------

    def take(self, n: int) -> Dataset:
        return Dataset(regions.take(self.regions, n), self.meta)

    def collect(self) -> tuple[list, list, list[str]]:
        """(regions, metadata, value names) on the driver; for results that fit there."""
        return self.regions.collect(), self.meta.collect(), self.values

    def to_matrix(self) -> DataFrame:
        return matrix.to_matrix(self.regions)
