"""Metadata operators. Metadata is long: sample_id, attribute, value; an attribute may have many values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def named(attribute: str) -> Column:
    """Rows whose attribute has this name, perhaps behind a dotted prefix."""
    return (F.col("attribute") == attribute) | F.col("attribute").endswith("." + attribute)


def as_number(value: Column) -> Column:
    return value.try_cast("double")


# --- predicates: each leaf is a flag that holds if some row of the sample satisfies it -----------------


@dataclass(frozen=True)
class Predicate:
    """A condition on a whole sample. leaves: conditions on a metadata row; entries: the same on a row of a metadata index; names: the attributes that they ask for; holds: the tree over their flags."""

    leaves: tuple[Column, ...]
    entries: tuple[Column, ...]
    names: tuple[str, ...]
    holds: Callable[[list[Column]], Column]

    def _with(self, other: Predicate, join: Callable[[Column, Column], Column]) -> Predicate:
        n = len(self.leaves)
        return Predicate(self.leaves + other.leaves, self.entries + other.entries, self.names + other.names, lambda f: join(self.holds(f[:n]), other.holds(f[n:])))

    def __and__(self, other: Predicate) -> Predicate:
        return self._with(other, lambda a, b: a & b)

    def __or__(self, other: Predicate) -> Predicate:
        return self._with(other, lambda a, b: a | b)

    def __invert__(self) -> Predicate:
        return Predicate(self.leaves, self.entries, self.names, lambda f: ~self.holds(f))


def _leaf(name: str, value: Column | None = None, entry: Column | None = None) -> Predicate:
    """The name on a row whose value satisfies value, or on an entry of an index that satisfies entry; without these, on any."""
    row, known = named(name), F.col("name") == name
    row, known = (row if value is None else row & value), (known if entry is None else known & entry)
    return Predicate((F.coalesce(row, F.lit(False)),), (known,), (name,), lambda f: f[0])


class Attribute:
    """Comparisons with an attribute: numeric if the literal is a number (or spells one), else by case-insensitive text."""

    def __init__(self, name: str):
        self.name = name

    def _equal(self, literal, number: Column, text: Column) -> Column:
        if str(literal) == "*":
            return F.lit(True)
        try:
            return number == float(literal)
        except ValueError:
            return text == str(literal).lower()

    def _compared(self, compare: Callable[[Column, Column], Column]) -> Predicate:
        """compare takes the value as a number and in lower case."""
        return _leaf(self.name, compare(as_number(F.col("value")), F.lower("value")), compare(F.col("number"), F.col("text")))

    def _ordered(self, compare: Callable[[Column, float], Column], literal) -> Predicate:
        try:
            number = float(literal)
        except ValueError:
            raise ValueError(f"order comparisons need a number, not {literal!r}") from None
        return self._compared(lambda v, _: compare(v, number))

    def __eq__(self, literal):
        return self._compared(lambda n, t: self._equal(literal, n, t))

    def __ne__(self, literal):
        return self._compared(lambda n, t: ~F.coalesce(self._equal(literal, n, t), F.lit(False)))

    __hash__ = None

    def __gt__(self, literal):
        return self._ordered(lambda v, n: v > n, literal)

    def __ge__(self, literal):
        return self._ordered(lambda v, n: v >= n, literal)

    def __lt__(self, literal):
        return self._ordered(lambda v, n: v < n, literal)

    def __le__(self, literal):
        return self._ordered(lambda v, n: v <= n, literal)

    def exists(self) -> Predicate:
        return _leaf(self.name)

    def missing(self) -> Predicate:
        return ~self.exists()


def attribute(name: str) -> Attribute:
    return Attribute(name)


def samples_where(meta: DataFrame, predicate: Predicate) -> DataFrame:
    """The ids of the samples that satisfy the predicate."""
    flags = [f"_p{i}" for i in range(len(predicate.leaves))]
    met = meta.groupBy("sample_id").agg(*(F.count_if(c).alias(n) for c, n in zip(predicate.leaves, flags, strict=True)))
    return met.where(predicate.holds([F.col(n) > 0 for n in flags])).select("sample_id")  # by a comparison, which Spark takes as selective when it prunes partitions


def per_sample(df: DataFrame) -> DataFrame:
    """A table of one short row for each sample, broadcast: samples are files, ten million of them take some 200 MB, and a shuffle of regions by sample would have as many tasks at work as there are large samples."""
    return F.broadcast(df)


#: So many pairs of samples are broadcast; more are joined by a shuffle.
PAIRS = 1_000_000


def per_pair(pairs: DataFrame) -> DataFrame:
    """A table with a row for each pair of samples: broadcast if there are at most PAIRS of them (they are counted, from metadata alone), since pairs may grow as the square of samples."""
    return F.broadcast(pairs) if pairs.limit(PAIRS + 1).count() <= PAIRS else pairs


def restricted(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(per_sample(ids.select("sample_id").distinct()), "sample_id", "left_semi")


def first_value(meta: DataFrame, name: str, alias: str) -> DataFrame:
    """One value of the attribute for each sample that has it; the least, so the choice is the same each time."""
    return meta.where(named(name)).groupBy("sample_id").agg(F.min("value").alias(alias))


# --- matching of samples ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class By:
    """An attribute for grouping or pairing. how: default (suffixes match), full (whole names must agree) or exact."""

    name: str
    how: str = "default"

    def rows(self, meta: DataFrame) -> DataFrame:
        """(sample_id, key, value) of the rows that count."""
        if self.how not in ("default", "full", "exact"):
            raise ValueError(f"how is default, full or exact, not {self.how!r}")
        match = F.col("attribute") == self.name if self.how == "exact" else named(self.name)
        key = F.col("attribute") if self.how == "full" else F.lit(self.name)
        return meta.where(match).select("sample_id", key.alias("key"), "value").distinct()


def _bys(attributes) -> list[By]:
    return [a if isinstance(a, By) else By(a) for a in attributes]


def sample_pairs(left: DataFrame, right: DataFrame, attributes=()) -> DataFrame:
    """(ref_id, exp_id): samples that share a value of every attribute; all pairs of samples without attributes."""
    if not attributes:
        return left.select(F.col("sample_id").alias("ref_id")).distinct().crossJoin(per_sample(right.select(F.col("sample_id").alias("exp_id")).distinct()))
    out = None
    for by in _bys(attributes):
        a = by.rows(left).withColumnRenamed("sample_id", "ref_id")
        pairs = a.join(by.rows(right).withColumnRenamed("sample_id", "exp_id"), ["key", "value"]).select("ref_id", "exp_id").distinct()
        out = pairs if out is None else out.join(pairs, ["ref_id", "exp_id"])
    return out


def semi_join(meta: DataFrame, external: DataFrame, attributes, negated: bool = False) -> DataFrame:
    """Ids of the samples that share a value of every attribute with one external sample; with negated, of the others."""
    found = sample_pairs(meta, external, attributes).select(F.col("ref_id").alias("sample_id")).distinct()
    return meta.select("sample_id").distinct().join(found, "sample_id", "left_anti") if negated else found


def sample_groups(meta: DataFrame, attributes) -> DataFrame:
    """(sample_id, group_id): samples with equal sets of values in each attribute; those with none of them are left out.

    group_id counts from 1 in the order of the groups' values, so it is the same each time.
    """
    keyed = None
    for by in _bys(attributes):
        rows = by.rows(meta)
        keyed = rows if keyed is None else keyed.unionByName(rows)
    sets = keyed.groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "key", "value"))), "&").alias("_key"))
    numbers = sets.select("_key").distinct().withColumn("group_id", F.dense_rank().over(Window.orderBy("_key")).cast("long"))  # one row for each group
    return sets.join(numbers, "_key").select("sample_id", "group_id")


# --- building metadata ----------------------------------------------------------------------------------------


def combine(left: DataFrame, right: DataFrame, pairs: DataFrame, keep: str = "both") -> DataFrame:
    """Metadata of paired samples: left.* and right.* under both ids; with keep left or right one side's rows, without a prefix."""
    a = left.withColumnRenamed("sample_id", "ref_id").join(pairs, "ref_id")
    b = right.withColumnRenamed("sample_id", "exp_id").join(pairs, "exp_id")
    shape = lambda df, prefix: df.select("ref_id", "exp_id", F.concat(F.lit(prefix), "attribute").alias("attribute"), "value")
    if keep == "left":
        return shape(a, "").distinct()
    if keep == "right":
        return shape(b, "").distinct()
    return shape(a, "left.").unionByName(shape(b, "right.")).distinct()


def project(meta: DataFrame, names: list[str], keep: bool = True) -> DataFrame:
    """Only the named attributes, or all but them; a name stands for itself and for it before or behind a dot."""
    match = F.lit(False)
    for n in names:
        match = match | named(n) | F.col("attribute").startswith(n + ".")
    return meta.where(match if keep else ~match)


def extend(meta: DataFrame, name: str, inputs: list[str], value: Callable[..., Column]) -> DataFrame:
    """Sets attribute name to value(arrays of the inputs' values, in order) in each sample, in place of what had that name."""
    arrays = [F.array_sort(F.collect_list(F.when(named(i), F.col("value")))).alias(f"_a{k}") for k, i in enumerate(inputs)]
    grouped = meta.groupBy("sample_id").agg(*arrays) if arrays else meta.select("sample_id").distinct()
    fresh = grouped.select("sample_id", F.lit(name).alias("attribute"), value(*(F.col(f"_a{k}") for k in range(len(inputs)))).cast("string").alias("value"))
    return meta.where(~named(name)).unionByName(fresh)


def group(meta: DataFrame, attributes, group_name: str = "_group", aggregates: dict[str, tuple[str | None, Callable[[Column], Column]]] | None = None) -> DataFrame:
    """Adds each sample's group number as an attribute, 0 without one, and for each aggregate (attribute, function) the group's value."""
    groups = meta.select("sample_id").distinct().join(sample_groups(meta, attributes), "sample_id", "left").select("sample_id", F.coalesce("group_id", F.lit(0)).alias("group_id"))
    out = meta.unionByName(groups.select("sample_id", F.lit(group_name).alias("attribute"), F.col("group_id").cast("string").alias("value")))
    for name, (source, function) in (aggregates or {}).items():
        rows = meta.join(groups, "sample_id")
        value = function(F.col("value")) if source else F.count_distinct("sample_id")
        per_group = (rows.where(named(source)) if source else rows).groupBy("group_id").agg(value.cast("string").alias("value"))
        out = out.unionByName(groups.join(per_group, "group_id").select("sample_id", F.lit(name).alias("attribute"), "value"))
    return out


def merge(meta: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """All samples as one, with id 1, or one for each group."""
    if groups is None:
        return meta.select(F.lit(1).cast("long").alias("sample_id"), "attribute", "value").distinct()
    return meta.join(groups, "sample_id").select(F.col("group_id").alias("sample_id"), "attribute", "value").distinct()


def order(meta: DataFrame, keys: list[tuple[str, bool]], position: str = "_order", top: int | None = None, percent: float | None = None, within_leading: bool = False) -> DataFrame:
    """Numbers the samples by attributes, (name, ascending) each, and keeps the first top, or percent, of all samples.

    Values that are numbers are compared so, others as text after them; of many values the least counts for an ascending
    key and the largest for a descending. Samples without a key come first ascending, last descending; ties go by
    id. With within_leading the numbering restarts for each combination of all keys but the last.
    """
    picks = []
    for k, (name, ascending) in enumerate(keys):
        pick = F.min if ascending else F.max
        value = F.when(named(name), F.struct(as_number(F.col("value")).isNull().alias("t"), as_number(F.col("value")).alias("n"), F.col("value").alias("s")))
        picks.append(pick(value).alias(f"_k{k}"))
    wide = meta.groupBy("sample_id").agg(*picks)
    sorts = [F.col(f"_k{k}").asc_nulls_first() if ascending else F.col(f"_k{k}").desc_nulls_last() for k, (_, ascending) in enumerate(keys)]
    lead = [f"_k{k}" for k in range(len(keys) - 1)] if within_leading else []
    rest = sorts[len(lead) :]
    whole = Window.partitionBy(*lead)  # one row for each sample
    ranked = wide.withColumn("_n", F.row_number().over(whole.orderBy(*rest, F.col("sample_id")))).withColumn("_all", F.count("*").over(whole))
    if top is not None:
        ranked = ranked.where(F.col("_n") <= top)
    if percent is not None:
        ranked = ranked.where(F.col("_n") <= F.floor(F.col("_all") * percent / 100))
    numbered = ranked.select("sample_id", F.lit(position).alias("attribute"), F.col("_n").cast("string").alias("value"))
    out = restricted(meta, ranked).unionByName(numbered)
    if within_leading and lead:
        ids = ranked.withColumn("_g", F.dense_rank().over(Window.orderBy(*sorts[: len(lead)])))
        out = out.unionByName(ids.select("sample_id", F.lit(f"{keys[-1][0]}_groupId").alias("attribute"), F.col("_g").cast("string").alias("value")))
    return out
