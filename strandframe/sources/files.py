"""Datasets in files: one region file and one .meta file for each sample, read and written by Spark alone."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..functions import ids
from ..functions.shared import scratch as scratch
from ..operators import metadata
from ..operators.regions import Scope
from . import meta_index
from .schema import ALIASES, PRESETS, RegionSchema, from_xml, read_schema, to_xml

#: What reads lines (sample_id, value) into regions: a preset's name, a schema, or a function of one's own.
Parser = str | RegionSchema | Callable[[DataFrame], DataFrame]


def _typed(text: Column, kind: str) -> Column:
    if kind == "double":
        return F.when(F.lower(F.trim(text)).isin("null", "."), None).otherwise(text.try_cast("double"))
    return F.lit(None).cast("string") if kind == "void" else F.trim(text)


def _cell(i: int) -> Column:
    return F.try_element_at(F.split("value", "\t", -1), F.lit(i + 1))


def _start(schema: RegionSchema) -> Column:
    return _cell(schema.start).try_cast("long") - (1 if schema.one_based else 0)


def _readable(schema: RegionSchema) -> Column:
    """Whether a line has all columns, and numbers where they should be."""
    good = _cell(schema.chrom).isNotNull() & (F.trim(_cell(schema.chrom)) != "") & _start(schema).isNotNull() & _cell(schema.stop).try_cast("long").isNotNull()
    for _, i, kind in schema.values:
        good = good & _cell(i).isNotNull()
        if kind == "double":
            good = good & (F.lower(F.trim(_cell(i))).isin("null", ".") | _cell(i).try_cast("double").isNotNull())
    return F.coalesce(good, F.lit(False))


def _content(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))


def parsed(lines: DataFrame, schema: RegionSchema, strict: bool = False) -> DataFrame:
    """Regions from (sample_id, value) lines. # lines are skipped; lines that can't be read are dropped (bad_lines has them), or with strict fail the query."""
    strand = F.lit("*") if schema.strand is None else F.when(F.trim(_cell(schema.strand)).isin("+", "-"), F.trim(_cell(schema.strand))).otherwise("*")
    values = [_typed(_cell(i), t).alias(n) for n, i, t in schema.values]
    for name, t in schema.attributes:  # k "v"; pairs, names in any case
        value = F.regexp_extract(_cell(8), rf'(?i)(?:^|;)\s*{re.escape(name)}\s+"?([^";]*)"?', 1)
        values.append(F.when(value == "", None).otherwise(_typed(value, t)).alias(name))
    good = _readable(schema)
    rows = _content(lines)
    rows = rows.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("unreadable line: "), "value")))) if strict else rows.where(good)
    return rows.select("sample_id", F.trim(_cell(schema.chrom)).alias("chrom"), _start(schema).alias("start"), _cell(schema.stop).try_cast("long").alias("stop"), strand.alias("strand"), *values)


def unknown_attributes(lines: DataFrame, schema: RegionSchema) -> DataFrame:
    """(attribute, lines): names in the last column of GTF lines that the schema doesn't have."""
    names = F.regexp_extract_all(F.concat(F.lit(";"), _cell(8)), F.lit(r';\s*([^\s";]+)\s'), F.lit(1))
    known = [n.lower() for n, _ in schema.attributes]
    found = _content(lines).select(F.explode(F.array_distinct(names)).alias("attribute"))
    return found.where(~F.lower("attribute").isin(known)).groupBy("attribute").agg(F.count("*").alias("lines"))


def _lines(spark: SparkSession, paths: str | list[str], glob: str, recursive: bool) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    named = reader.text(paths).select(F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_path").alias("_path"), "value")
    return named.withColumn("sample_id", ids.file_id(F.col("_file")))


def _region_lines(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """Lines of all files that aren't metadata or a schema; Spark prunes the others by their names."""
    name = F.col("_file")
    return _lines(spark, paths, "*", recursive).where(~name.endswith(".meta") & ~name.endswith(".xml") & ~name.endswith(".schema"))


def _schema_of(spark: SparkSession, folder: str, parser: Parser | None) -> RegionSchema | Callable[[DataFrame], DataFrame]:
    if isinstance(parser, str):
        name = ALIASES.get(parser.lower(), parser.lower())
        if name not in PRESETS and name != "custom":
            warnings.warn(f"unknown parser {parser!r}: the folder's own schema is used; there are {', '.join(PRESETS)}", stacklevel=3)
        parser = PRESETS.get(name)
    return parser or read_schema(spark, folder)


def read(spark: SparkSession, folder: str, parser: Parser | None = None, strict: bool = False, with_meta_only: bool = True, recursive: bool = False, where: metadata.Predicate | None = None) -> Dataset:
    """A dataset from a folder. parser: a preset's name, a schema, a function from lines to regions, or None for the folder's own XML.

    Without with_meta_only, region files need no .meta beside them. Small files are combined by Spark's file splits. With
    where, the metadata are read first, and only the region files of the samples that satisfy it are opened.
    """
    schema = _schema_of(spark, folder, parser)
    meta_lines = _lines(spark, folder, "*.meta", recursive)
    pair = F.split("value", "\t", -1)
    meta = meta_lines.where(~F.col("value").startswith("#"))
    if strict:
        meta = meta.where(F.when((F.size(pair) == 2) | (F.trim("value") == ""), True).otherwise(F.raise_error(F.concat(F.lit("unreadable metadata: "), "value"))))
    meta = meta.where(F.size(pair) == 2).select("sample_id", pair[0].alias("attribute"), pair[1].alias("value"))
    if where is not None:
        chosen = metadata.samples_where(meta, where)
        meta = metadata.restricted(meta, chosen)
        files = metadata.restricted(meta_lines.select("sample_id", "_path").distinct(), chosen).collect()  # one name for each sample
        data = _region_lines(spark, [unquote(r["_path"]).removesuffix(".meta") for r in files]) if files else meta_lines.limit(0)
    else:
        data = _region_lines(spark, folder, recursive)
        if with_meta_only:
            listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.meta").option("recursiveFileLookup", str(recursive).lower()).load(folder)  # names alone
            data = data.join(listed.select(ids.file_id(F.element_at(F.split("path", "/"), -1)).alias("sample_id")).distinct(), "sample_id", "left_semi")
    data = data.select("sample_id", "value")
    return Dataset(parsed(data, schema, strict) if isinstance(schema, RegionSchema) else schema(data), meta)


def bad_lines(spark: SparkSession, folder: str, parser: str | RegionSchema | None = None, recursive: bool = False) -> DataFrame:
    """(file, value): the lines that read drops."""
    schema = _schema_of(spark, folder, parser)
    return _content(_region_lines(spark, folder, recursive)).where(~_readable(schema)).select(F.col("_file").alias("file"), "value")


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def tab_lines(ds: Dataset) -> DataFrame:
    cells = [F.col("chrom"), F.col("start").cast("string"), F.col("stop").cast("string"), F.col("strand"), *(_text(F.col(v)) for v in ds.values)]
    return ds.regions.select("sample_id", F.concat_ws("\t", *cells).alias("value"))


def gtf_lines(ds: Dataset, one_based: bool = True) -> DataFrame:
    """GTF: missing source, feature and frame as a dot, a missing score as 0.0, the other values as attributes."""
    fixed = {v.lower(): v for v in ds.values}
    own = lambda n, missing: F.coalesce(F.col(fixed[n]).cast("string"), F.lit(missing)) if n in fixed else F.lit(missing)
    rest = [v for v in ds.values if v.lower() not in ("source", "feature", "score", "frame")]
    attributes = F.concat_ws(" ", *(F.concat(F.lit(f'{v} "'), _text(F.col(v)), F.lit('";')) for v in rest)) if rest else F.lit("")
    strand = F.when(F.col("strand") == "*", ".").otherwise(F.col("strand"))
    cells = [F.col("chrom"), own("source", "."), own("feature", "."), (F.col("start") + int(one_based)).cast("string"), F.col("stop").cast("string"), own("score", "0.0"), strand, own("frame", "."), attributes]
    return ds.regions.select("sample_id", F.concat_ws("\t", *cells).alias("value"))


def _one_file_a_sample(lines: DataFrame, folder: str) -> None:
    """Text below folder/sample_id=..., each sample by one task, since the format has one file for each."""
    lines.repartition("sample_id").write.partitionBy("sample_id").text(folder)


def write(ds: Dataset, folder: str, kind: str = "parquet", index: bool = False) -> None:
    """Writes the dataset; read_written reads it again.

    parquet: regions partitioned by sample and sorted by place, so that a selection of samples prunes folders, and one of places
    files and row groups by their statistics; ranges of places, not samples, are tasks, so a large sample is several files. tab, gtf: the
    exchange format, folder/files with S_00000.gdm (or .gtf) and its .meta for each sample, in the order of their ids, and
    schema.xml. Spark writes the files, and the driver then only names them: one rename a sample. index: an index of the metadata too (Parquet only).
    """
    if index and kind != "parquet":
        raise ValueError("only the Parquet layout has an index")
    spark = ds.regions.sparkSession
    if kind == "parquet":
        line = ["sample_id", "chrom", "start"]
        ds.regions.repartitionByRange(*line).sortWithinPartitions(*line).write.partitionBy("sample_id").parquet(f"{folder}/regions")
        ds.meta.write.parquet(f"{folder}/meta")
        if index:
            meta_index.build(ds.meta, f"{folder}/meta_index")
        return
    lines, ending = {"tab": (tab_lines, "gdm"), "gtf": (gtf_lines, "gtf")}[kind]
    _one_file_a_sample(lines(ds), f"{folder}/_regions")
    _one_file_a_sample(ds.meta.select("sample_id", F.concat_ws("\t", "attribute", "value").alias("value")), f"{folder}/_meta")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, dict[str, object]] = {}
    for part in ("_regions", "_meta"):
        for p in fs.globStatus(path(f"{folder}/{part}/sample_id=*/part-*")) or []:
            found.setdefault(int(p.getPath().getParent().getName().partition("=")[2]), {})[part] = p.getPath()
    fs.mkdirs(path(f"{folder}/files"))
    for n, sample in enumerate(sorted(found)):
        for part, name in (("_regions", f"S_{n:05d}.{ending}"), ("_meta", f"S_{n:05d}.{ending}.meta")):
            to = path(f"{folder}/files/{name}")
            if part in found[sample]:
                fs.rename(found[sample][part], to)
            else:  # a sample without regions or without metadata
                fs.create(to).close()
    for part in ("_regions", "_meta"):
        fs.delete(path(f"{folder}/{part}"), True)
    types = dict(ds.regions.dtypes)
    out = fs.create(path(f"{folder}/files/schema.xml"))
    out.write(to_xml([(v, types[v]) for v in ds.values], kind=kind).encode())
    out.close()


def read_written(spark: SparkSession, folder: str, kind: str = "parquet", where: metadata.Predicate | None = None, region: Callable[[Scope], Column] | None = None, index: bool = False) -> Dataset:
    """What write made. From text, samples have the ids of their file names.

    where selects samples, region their regions. Of Parquet, Spark then opens the folders of these samples alone (their ids prune the
    scan while the query runs; no path passes through the driver), and skips row groups outside the predicate's places. With index, where reads ranges of the index
    that write made, instead of all metadata.
    """
    if kind == "parquet":
        ds = Dataset(spark.read.parquet(f"{folder}/regions"), spark.read.parquet(f"{folder}/meta"))
        if index and where is not None:
            found = meta_index.samples_where(spark, f"{folder}/meta_index", where)
            ds, where = Dataset(metadata.restricted(ds.regions, found), metadata.restricted(ds.meta, found)), None
        return ds.select(meta=where, region=region) if where is not None or region is not None else ds
    ds = read(spark, f"{folder}/files", where=where)
    return ds.select(region=region) if region is not None else ds


def write_matrix(matrix: DataFrame, folder: str, column: str = "cells") -> None:
    """Text: the sample, the coordinates and the comma-joined values of each cell."""
    from ..operators.matrix import to_rows

    rows = to_rows(matrix, column)
    values = [_text(F.col(c)) for c in rows.columns[5:]]
    rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in rows.columns[:5]), F.concat_ws(", ", *values)).alias("value")).write.text(folder)
