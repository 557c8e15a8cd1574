"""Schemas of delimited datasets: XML with one field element for each column, and presets by name."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: Names that mark a coordinate column, and types by their schema names.
SYNONYMS = {"chrom": {"CHROM", "CHROMOSOME", "CHR"}, "start": {"START", "LEFT"}, "stop": {"STOP", "RIGHT", "END"}, "strand": {"STRAND", "STR"}}
#: The elements and attributes of a schema file, and further names of the presets; custom is the folder's own schema.
COLLECTION, SCHEMA, FIELD, COORDINATES = "gmqlSchemaCollection", "gmqlSchema", "field", "coordinate_system"
ALIASES = {
    "bedscoreparser": "bedscore", "annparser": "annotation", "broadpeaksparser": "broadpeaks", "narrowpeakparser": "narrowpeak", "narrow": "narrowpeak", "bedtabseparatedparser": "bed",
    "rnaseqparser": "rnaseq", "broadprojparser": "broadprojection", "basicparser": "basic", "customparser": "custom", "default": "custom",
}
TYPES = {"STRING": "string", "CHAR": "string", "INTEGER": "double", "INT": "double", "LONG": "double", "DOUBLE": "double", "NULL": "void"}


@dataclass(frozen=True)
class RegionSchema:
    """Column numbers of the coordinates (strand may be None) and (name, number, type) of the values."""

    chrom: int
    start: int
    stop: int
    strand: int | None
    values: tuple[tuple[str, int, str], ...] = ()
    kind: str = "tab"
    one_based: bool = False
    attributes: tuple[tuple[str, str], ...] = field(default=())  # of a GTF file's last column


def _typed(name: str) -> str:
    try:
        return TYPES[name.upper()]
    except KeyError:
        raise ValueError(f"unknown type {name!r} in a schema") from None


def from_fields(fields: list[tuple[str, str]], kind: str = "tab", coordinates: str | None = None) -> RegionSchema:
    """A schema from (name, type) of all fields in file order."""
    kind = kind.lower()
    one_based = coordinates == "1-based" if coordinates and coordinates != "default" else kind in ("gtf", "vcf")
    if kind == "gtf":
        fixed = {"source": (1, "string"), "feature": (2, "string"), "score": (5, "double"), "frame": (7, "string")}
        listed = [(n, _typed(t)) for n, t in fields if n.upper() not in set().union(*SYNONYMS.values())]
        values = tuple((n, fixed[n.lower()][0], t) for n, t in listed if n.lower() in fixed)
        return RegionSchema(0, 3, 4, 6, values, kind, one_based, tuple((n, t) for n, t in listed if n.lower() not in fixed))
    place = {k: next((i for i, (n, _) in enumerate(fields) if n.upper() in s), None) for k, s in SYNONYMS.items()}
    rest = [(n, i, t) for i, (n, t) in enumerate(fields) if i not in place.values()]
    if kind == "vcf":  # the position is start and stop; values follow it
        first = 2 if all(v is None for v in place.values()) else 0
        return RegionSchema(0, 1, 1, None, tuple((n, i + first, _typed(t)) for n, i, t in rest), kind, one_based)
    if missing := [k for k in ("chrom", "start", "stop") if place[k] is None]:
        raise ValueError(f"the schema lacks {', '.join(missing)}")
    return RegionSchema(place["chrom"], place["start"], place["stop"], place["strand"], tuple((n, i, _typed(t)) for n, i, t in rest), kind, one_based)


def from_xml(text: str) -> RegionSchema:
    root = ET.fromstring(text)
    tag = lambda e: e.tag.rpartition("}")[2]
    top = root if tag(root) == SCHEMA else next((e for e in root.iter() if tag(e) == SCHEMA), root)
    fields = [((e.text or "").strip(), e.get("type", "STRING")) for e in top.iter() if tag(e) == FIELD]
    return from_fields(fields, top.get("type", "tab"), top.get(COORDINATES))


def to_xml(values: list[tuple[str, str]], name: str = "dataset", kind: str = "tab") -> str:
    """XML for a dataset with these values (name, Spark type) after its coordinates."""
    collection = ET.Element(COLLECTION, {"name": name})
    top = ET.SubElement(collection, SCHEMA, {"type": kind, COORDINATES: "1-based" if kind == "gtf" else "0-based"})
    names = {"string": "STRING", "double": "DOUBLE", "float": "DOUBLE", "int": "INTEGER", "bigint": "LONG", "void": "NULL"}
    for n, t in [("chr", "string"), ("left", "bigint"), ("right", "bigint"), ("strand", "string"), *values]:
        ET.SubElement(top, FIELD, {"type": names.get(t, "STRING")}).text = n
    return ET.tostring(collection, encoding="unicode")


def read_schema(spark: SparkSession, folder: str) -> RegionSchema:
    """The folder's schema.xml, or else its test.schema."""
    files = spark.read.option("pathGlobFilter", "{schema.xml,test.schema}").text(folder, wholetext=True)
    rows = files.selectExpr("_metadata.file_name AS name", "value").collect()  # two small files at most
    if not rows:
        raise ValueError(f"no schema.xml or test.schema in {folder}")
    return from_xml(min(rows, key=lambda r: r["name"])["value"])


def _values(**columns: int) -> tuple[tuple[str, int, str], ...]:
    return tuple((n, i, "string" if n in ("name", "thick_start", "thick_stop", "rgb") else "double") for n, i in columns.items())


#: Presets by lower-case name.
PRESETS = {
    "bed": RegionSchema(0, 1, 2, 5, _values(name=3, score=4, thick_start=6, thick_stop=7, rgb=8, blocks=9)),
    "annotation": RegionSchema(0, 1, 2, 5, _values(name=3, score=4)),
    "broadprojection": RegionSchema(0, 1, 2, None, _values(name=3)),
    "basic": RegionSchema(0, 1, 2, None),
    "broadpeaks": RegionSchema(0, 1, 2, 5, _values(name=3, score=4, signal=6, pvalue=7, qvalue=8)),
    "narrowpeak": RegionSchema(0, 1, 2, 5, _values(name=3, score=4, signal_value=6, p_value=7, q_value=8, peak=9)),
    "rnaseq": RegionSchema(0, 1, 2, 3, _values(name=4, score=5)),
    "bedscore": RegionSchema(0, 1, 2, None, _values(score=3)),
}
