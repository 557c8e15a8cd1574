"""Sample ids as expressions: the first eight bytes of an MD5, read in little-endian order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _reversed(hex16: Column) -> Column:
    return F.concat(*(F.substring(hex16, i, 2) for i in range(15, 0, -2)))


def _id_of(data: Column) -> Column:
    return F.conv(_reversed(F.substring(F.md5(data), 1, 16)), 16, -10).cast("long")


def _bytes_of(number: Column) -> Column:
    return F.unhex(_reversed(F.lpad(F.hex(number), 16, "0")))


def file_id(name: Column) -> Column:
    """A source sample's id, from its file name without .meta."""
    return _id_of(F.regexp_replace(name, r"\.meta$", "").cast("binary"))


def pair_id(a: Column, b: Column) -> Column:
    """The id of what two samples make together."""
    return _id_of(F.concat(_bytes_of(a.cast("long")), _bytes_of(b.cast("long"))))


def single_id(a: Column) -> Column:
    return _id_of(_bytes_of(a.cast("long")))
