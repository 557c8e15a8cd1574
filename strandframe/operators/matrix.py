"""The coordinate-grouped representation: one row for each coordinate, the samples' values in arrays.

With many samples on the same coordinates, MAP and JOIN match each coordinate once. Operands stay in columns of their
own, so cross products are made only when rows are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import intervals as I
from .genometric import BIN, HORIZON, Condition, DistLess, interval_pairs, matches


def to_matrix(regions: DataFrame, column: str = "cells") -> DataFrame:
    """(coordinates, cells): cells is an array of (sample_id, vals)."""
    values = [c for c in regions.columns if c not in ("sample_id", *I.COORDS)]
    vals = F.struct(*values) if values else F.lit(None).cast("string")
    return regions.groupBy(*I.COORDS).agg(F.array_sort(F.collect_list(F.struct("sample_id", vals.alias("vals")))).alias(column))


def to_rows(matrix: DataFrame, column: str = "cells") -> DataFrame:
    cells = matrix.select(*I.COORDS, F.inline(column))
    named = cells.schema["vals"].dataType.typeName() == "struct"
    return cells.select("sample_id", *I.COORDS, *(["vals.*"] if named else []))


def matrix_map(ref: DataFrame, exp: DataFrame, column: str = "counts", bin_size: int | str = BIN, zeros: bool = True) -> DataFrame:
    """The ref matrix with a further operand: (sample_id, count) of the exp samples, by id, that have regions over the coordinate.

    With zeros every sample of the data has a cell; without, the samples that hit the coordinate alone, so that a row grows with its
    hits and not with the number of samples. with_zeros makes the one from the other.
    """
    tagged = ref.select(*I.COORDS)
    flat = exp.select(*I.COORDS, F.explode(F.col("cells.sample_id")).alias("sample_id")).groupBy("sample_id", *I.COORDS).agg(F.count("*").alias("n"))
    overlap = I.overlaps(F.col("start"), F.col("stop"), F.col("e_start"), F.col("e_stop"))
    hits = interval_pairs(tagged, flat, 0, overlap, bin_size=bin_size).groupBy(*I.COORDS, "exp_id").agg(F.sum("e_n").alias("n"))
    cell = F.struct(F.col("exp_id").alias("sample_id"), F.col("n").alias("count"))
    counted = hits.groupBy(*I.COORDS).agg(F.array_sort(F.collect_list(cell)).alias("_hits"))
    sparse = ref.join(counted, I.COORDS, "left").select(*ref.columns, F.coalesce("_hits", F.array()).alias(column))
    return with_zeros(sparse, exp.select(F.explode("cells.sample_id").alias("sample_id")), column) if zeros else sparse


def with_zeros(matrix: DataFrame, samples: DataFrame, column: str = "counts") -> DataFrame:
    """A count of 0 for each of the samples (a column sample_id) that a coordinate's cells lack; the samples are one array."""
    ids = samples.agg(F.array_sort(F.collect_set("sample_id")).alias("_ids"))
    lacking = F.transform(F.array_except("_ids", F.col(column)["sample_id"]), lambda i: F.struct(i.alias("sample_id"), F.lit(0).cast("long").alias("count")))
    filled = F.array_sort(F.concat(F.col(column), lacking)).alias(column)
    return matrix.crossJoin(F.broadcast(ids)).select(*(filled if c == column else F.col(c) for c in matrix.columns))


def sample_totals(matrix: DataFrame, column: str = "counts") -> DataFrame:
    """(sample_id, coordinates, hits): the coordinates where each sample has a count above 0, and its counts' sum. Cells of 0 may be left out or not."""
    cells = matrix.select(F.inline(column)).where("count > 0")
    return cells.groupBy("sample_id").agg(F.count(F.lit(1)).alias("coordinates"), F.sum("count").alias("hits"))


def matrix_join(left: DataFrame, right: DataFrame, conditions: list[Condition] = (DistLess(0),), builder: str = "LEFT", column: str = "right_cells", bin_size: int | str = BIN, horizon: int = HORIZON) -> DataFrame:
    """Matched coordinates, by the builder LEFT, RIGHT or CONTIG, with each match's operands side by side: cells and right_cells.

    Conditions are those of the join of rows, between coordinates: MinDistance(k) takes the right matrix's k least distances, whichever
    samples have them, and without an upper bound coordinates up to horizon are looked for.
    """
    if not conditions:
        raise ValueError("a matrix join needs conditions")
    a = left.withColumn("sample_id", F.lit(0).cast("long"))
    b = right.select(*I.COORDS, F.col("cells").alias("cells"), F.lit(0).cast("long").alias("sample_id"))
    found = matches(a, b, list(conditions), bin_size=bin_size, horizon=horizon)
    match builder.upper():
        case "LEFT":
            coords = [F.col(c) for c in I.COORDS]
        case "RIGHT":
            coords = [F.col(f"e_{c}").alias(c) for c in I.COORDS]
        case "CONTIG":
            coords = [F.col("chrom"), F.least("start", "e_start").alias("start"), F.greatest("stop", "e_stop").alias("stop"), I.joint_strand(F.col("strand"), F.col("e_strand")).alias("strand")]
        case _:
            raise ValueError(f"unknown builder {builder!r}")
    return found.select(*coords, *(F.col(c) for c in left.columns if c not in I.COORDS), F.col("e_cells").alias(column))


def regrouped(joined: DataFrame, left: str = "cells", right: str = "right_cells") -> DataFrame:
    """A join's matches as a matrix again, one row for each coordinate of the builder, so that it can be mapped and joined further.

    Each combination of cells is one cell: its id is that of the pair, its values are the left ones and then the right
    ones, whose names get right_ before them where the left has them too.
    """
    vals = lambda c: [f.name for f in getattr(joined.schema[c].dataType.elementType["vals"].dataType, "fields", [])]
    lv, rv = vals(left), vals(right)

    def cell(a, b):
        values = [a["vals"][v].alias(v) for v in lv] + [b["vals"][v].alias(f"right_{v}" if v in lv else v) for v in rv]
        return F.struct(ids.pair_id(a["sample_id"], b["sample_id"]).alias("sample_id"), (F.struct(*values) if values else F.lit(None).cast("string")).alias("vals"))

    pairs = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: cell(a, b))))
    return joined.groupBy(*I.COORDS).agg(F.array_sort(F.flatten(F.collect_list(pairs))).alias("cells"))


def to_rows_multi(matrix: DataFrame, operands: list[str]) -> DataFrame:
    """Rows of a multi matrix under one id each: the operands' ids are paired from the left on; columns operand_value."""
    rows = crossed(matrix, operands)
    one = F.col(f"{operands[0]}_sample_id")
    for o in operands[1:]:
        one = ids.pair_id(one, F.col(f"{o}_sample_id"))
    return rows.select(one.alias("sample_id"), *I.COORDS, *(f"{o}_value" for o in operands))


def crossed(matrix: DataFrame, operands: list[str]) -> DataFrame:
    """Rows of a multi matrix: one for each combination of the operands' cells, with columns operand_sample_id and operand_vals."""
    out = matrix
    for o in operands:
        out = out.withColumn("_c", F.explode(o)).withColumns({f"{o}_sample_id": F.col("_c.sample_id"), f"{o}_value": F.col("_c").dropFields("sample_id")}).drop("_c", o)
    return out
