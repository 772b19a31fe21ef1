"""Reductions by row, column or over all; absent cells count as zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _grouped(cells: DataFrame, axis: str | None):
    return cells.groupBy(F.col(axis)) if axis else cells.groupBy()


def _with_zero(best: Column, n: int, f) -> Column:
    """An aggregate of the stored cells, and of zero where some are absent."""
    return F.when(F.count(F.lit(1)) < n, f(best, F.lit(0))).otherwise(best)


def reduce(cells: DataFrame, op: str, axis: str | None, size: int) -> DataFrame:
    """``op`` in sum, min, max, prod, norm. ``axis``: the index that stays ("i", "j" or None); ``size``: cells to each result."""
    v = F.col("v")
    made = {
        "sum": F.sum(v),
        "norm": F.sqrt(F.sum(v.cast("double") * v)),
        "min": _with_zero(F.min(v), size, F.least),
        "max": _with_zero(F.max(v), size, F.greatest),
        "prod": F.when(F.count(F.lit(1)) < size, F.lit(0.0)).otherwise(F.product(v)),
    }[op]
    return _grouped(cells, axis).agg(made.alias("v"))


def arg_extreme(cells: DataFrame, axis: str, size: int, largest: bool = False) -> DataFrame:
    """Per ``axis`` index the place along the other of the least (or largest) value, and the value; ties go to the first.

    Absent cells are zeros: where one wins, the place is the first absent one, which the stored places tell.
    """
    other = "i" if axis == "j" else "j"
    rank = F.struct((-F.col("v") if largest else F.col("v")).alias("k"), F.col(other).alias("at"))
    found = cells.groupBy(axis).agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    found = found.select(axis, F.col("best.at").alias("at"), (-F.col("best.k") if largest else F.col("best.k")).alias("v"), "n")
    holes = found.where((F.col("n") < size) & ((F.col("v") <= 0) if largest else (F.col("v") >= 0))).select(axis)
    # Only lines where a zero may win are looked at again: the first absent place ends the run of places that equal their rank.
    lines = cells.join(holes, axis, "left_semi")
    w = Window.partitionBy(axis).orderBy(other)
    gap = lines.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") == F.col(other)).groupBy(axis).agg(F.max(other).alias("run"))
    zero = holes.join(gap, axis, "left").select(axis, F.coalesce(F.col("run") + 1, F.lit(0)).alias("gap"))
    out = found.join(zero, axis, "left")
    wins = F.col("gap").isNotNull() & ((F.col("v") != 0) | (F.col("gap") < F.col("at")))
    return out.select(axis, F.when(wins, F.col("gap")).otherwise(F.col("at")).alias("at"), F.when(wins, F.lit(0).cast("double")).otherwise(F.col("v").cast("double")).alias("v"))
