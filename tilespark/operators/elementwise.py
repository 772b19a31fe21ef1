"""Elementwise operators on cells. Absent is zero: products are inner joins, sums full joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "neg": lambda v: -v, "square": lambda v: v * v, "sqrt": F.sqrt, "sin": F.sin,
    "cos": F.cos, "tan": F.tan, "exp": F.exp, "sign": F.signum,
}


def unary(cells: DataFrame, f: str | Callable[[Column], Column]) -> DataFrame:
    """``f`` of each stored cell. For functions that don't keep zero, fill the grid first (``with_parent``)."""
    return cells.select("i", "j", (UNARY[f] if isinstance(f, str) else f)(F.col("v")).alias("v"))


def power(cells: DataFrame, k: float) -> DataFrame:
    return unary(cells, lambda v: F.pow(v, F.lit(k)))


def scale(cells: DataFrame, k: Column) -> DataFrame:
    return unary(cells, lambda v: v * k)


def _met(x: DataFrame, y: DataFrame, how: str) -> DataFrame:
    return x.withColumnRenamed("v", "x").join(y.withColumnRenamed("v", "y"), ["i", "j"], how)


def binary(x: DataFrame, y: DataFrame, f: Callable[[Column, Column], Column], how: str = "full") -> DataFrame:
    """``f`` of both cells over the cells of either (``full``) or of both (``inner``)."""
    return _met(x, y, how).select("i", "j", f(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))).alias("v"))


def add(x: DataFrame, y: DataFrame) -> DataFrame:
    return binary(x, y, lambda a, b: a + b)


def sub(x: DataFrame, y: DataFrame) -> DataFrame:
    return binary(x, y, lambda a, b: a - b)


def mul(x: DataFrame, y: DataFrame) -> DataFrame:
    return binary(x, y, lambda a, b: a * b, "inner")


def div(x: DataFrame, y: DataFrame) -> DataFrame:
    """Over cells that both have; division by a stored zero gives null."""
    return binary(x, y, lambda a, b: a / F.when(b != 0, b), "inner")


def logical_and(x: DataFrame, y: DataFrame) -> DataFrame:
    return binary(x, y, lambda a, b: (a != 0) & (b != 0), "inner")


def logical_or(x: DataFrame, y: DataFrame) -> DataFrame:
    return binary(x, y, lambda a, b: (a != 0) | (b != 0))


def logical_xor(x: DataFrame, y: DataFrame) -> DataFrame:
    return binary(x, y, lambda a, b: (a != 0) != (b != 0))


def add_matrices(*xs: DataFrame) -> DataFrame:
    """The sum of any number of matrices: a union and one aggregate, combined before the shuffle."""
    every = xs[0]
    for x in xs[1:]:
        every = every.unionByName(x)
    return every.groupBy("i", "j").agg(F.sum("v").alias("v"))
