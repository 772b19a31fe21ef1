"""Products. On cells a product is an equi-join on the inner index and a sum; on tiles the pairs are multiplied in NumPy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.matrix import TILES

INNER_SPAN = 16
#: Products over at most so many inner indices are made row by row; rows that are broadcast; products of a task.
MOST_WIDE = 16
MOST_BROADCAST = 1 << 18
TASK_PRODUCTS = 1 << 21
MOST_TASKS = 10_000
#: Rows of the right side in a block, on average: few enough that their ids are one byte each in a Parquet dictionary.
BLOCK_ROWS = 192


def inner_indices(cells: DataFrame, k: str) -> list | None:
    """The inner indices of a factor, if they are few."""
    found = [r[0] for r in cells.select(k).where(F.col(k).isNotNull()).distinct().limit(MOST_WIDE + 1).collect()]
    return found if len(found) <= MOST_WIDE else None


def wide_rows(cells: DataFrame, i: str, k: str, v: str, name: str, inner: list, *more) -> DataFrame:
    """A row for each ``i``: its cells at the inner indices as columns, which of them it has as bits, ``more`` aggregates."""
    columns = [F.sum(F.when(F.col(k) == c, F.col(v))).alias(f"{name}_{n}") for n, c in enumerate(inner)]
    bits = [F.when(F.col(k) == c, F.lit(1 << n)) for n, c in enumerate(inner)]
    held = F.coalesce(F.bit_or(F.coalesce(*bits)), F.lit(0)) if inner else F.first(F.lit(0))
    return cut_lineage(cells.groupBy(F.col(i).alias(name)).agg(*columns, held.alias(f"{name}_held"), *more))


def common(x: str, y: str) -> Column:
    """Whether two wide rows have an inner index in common."""
    return F.col(f"{x}_held").bitwiseAND(F.col(f"{y}_held")) != 0


def inner_product(x: str, y: str, inner: list, kind) -> Column:
    """Null where no product is known, as a sum of none."""
    parts = [(F.col(f"{x}_{n}") * F.col(f"{y}_{n}")).cast(kind) for n in range(len(inner))]
    if not parts:
        return F.lit(None).cast(kind)
    total = F.coalesce(parts[0], F.lit(0).cast(kind))
    for p in parts[1:]:
        total = total + F.coalesce(p, F.lit(0).cast(kind))
    return F.when(F.coalesce(*parts).isNotNull(), total.cast(kind))


def dealt(df: DataFrame, products: int, *by: str) -> DataFrame:
    """In as many partitions as the products to be made of its rows ask for."""
    return df.repartition(min(MOST_TASKS, max(1, -(-products // TASK_PRODUCTS))), *by)


def all_pairs(left: DataFrame, right: DataFrame, by: str, other: str, on=None, compact: bool = False) -> DataFrame:
    """Every row of ``left`` beside every row of ``right``, without a shuffle of the pairs. Too many rows to broadcast meet in blocks.

    With ``compact``, where both sides can be broadcast, a task makes the pairs of one block of each, a left row beside the same
    short run of right ones again and again: of the many pairs that are then written, both ids take up next to no room.
    """
    m, n = left.count(), right.count()
    if compact and 0 < m <= MOST_BROADCAST and 0 < n <= MOST_BROADCAST:
        down, across = max(1, -(-m * BLOCK_ROWS // TASK_PRODUCTS)), max(1, -(-n // BLOCK_ROWS))
        cut = lambda df, key, blocks, name: F.broadcast(df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")))
        grid = left.sparkSession.range(0, down * across, 1, min(MOST_TASKS, down * across)).select(F.expr(f"id div {down}").alias("right_block"), F.expr(f"id % {down}").alias("left_block"))
        met = grid.join(cut(left, by, down, "left_block"), "left_block").join(cut(right, other, across, "right_block"), "right_block").drop("left_block", "right_block")
        return met if on is None else met.where(on)
    if n <= MOST_BROADCAST:
        return dealt(left, m * n, by).join(F.broadcast(right), F.lit(True) if on is None else on)
    blocks = -(-n // MOST_BROADCAST) * 16
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.pmod(F.xxhash64(by), F.lit(64)).cast("int"))
    right = right.withColumn("block", F.pmod(F.xxhash64(other), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(63))))
    met = left.join(right, ["block", "part"]).drop("block", "part")
    return met if on is None else met.where(on)


def gemm(x: DataFrame, y: DataFrame, transpose_x: bool = False, transpose_y: bool = False) -> DataFrame:
    """Cells of the product. Over few inner indices whole rows meet and no product is shuffled. Else sums are combined before
    the second shuffle, and Catalyst picks the join by the measured sizes."""
    i, k = ("j", "i") if transpose_x else ("i", "j")
    k2, j = ("j", "i") if transpose_y else ("i", "j")
    left = x.select(F.col(i).alias("i"), F.col(k).alias("k"), F.col("v").alias("x"))
    right = y.select(F.col(k2).alias("k"), F.col(j).alias("j"), F.col("v").alias("y"))
    added = left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    inner = inner_indices(right, "k")
    if inner is None:
        return added
    met = all_pairs(wide_rows(left, "i", "k", "x", "i", inner), wide_rows(right, "j", "k", "y", "j", inner), "i", "j", common("i", "j"), compact=True)
    return met.select("i", "j", inner_product("i", "j", inner, added.schema["v"].dataType).alias("v"))


def gram(x: DataFrame) -> DataFrame:
    """XᵀX of tall cells: half of the pairs by ``i <= j``, then mirrored."""
    upper = gram_upper(x)
    return upper.unionByName(upper.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def gram_upper(x: DataFrame) -> DataFrame:
    left = x.select(F.col("i").alias("r"), F.col("j").alias("i"), F.col("v").alias("x"))
    right = x.select(F.col("i").alias("r"), F.col("j"), F.col("v").alias("y"))
    met = left.join(right, "r").where(F.col("i") <= F.col("j"))
    return met.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def gram_rows(rows: DataFrame, vector: str, width: int) -> DataFrame:
    """XᵀX of rows that hold whole vectors, without a join: each batch adds its own product, one small matrix a partition."""

    def local(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for f in frames:
            x = np.stack(f[vector].to_list()).astype(float) if len(f) else np.zeros((0, width))
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.reshape(-1), "j": j.reshape(-1), "v": total.reshape(-1)})

    parts = rows.select(vector).mapInPandas(local, "i long, j long, v double")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def gemv(x: DataFrame, vector: DataFrame) -> DataFrame:
    """X times ``(i, v)``."""
    y = vector.select(F.col("i").alias("j"), F.col("v").alias("y"))
    return x.join(y, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("y")).alias("v"))


def syrk_lower(x: DataFrame) -> DataFrame:
    """The lower half of X Xᵀ."""
    left = x.select(F.col("i"), F.col("j").alias("k"), F.col("v").alias("x"))
    right = x.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("y"))
    added = left.join(right, "k").where(F.col("j") <= F.col("i")).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    inner = inner_indices(right, "k")
    if inner is None:
        return added
    rows = wide_rows(left, "i", "k", "x", "i", inner)
    met = all_pairs(rows, rows.select(*[F.col(c).alias("j" + c[1:]) for c in rows.columns]), "i", "j", common("i", "j") & (F.col("j") <= F.col("i")))
    return met.select("i", "j", inner_product("i", "j", inner, added.schema["v"].dataType).alias("v"))


def gemm_missing(x: DataFrame, y: DataFrame, done: DataFrame, tile: tuple[int, int]) -> DataFrame:
    """Only the product's cells in blocks that ``done`` lacks: rows of ``x`` meet the columns of missing blocks alone."""
    a, b = tile
    block = lambda i, j: (F.expr(f"{i} div {a}").alias("bi"), F.expr(f"{j} div {b}").alias("bj"))
    there = done.select(*block("i", "j")).distinct()
    left = x.select("i", F.col("j").alias("k"), F.col("v").alias("x"), block("i", "j")[0])
    right = y.select(F.col("i").alias("k"), "j", F.col("v").alias("y"), block("i", "j")[1])
    last = right.agg(F.max("bj")).first()[0]
    if last is None:
        return left.join(right, "k").select("i", "j", F.col("x").alias("v")).where("false")
    grid = left.select("bi").distinct().withColumn("bj", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    missing = grid.join(there, ["bi", "bj"], "left_anti")
    pairs = left.join(missing, "bi").join(right, ["k", "bj"])
    inner = inner_indices(right, "k")
    if inner is not None:
        kind = pairs.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v")).schema["v"].dataType
        rows = wide_rows(left, "i", "k", "x", "i", inner, F.first("bi").alias("bi"))
        cols = wide_rows(right, "j", "k", "y", "j", inner, F.first("bj").alias("bj"))
        m, n = rows.count(), cols.count()
        small = lambda df, size: F.broadcast(df) if size <= MOST_BROADCAST else df
        met = dealt(missing, m * n, "bi", "bj").join(small(rows, m), "bi").join(small(cols, n), "bj").where(common("i", "j"))
        return met.select("i", "j", inner_product("i", "j", inner, kind).alias("v"))
    return pairs.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def gemm_tiles(x: DataFrame, y: DataFrame, inner_span: int = INNER_SPAN) -> DataFrame:
    """Tiles of the product. Pairs of at most ``inner_span`` inner blocks are added in one task, then those sums."""

    def multiply(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for r in frame.itertuples():
            part = np.asarray(r.x).reshape(r.m, r.k) @ np.asarray(r.y).reshape(r.k, r.n)
            total = part if total is None else total + part
        return _tile(key, total)

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.asarray(d) for d in frame["data"])
        return _tile(key, total.reshape(int(frame["nrows"].iloc[0]), int(frame["ncols"].iloc[0])))

    left = x.select("bi", F.col("bj").alias("bk"), F.col("nrows").alias("m"), F.col("ncols").alias("k"), F.col("data").alias("x"))
    right = y.select(F.col("bi").alias("bk"), "bj", F.col("ncols").alias("n"), F.col("data").alias("y"))
    pairs = left.join(right, "bk").withColumn("span", F.expr(f"bk div {inner_span}"))
    parts = pairs.groupBy("bi", "bj", "span").applyInPandas(multiply, TILES)
    return parts.groupBy("bi", "bj").applyInPandas(add, TILES)


def _tile(key: tuple, a: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"bi": [int(key[0])], "bj": [int(key[1])], "nrows": [a.shape[0]], "ncols": [a.shape[1]], "data": [a.reshape(-1)]})


def chain_order(shapes: list[tuple[int, int]]) -> tuple | int:
    """The cheapest bracketing of a product, as nested pairs of places, by the classic dynamic programme."""
    dims = [shapes[0][0], *[n for _, n in shapes]]

    @lru_cache(None)
    def best(lo: int, hi: int) -> tuple[int, object]:
        if lo == hi:
            return 0, lo
        return min(((best(lo, k)[0] + best(k + 1, hi)[0] + dims[lo] * dims[k + 1] * dims[hi + 1], (best(lo, k)[1], best(k + 1, hi)[1])) for k in range(lo, hi)), key=lambda x: x[0])

    return best(0, len(shapes) - 1)[1]


def matrix_chain(xs: list[DataFrame], shapes: list[tuple[int, int]]) -> DataFrame:
    def product(order) -> DataFrame:
        return xs[order] if isinstance(order, int) else gemm(product(order[0]), product(order[1]))

    return product(chain_order(shapes))
