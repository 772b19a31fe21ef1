"""Views: block access, strided block sub-matrices, transpose, permutation, overlay, ridge. All are lazy and need no shuffle but for joins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.matrix import Meta


def _block(axis: str, size: int) -> Column:
    return F.expr(f"{axis} div {size}")


def get_block(cells: DataFrame, meta: Meta, bi: int, bj: int) -> DataFrame:
    a, b = meta.tile
    return get_rows(get_col(cells, meta, bj), meta, [bi]).where((F.col("j") >= bj * b) & (F.col("i") >= bi * a))


def get_rows(cells: DataFrame, meta: Meta, rows: list[int]) -> DataFrame:
    """Block rows. Plain ranges of ``i``, so the filter reaches the scan."""
    a = meta.tile[0]
    keep = F.lit(False)
    for r in rows:
        keep = keep | F.col("i").between(r * a, (r + 1) * a - 1)
    return cells.where(keep)


def get_col(cells: DataFrame, meta: Meta, col: int) -> DataFrame:
    b = meta.tile[1]
    return cells.where(F.col("j").between(col * b, (col + 1) * b - 1))


def _bounds(s, n: int) -> tuple[int, int, int]:
    """Start, stop and step in blocks: None is all, an integer that block, [stop], [start, stop] or [start, stop, step]."""
    if s is None:
        return 0, n, 1
    if isinstance(s, int):
        if not 0 <= s < n:
            raise IndexError(s)
        return s, s + 1, 1
    start, stop, step = [(0, s[0], 1), (s[0], s[1], 1) if len(s) > 1 else (), tuple(s) if len(s) > 2 else ()][len(s) - 1]
    start, stop = 0 if start is None else start, n if stop is None else min(stop, n)
    if start < 0 or step is not None and step < 1:
        raise IndexError(s)
    return start, stop, step or 1


def get_line(cells: DataFrame, i: int) -> DataFrame:
    """One row of the matrix, not its block row: an equality on ``i``, so the filter reaches the scan."""
    return cells.where(F.col("i") == i)


def submatrix(cells: DataFrame, meta: Meta, *slices, axes: tuple[str, ...] = ("i", "j")) -> tuple[DataFrame, Meta]:
    """A strided sub-matrix in units of blocks, renumbered from 0, and its shape. Trailing axes default to all.

    ``axes`` names the index columns; a tensor has as many as ``meta`` has sizes.
    """
    out, shape = cells, []
    for axis, name in enumerate(axes):
        start, stop, step = _bounds(slices[axis] if axis < len(slices) else None, meta.n_blocks(axis))
        size, n = meta.tile[axis], meta.shape[axis]
        blocks = range(start, stop, step)
        shape.append(sum(min(size, n - k * size) for k in blocks))
        place = _block(name, size)
        keep = F.col(name).between(start * size, stop * size - 1)
        if step > 1:
            keep = keep & ((place - start) % step == 0)
        out = out.where(keep).withColumn(name, F.expr(f"(({name} div {size}) - {start}) div {step}") * size + F.col(name) % size)
    return out.select(*axes, "v"), replace(meta, shape=tuple(shape), ridge=0.0)


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def permute_rows(cells: DataFrame, permutation: DataFrame) -> DataFrame:
    """Rows moved by ``(src, dst)``; rows not in it stay. A permutation of few rows is broadcast by its measured size."""
    moved = cells.join(permutation, cells["i"] == permutation["src"], "left")
    return moved.select(F.coalesce("dst", "i").alias("i"), "j", "v")


def put(cells: DataFrame, more: DataFrame) -> DataFrame:
    """A new version with the cells of ``more`` in place of those it has at the same indices."""
    return cells.join(more, ["i", "j"], "left_anti").unionByName(more)


def delete_block(cells: DataFrame, meta: Meta, bi: int, bj: int) -> DataFrame:
    a, b = meta.tile
    return cells.where(~(F.col("i").between(bi * a, (bi + 1) * a - 1) & F.col("j").between(bj * b, (bj + 1) * b - 1)))


def with_ridge(cells: DataFrame, ridge: Column) -> DataFrame:
    """The ridge added to stored diagonal cells; a dense diagonal is the caller's (``with_parent``)."""
    return cells.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("v") + ridge).otherwise(F.col("v")).alias("v"))


def get_blocks(cells: DataFrame, meta: Meta, rows: list[int], cols: list[int]) -> DataFrame:
    """The cross product of block rows and block columns, as plain ranges."""
    return transpose(get_rows(transpose(get_rows(cells, meta, rows)), Meta(meta.shape[::-1], meta.tile[::-1]), cols))


def put_missing(cells: DataFrame, more: DataFrame, meta: Meta) -> DataFrame:
    """``cells`` and those of ``more`` that lie in blocks ``cells`` has none of."""
    a, b = meta.tile
    block = [F.expr(f"i div {a}").alias("bi"), F.expr(f"j div {b}").alias("bj")]
    there = cells.select(*block).distinct()
    return cells.unionByName(more.select("*", *block).join(there, ["bi", "bj"], "left_anti").select(*cells.columns))


def put_row(cells: DataFrame, meta: Meta, bi: int, row: DataFrame) -> DataFrame:
    """A block row replaced by ``row``, whose own row indices start at 0."""
    a = meta.tile[0]
    return cells.where(~F.col("i").between(bi * a, (bi + 1) * a - 1)).unionByName(row.withColumn("i", F.col("i") + bi * a))


def put_col(cells: DataFrame, meta: Meta, bj: int, col: DataFrame) -> DataFrame:
    """A block column replaced by ``col``, whose own column indices start at 0."""
    return transpose(put_row(transpose(cells), Meta(meta.shape[::-1], meta.tile[::-1]), bj, transpose(col)))


def from_lower(lower: DataFrame) -> DataFrame:
    """A symmetric matrix from its lower triangle."""
    return lower.unionByName(transpose(lower.where("i > j")))


def without_zeros(cells: DataFrame) -> DataFrame:
    """Stored zeros dropped: absent means the same."""
    return cells.where("v <> 0")
