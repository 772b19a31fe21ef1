"""Factorisations over tiles: short driver loops over panels, each step a join and a NumPy kernel in an Arrow UDF.

Only the one diagonal tile of a step is on the driver. Steps are cut in the shared checkpoint folder, and what a step replaces
is dropped there. A matrix that fits one task (``MOST_ONE_TASK`` rows) needs no loop; ``tiled=True`` takes the loop all the
same. Orthogonal factors stay as the reflectors of their steps (``Orthogonal``), which apply Q or Qᵀ to any matrix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..session import Kept, cut_lineage
from ..sources.matrix import TILES, Meta, block_grid, from_numpy, to_cells, to_numpy

MOST_ONE_TASK = 1024
MERGE = 8


def _array(row, data: str = "data", shape: tuple[str, str] = ("nrows", "ncols")) -> np.ndarray:
    return np.asarray(getattr(row, data), float).reshape(getattr(row, shape[0]), getattr(row, shape[1]))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(bi, bj, a.shape[0], a.shape[1], a.reshape(-1)) for bi, bj, a in rows], columns=["bi", "bj", "nrows", "ncols", "data"])


def _map(tiles: DataFrame, f) -> DataFrame:
    """``f`` of each row gives a tile."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield _frame([(r.bi, r.bj, f(r)) for r in frame.itertuples()])

    return tiles.mapInPandas(run, TILES)


def _one(tiles: DataFrame, bi: int, bj: int) -> np.ndarray:
    found = tiles.where((F.col("bi") == bi) & (F.col("bj") == bj)).first()
    if found is None:
        raise np.linalg.LinAlgError(f"the diagonal tile {bi} is absent, so the matrix is singular")
    return _array(found)


def _whole(tiles: DataFrame, meta: Meta, f) -> DataFrame:
    """``f`` of the dense matrix in one task, cut into tiles of ``meta`` again."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(meta.shape)
        r, c = meta.tile
        for t in frame.itertuples():
            a[t.bi * r : t.bi * r + t.nrows, t.bj * c : t.bj * c + t.ncols] = _array(t)
        out = f(a)
        cut = [(i, j, out[i * r : (i + 1) * r, j * c : (j + 1) * c]) for i in range(meta.n_blocks(0)) for j in range(meta.n_blocks(1))]
        return _frame([x for x in cut if x[2].any()])

    return tiles.groupBy().applyInPandas(run, TILES)


def cholesky(tiles: DataFrame, meta: Meta, truncate: int = 0, tiled: bool = False) -> DataFrame:
    """Lower tiles L with L Lᵀ = A; ``truncate`` leaves out the last block rows. Only the lower triangle is read."""
    n = meta.n_blocks(0) - truncate
    rows = min(meta.shape[0], n * meta.tile[0])
    lower = tiles.where((F.col("bj") <= F.col("bi")) & (F.col("bi") < n))
    if rows <= MOST_ONE_TASK and not tiled:
        small = Meta((rows, rows), meta.tile)
        return _whole(lower, small, lambda a: np.linalg.cholesky(np.tril(a) + np.tril(a, -1).T)).where("bj <= bi")
    grid = block_grid(tiles.sparkSession, Meta((rows, rows), meta.tile)).where("bj <= bi")
    kept, out = Kept(lower), None
    for p in range(n):
        left = kept.table
        diagonal = kernels.chol(_one(left, p, p))
        done = from_numpy(tiles.sparkSession, diagonal, diagonal.shape).withColumn("bi", F.lit(p)).withColumn("bj", F.lit(p))
        if p + 1 < n:
            panel = cut_lineage(_map(left.where((F.col("bj") == p) & (F.col("bi") > p)), lambda r, low=diagonal: kernels.trsm(low, _array(r))))
            done = done.unionByName(panel)
            before, kept = kept, Kept(_trailing(left.where(F.col("bj") > p), grid.where(F.col("bj") > p), panel))
            before.drop()
        out = done if out is None else out.unionByName(done)
    kept.drop()
    return out


def _trailing(left: DataFrame, grid: DataFrame, panel: DataFrame) -> DataFrame:
    """left[j, k] − panel[j] panel[k]ᵀ over the grid; tiles that were absent fill in."""
    x = panel.select("bi", F.col("ncols").alias("width"), F.col("data").alias("x"))
    y = panel.select(F.col("bi").alias("bj"), F.col("data").alias("y"))
    met = grid.join(left.select("bi", "bj", "data"), ["bi", "bj"], "left").join(x, "bi", "left").join(y, "bj", "left").where("data is not null or x is not null and y is not null")

    def update(r) -> np.ndarray:
        s = np.zeros((r.nrows, r.ncols)) if r.data is None else _array(r)
        return s if r.x is None or r.y is None else kernels.syrk(s, np.asarray(r.x).reshape(r.nrows, -1), np.asarray(r.y).reshape(r.ncols, -1))

    return _map(met, update)


def trisolve(factor: DataFrame, meta: Meta, b: DataFrame, transposed: bool = False) -> DataFrame:
    """X with L X = B, or Lᵀ X = B: substitution by block rows. ``b`` has the same row tiles and any columns."""
    n, last = meta.n_blocks(0), b.agg(F.max("bj")).first()[0]
    if last is None:
        return b
    heights = block_grid(b.sparkSession, Meta((meta.shape[0], 1), (meta.tile[0], 1))).select("bi", "nrows")
    columns = F.explode(F.sequence(F.lit(0), F.lit(last)))
    grid = cut_lineage(heights.withColumn("bj", columns).join(b.groupBy("bj").agg(F.max("ncols").alias("ncols")), "bj"))
    kept, out = Kept(b), None
    for p in range(n - 1, -1, -1) if transposed else range(n):
        left, low = kept.table, _one(factor, p, p)
        solved = cut_lineage(_map(left.where(F.col("bi") == p), lambda r, low=low: np.linalg.solve(low.T if transposed else low, _array(r))))
        out = solved if out is None else out.unionByName(solved)
        part = factor.where((F.col("bi") == p) & (F.col("bj") < p)) if transposed else factor.where((F.col("bj") == p) & (F.col("bi") > p))
        if (p == 0) if transposed else (p == n - 1):
            break
        step = part.select(F.col("bj" if transposed else "bi").alias("bi"), F.col("nrows").alias("f_rows"), F.col("data").alias("low"))
        ahead = F.col("bi") < p if transposed else F.col("bi") > p
        met = grid.where(ahead).join(left.select("bi", "bj", "data"), ["bi", "bj"], "left").join(step, "bi", "left").join(solved.select("bj", F.col("data").alias("x")), "bj", "left")

        def update(r) -> np.ndarray:
            s = np.zeros((r.nrows, r.ncols)) if r.data is None else _array(r)
            if r.low is None or r.x is None:
                return s
            a = np.asarray(r.low).reshape(int(r.f_rows), -1)
            return s - (a.T if transposed else a) @ np.asarray(r.x).reshape(-1, r.ncols)

        before, kept = kept, Kept(_map(met.where("data is not null or low is not null and x is not null"), update))
        before.drop()
    kept.drop()
    return out


def posv(tiles: DataFrame, meta: Meta, b: DataFrame, tiled: bool = False) -> DataFrame:
    """X with A X = B for symmetric positive definite A."""
    low = cut_lineage(cholesky(tiles, meta, tiled=tiled))
    return trisolve(low, meta, trisolve(low, meta, b), transposed=True)


def _signed(r: np.ndarray) -> np.ndarray:
    """Rows turned so that the diagonal is not negative."""
    turn = np.where(np.diag(r) < 0, -1.0, 1.0)
    return r * turn[:, None]


def tsqr(rows: DataFrame, vector: Column, width: int) -> DataFrame:
    """Cells of R with RᵀR = XᵀX, diagonal not negative: a QR in each partition, then a tree of QRs of stacked triangles.

    Any number of partitions and rows, fewer than ``width`` too. No step holds more than ``MERGE`` small triangles.
    """
    schema = "part long, data array<double>"

    def local(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, part = np.zeros((0, width)), None
        for f in frames:
            if len(f):
                part = int(f["part"].iloc[0])
                r = np.linalg.qr(np.vstack([r, np.stack(f["x"].to_list()).astype(float)]), mode="r")
        if part is not None:
            yield pd.DataFrame({"part": [part], "data": [r.reshape(-1)]})

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.vstack([np.asarray(d).reshape(-1, width) for d in frame.sort_values("part")["data"]]), mode="r")
        return pd.DataFrame({"part": [int(key[0])], "data": [r.reshape(-1)]})

    parts = cut_lineage(rows.select(vector.cast("array<double>").alias("x"), F.spark_partition_id().cast("long").alias("part")).mapInPandas(local, schema))
    most = parts.agg(F.max("part")).first()[0]
    while most:
        parts = cut_lineage(parts.groupBy(F.expr(f"part div {MERGE}").alias("p")).applyInPandas(merge, schema))
        most //= MERGE
    found = parts.first()
    r = np.zeros((width, width))
    if found:
        small = np.asarray(found["data"]).reshape(-1, width)
        r[: len(small)] = small
    r = _signed(r)
    return rows.sparkSession.createDataFrame([(i, j, float(r[i, j])) for i in range(width) for j in range(i, width)], "i long, j long, v double")


_FACTORS = "bi int, v_rows int, v array<double>, t array<double>, r_rows int, r_cols int, r array<double>"


def _factored(bi: int, *blocks: np.ndarray) -> tuple:
    v, t, r = kernels.qr_factor(*blocks)
    return (bi, len(v), v.reshape(-1), t.reshape(-1), *r.shape, r.reshape(-1))


def _paired(level: int, first: int) -> Column:
    """The upper of the two block rows that meet at a level of the tree."""
    return (F.expr(f"(bi - {first}) div {2 * level}") * (2 * level) + first).cast("int")


def _leads(level: int, first: int) -> Column:
    return (F.col("bi") - first) % level == 0


def _reflectors(tiles: DataFrame, col: int, first: int, n: int) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """QR of block column ``col`` from block row ``first`` on: its top triangle, and the reflectors of each step.

    A leaf step (level 0) factors each tile; then a binary tree merges triangles two and two. A row without a partner
    passes through, so any number of block rows will do.
    """
    names = [c.split()[0] for c in _FACTORS.split(", ")]

    def leaf(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([_factored(r.bi, _array(r)) for r in f.itertuples()], columns=names)

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(frame.sort_values("bi").itertuples())
        if len(rows) == 1:
            r = rows[0]
            return pd.DataFrame([(r.bi, 0, np.zeros(0), np.zeros(0), r.r_rows, r.r_cols, r.r)], columns=names)
        return pd.DataFrame([_factored(rows[0].bi, *[_array(r, "r", ("r_rows", "r_cols")) for r in rows])], columns=names)

    factors = cut_lineage(tiles.where((F.col("bj") == col) & (F.col("bi") >= first)).mapInPandas(leaf, _FACTORS))
    steps, level = [(0, factors)], 1
    while first + level < n:
        factors = cut_lineage(factors.where(_leads(level, first)).groupBy(_paired(level, first).alias("g")).applyInPandas(merge, _FACTORS))
        steps.append((level, factors))
        level *= 2
    top = factors.select(F.lit(first).cast("int").alias("bi"), F.lit(col).cast("int").alias("bj"), F.col("r_rows").alias("nrows"), F.col("r_cols").alias("ncols"), F.col("r").alias("data"))
    return top, steps


def _applied(steps: list[tuple[int, DataFrame]], tiles: DataFrame, first: int, back: bool = False) -> DataFrame:
    """Qᵀ, or Q if ``back``, of one panel's steps times tiles, whose block rows all are from ``first`` on."""

    def reflect(r) -> np.ndarray:
        v = np.asarray(r.v).reshape(int(r.v_rows), -1)
        return kernels.qr_leaf(v, np.asarray(r.t).reshape(v.shape[1], -1), _array(r), back)

    def pair(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(frame.sort_values("bi").itertuples())
        if len(rows) == 1:
            return _frame([(rows[0].bi, rows[0].bj, _array(rows[0]))])
        top, low = rows
        v = np.asarray(top.v).reshape(int(top.v_rows), -1)
        a, b = kernels.qr_trailing(v, np.asarray(top.t).reshape(v.shape[1], -1), _array(top), _array(low), back)
        return _frame([(top.bi, top.bj, a), (low.bi, low.bj, b)])

    for level, factors in reversed(steps) if back else steps:
        small = factors.select("bi", "v_rows", "v", "t")
        if level == 0:
            tiles = _map(tiles.join(small, "bi"), reflect)
        else:
            tiles = cut_lineage(tiles)
            moving = tiles.where(_leads(level, first)).withColumn("g", _paired(level, first)).join(small.withColumnRenamed("bi", "g"), "g")
            tiles = tiles.where(~_leads(level, first)).unionByName(moving.groupBy("g", "bj").applyInPandas(pair, TILES))
    return cut_lineage(tiles)


def _eliminate(tiles: DataFrame, col: int, first: int, n: int) -> tuple[DataFrame, DataFrame, list[tuple[int, DataFrame]]]:
    """QR of a block column, and Qᵀ of the columns after it: (top triangle, trailing tiles, reflectors)."""
    top, steps = _reflectors(tiles, col, first, n)
    return top, _applied(steps, tiles.where((F.col("bj") > col) & (F.col("bi") >= first)), first), steps


@dataclass
class Orthogonal:
    """A square orthogonal matrix as the product of its panels' reflectors (V, T), ``(first block row, steps)`` each."""

    meta: Meta
    panels: list[tuple[int, list]] = field(default_factory=list)

    def times(self, tiles: DataFrame, meta: Meta, transposed: bool = False) -> DataFrame:
        """Q X, or Qᵀ X, for tiles of X with the same block rows and any block columns."""
        out = _dense(tiles, meta)
        for first, steps in self.panels if transposed else reversed(self.panels):
            out = out.where(F.col("bi") < first).unionByName(_applied(steps, out.where(F.col("bi") >= first), first, not transposed))
        return out

    def reflectors(self) -> DataFrame:
        """All of them: ``first, level, bi, v_rows, v, t``."""
        out = None
        for first, steps in self.panels:
            for level, factors in steps:
                rows = factors.where("v_rows > 0").select(F.lit(first).alias("first"), F.lit(level).alias("level"), "bi", "v_rows", "v", "t")
                out = rows if out is None else out.unionByName(rows)
        return out


def _square(meta: Meta) -> None:
    if meta.tile[0] != meta.tile[1]:
        raise ValueError("square tiles only")


def qr(tiles: DataFrame, meta: Meta, tiled: bool = False) -> DataFrame:
    """Tiles of R, upper triangular with diagonal not negative in its cells up to sign (``signed_cells``). Shape as A's at most."""
    _square(meta)
    if max(meta.shape) <= MOST_ONE_TASK and not tiled:
        return _whole(tiles, meta, lambda a: np.pad(r := np.linalg.qr(a, mode="r"), ((0, a.shape[0] - len(r)), (0, 0))))
    return qr_factors(tiles, meta)[0]


def qr_factors(tiles: DataFrame, meta: Meta) -> tuple[DataFrame, Orthogonal]:
    """R as of ``qr``, and Q with Q R = A, by the panel loop."""
    _square(meta)
    left, out, q = cut_lineage(_dense(tiles, meta)), None, Orthogonal(meta)
    for p in range(min(meta.n_blocks(0), meta.n_blocks(1))):
        top, rest, steps = _eliminate(left, p, p, meta.n_blocks(0))
        q.panels.append((p, steps))
        done = top.unionByName(rest.where(F.col("bi") == p))
        out = done if out is None else out.unionByName(done)
        left = rest.where(F.col("bi") > p)
    return out, q


def _dense(tiles: DataFrame, meta: Meta) -> DataFrame:
    """Absent tiles as zeros: orthogonal steps fill them anyway."""
    grid = block_grid(tiles.sparkSession, meta)
    filled = grid.join(tiles.select("bi", "bj", "data"), ["bi", "bj"], "left")
    zeros = F.array_repeat(F.lit(0.0), F.col("nrows") * F.col("ncols"))
    return filled.select("bi", "bj", "nrows", "ncols", F.coalesce("data", zeros).alias("data"))


def _turned(tiles: DataFrame) -> DataFrame:
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield _frame([(r.bj, r.bi, _array(r).T) for r in f.itertuples()])

    return tiles.mapInPandas(run, TILES)


def bdfac(tiles: DataFrame, meta: Meta, truncate: int = 0, tiled: bool = False) -> DataFrame:
    """Block upper bidiagonal tiles with A's singular values: a QR of each block column, then an LQ of the block row.

    ``truncate`` stops that many steps early and returns the band's first block rows only.
    """
    _square(meta)
    n = meta.n_blocks(0)
    if meta.shape[0] != meta.shape[1]:
        raise ValueError("square matrices only")
    if meta.shape[0] <= MOST_ONE_TASK and not tiled:
        return _whole(tiles, meta, lambda a: _band(a, meta.tile[0], n - truncate)).where(f"bj >= bi and bj <= bi + 1 and bi < {n - truncate}")
    return bdfac_factors(tiles, meta, truncate)[0]


def bdfac_factors(tiles: DataFrame, meta: Meta, truncate: int = 0) -> tuple[DataFrame, DataFrame, Orthogonal, Orthogonal]:
    """Band, rest, Q and P with Q (band + rest) Pᵀ = A, by the panel loop.

    The rest are the last ``truncate`` block rows and columns, which no step has factored but all have been applied to; it
    is empty if no step is left out.
    """
    _square(meta)
    n = meta.n_blocks(0)
    left, out, q, p_right = cut_lineage(_dense(tiles, meta)), None, Orthogonal(meta), Orthogonal(meta)
    for p in range(n - truncate):
        top, rest, steps = _eliminate(left, p, p, n)
        q.panels.append((p, steps))
        out = top if out is None else out.unionByName(top)
        left = rest
        if p + 1 < n:
            across, turned, steps = _eliminate(_turned(rest), p, p + 1, n)
            p_right.panels.append((p + 1, steps))
            out = out.unionByName(_turned(across))
            left = _turned(turned)
    return left.where("false") if out is None else out, left, q, p_right


def _band(a: np.ndarray, t: int, steps: int) -> np.ndarray:
    """The same on a dense matrix."""
    for p in range(0, steps * t, t):
        q, r = np.linalg.qr(a[p:, p : p + t], mode="complete")
        a[p:, p + t :] = q.T @ a[p:, p + t :]
        a[p:, p : p + t] = r
        if p + t < len(a):
            q, r = np.linalg.qr(a[p : p + t, p + t :].T, mode="complete")
            a[p + t :, p + t :] = a[p + t :, p + t :] @ q
            a[p : p + t, p + t :] = r.T
    return a


def singular_values(tiles: DataFrame, meta: Meta, tiled: bool = False) -> DataFrame:
    """``k, v``, largest first: from the band that ``bdfac`` leaves, whose size is checked before it comes to the driver."""
    band = to_numpy(to_cells(bdfac(tiles, meta, tiled=tiled), meta), meta.shape)
    d, e = kernels.bidiagonal(band)
    s = np.linalg.svd(np.diag(d) + np.diag(e, 1), compute_uv=False)
    return tiles.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(s)], "k long, v double")


def singular_values_tall(rows: DataFrame, vector: Column, width: int) -> DataFrame:
    """Of a tall matrix: those of its R."""
    r = to_numpy(tsqr(rows, vector, width), (width, width))
    s = np.linalg.svd(r, compute_uv=False)
    return rows.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(s)], "k long, v double")


def _rows_times(rows: DataFrame, vector: Column, m: np.ndarray) -> DataFrame:
    """Each row's vector times a small matrix: ``id, vec``."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"id": f["id"], "vec": list(np.stack(f["x"].to_list()).astype(float) @ m)})

    return rows.select(F.col("id").cast("long").alias("id"), vector.cast("array<double>").alias("x")).mapInPandas(run, "id long, vec array<double>")


def tsqr_factors(rows: DataFrame, vector: Column, width: int) -> tuple[DataFrame, np.ndarray]:
    """Q as rows ``id, vec`` and R with Q R = X, QᵀQ = I, for rows ``id`` and vector of full column rank.

    Q is X R⁻¹, made orthogonal to rounding by a second pass over itself. Only R, ``width`` squared, is on the driver.
    """
    first = to_numpy(tsqr(rows, vector, width), (width, width))
    near = cut_lineage(_rows_times(rows, vector, np.linalg.inv(first)))
    second = to_numpy(tsqr(near, F.col("vec"), width), (width, width))
    return _rows_times(near, F.col("vec"), np.linalg.inv(second)), second @ first


def svd_tall(rows: DataFrame, vector: Column, width: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """U as rows ``id, vec``, the singular values, and V with U diag(s) Vᵀ = X, for a tall matrix of full column rank."""
    q, r = tsqr_factors(rows, vector, width)
    u, s, vt = np.linalg.svd(r)
    return _rows_times(q, F.col("vec"), u), s, vt.T


def least_squares(rows: DataFrame, vector: Column, target: Column, width: int) -> np.ndarray:
    """The x that brings X x nearest to the target: R of X with the target beside it holds both R and Qᵀ target."""
    r = to_numpy(tsqr(rows, F.concat(vector.cast("array<double>"), F.array(target.cast("double"))), width + 1), (width + 1, width + 1))
    return np.linalg.solve(r[:width, :width], r[:width, width])
