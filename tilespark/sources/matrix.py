"""Matrices as DataFrames: cells ``(i, j, v)`` or tiles ``(bi, bj, nrows, ncols, data)``, and their sources and sinks.

An absent cell or tile is zero. Tiles are row-major; the last tile of an axis may be short, and each carries its own shape.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILES = "bi int, bj int, nrows int, ncols int, data array<double>"
MOST_LOCAL_CELLS = 1 << 26
#: Cells that are filled at once, columns of these, and cells that a task fills.
STRETCH = 1 << 16
STRIP = 1 << 8
PART_CELLS = 1 << 21
MOST_PARTS = 10_000


@dataclass(frozen=True)
class Meta:
    """Shape and tile shape; ``ridge`` is added to the diagonal on read of a square matrix and is not stored."""

    shape: tuple[int, ...]
    tile: tuple[int, ...]
    ridge: float = 0.0

    def __post_init__(self):
        if len(self.shape) != len(self.tile) or min(self.tile, default=1) < 1:
            raise ValueError("one positive tile size for each axis")
        if self.ridge and len(set(self.shape)) > 1:
            raise ValueError("a ridge needs a square matrix")

    def n_blocks(self, axis: int) -> int:
        return -(-self.shape[axis] // self.tile[axis])


def cells_from_rows(df: DataFrame, index: str, values: str, value: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """A row per element of an array column: row index, place in the array, value."""
    return df.select(F.col(index).cast("long").alias("i"), F.posexplode(values).alias("j", "x")).select("i", F.col("j").cast("long").alias("j"), value(F.col("x")).alias("v"))


def cells_from_table(df: DataFrame, i: str, j: str, v: Column) -> DataFrame:
    """A cell per pair of keys, its value an aggregate of the rows that have it."""
    return df.groupBy(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j")).agg(v.alias("v"))


def from_numpy(spark: SparkSession, a: np.ndarray, tile: tuple[int, int]) -> DataFrame:
    """Tiles of a local array, handed over as Arrow."""
    places = [(bi, bj) for bi in range(-(-a.shape[0] // tile[0])) for bj in range(-(-a.shape[1] // tile[1]))]
    cut = [a[bi * tile[0] : (bi + 1) * tile[0], bj * tile[1] : (bj + 1) * tile[1]].astype(float) for bi, bj in places]
    if not cut:
        return spark.createDataFrame([], TILES)
    ints = lambda values: pa.array(list(values), pa.int32())
    data = pa.ListArray.from_arrays(ints(np.cumsum([0, *[t.size for t in cut]])), pa.array(np.concatenate([t.reshape(-1) for t in cut])))
    table = {"bi": ints(p[0] for p in places), "bj": ints(p[1] for p in places), "nrows": ints(t.shape[0] for t in cut), "ncols": ints(t.shape[1] for t in cut), "data": data}
    return spark.createDataFrame(pa.table(table))


def to_numpy(cells: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The whole matrix on the driver, as Arrow batches; refused beyond ``MOST_LOCAL_CELLS`` cells."""
    if shape[0] * shape[1] > MOST_LOCAL_CELLS:
        raise ValueError(f"{shape} is too large to collect")
    out = np.zeros(shape)
    found = cells.select("i", "j", "v").toArrow()
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
    return out


def to_tiles(cells: DataFrame, meta: Meta) -> DataFrame:
    """Dense tiles of those blocks that have cells."""
    (m, n), (a, b) = meta.shape, meta.tile

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(key[0]), int(key[1])
        data = np.zeros((min(a, m - bi * a), min(b, n - bj * b)))
        data[frame["r"].to_numpy(), frame["c"].to_numpy()] = frame["v"].to_numpy()
        return pd.DataFrame({"bi": [bi], "bj": [bj], "nrows": [data.shape[0]], "ncols": [data.shape[1]], "data": [data.reshape(-1)]})

    placed = cells.select(
        F.expr(f"int(i div {a})").alias("bi"), F.expr(f"int(j div {b})").alias("bj"), (F.col("i") % a).alias("r"), (F.col("j") % b).alias("c"), F.col("v").cast("double").alias("v")
    )
    return placed.groupBy("bi", "bj").applyInPandas(fill, TILES)


def to_cells(tiles: DataFrame, meta: Meta) -> DataFrame:
    a, b = meta.tile
    each = tiles.select("bi", "bj", "ncols", F.posexplode("data").alias("p", "v"))
    return each.select((F.col("bi").cast("long") * a + F.expr("p div ncols")).alias("i"), (F.col("bj").cast("long") * b + F.col("p") % F.col("ncols")).alias("j"), "v")


def block_grid(spark: SparkSession, meta: Meta) -> DataFrame:
    """Every block index of a matrix, with its extent: ``bi, bj, nrows, ncols``."""
    (m, n), (a, b) = meta.shape, meta.tile
    rows = spark.range(meta.n_blocks(0)).select(F.col("id").cast("int").alias("bi"))
    grid = rows.select("bi", F.explode(F.sequence(F.lit(0), F.lit(meta.n_blocks(1) - 1))).alias("bj"))
    return grid.select("bi", "bj", F.least(F.lit(a), F.lit(m) - F.col("bi") * a).cast("int").alias("nrows"), F.least(F.lit(b), F.lit(n) - F.col("bj") * b).cast("int").alias("ncols"))


def blocks_of(cells: DataFrame, meta: Meta) -> DataFrame:
    a, b = meta.tile
    return cells.select(F.expr(f"int(i div {a})").alias("bi"), F.expr(f"int(j div {b})").alias("bj")).distinct()


def blocks_existing(cells: DataFrame, meta: Meta) -> DataFrame:
    return block_grid(cells.sparkSession, meta).join(blocks_of(cells, meta), ["bi", "bj"], "left_semi")


def blocks_missing(cells: DataFrame, meta: Meta) -> DataFrame:
    return block_grid(cells.sparkSession, meta).join(blocks_of(cells, meta), ["bi", "bj"], "left_anti")


def with_parent(cells: DataFrame, meta: Meta, parent: Column) -> DataFrame:
    """All cells of the grid; those that are absent get the parent's value, an expression of ``i`` and ``j``.

    Only the cells are shuffled: a task fills the gaps between those of a strip of few columns, piece by piece, row after row.
    So the same columns follow each other again and again, and written cells take up next to no room.
    """
    (m, n), spark = meta.shape, cells.sparkSession
    held = cells.where(F.col("i").between(0, m - 1) & F.col("j").between(0, n - 1))
    high = max(1, STRETCH // STRIP)
    down = max(1, -(-m // high))
    pieces = down * -(-n // STRIP)
    parts = min(MOST_PARTS, max(1, -(-m * n // PART_CELLS)))
    several = max(1, -(-pieces // parts))
    # The piece ``t`` has ``rows`` rows from ``top`` on and ``cols`` columns from ``side`` on; a cell's place counts along its rows.
    top, side = f"(t % {down} * {high})", f"(t div {down} * {STRIP})"
    cols = f"least({STRIP}, {n} - {side})"
    piece = F.expr(f"j div {STRIP} * {down} + i div {high}").alias("t")
    placed = held.select("i", "j", piece).select("t", F.expr(f"(i - {top}) * {cols} + j - {side}").alias("place"))
    all_pieces = spark.range(pieces).select(F.col("id").alias("t"), F.lit(None).cast("long").alias("place"))
    dealt = placed.unionByName(all_pieces).withColumn("g", F.expr(f"t div {several}")).repartition(parts, "g")
    each = dealt.groupBy("g", "t").agg(F.sort_array(F.collect_set("place")).alias("places"))
    places = F.col("places")
    last = F.expr(f"least({high}, {m} - {top}) * {cols} - 1")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(places, lambda x: x + 1))
    gaps = F.arrays_zip(begins.alias("lo"), F.concat(F.transform(places, lambda x: x - 1), F.array(last)).alias("hi"))
    free = each.select("t", F.inline(gaps)).toDF("t", "lo", "hi").where("lo <= hi").select("t", F.explode(F.sequence("lo", "hi")).alias("place"))
    free = free.select(F.expr(f"{top} + place div {cols}").alias("i"), F.expr(f"{side} + place % {cols}").alias("j"))
    return held.select("i", "j", F.coalesce("v", parent).alias("v")).unionByName(free.select("i", "j", parent.alias("v")))


def save(tiles: DataFrame, meta: Meta, path: str) -> None:
    """Tiles as Parquet, sorted into files by block row so that reads of a block row prune, and the header as JSON beside them."""
    spark = tiles.sparkSession
    tiles.repartitionByRange("bi").sortWithinPartitions("bi", "bj").write.mode("overwrite").parquet(f"{path}/tiles")
    header = json.dumps({"shape": meta.shape, "tile": meta.tile, "ridge": meta.ridge})
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Meta]:
    """A saved matrix by its path alone."""
    header = json.loads(spark.read.text(f"{path}/header").first()[0])
    meta = Meta(tuple(header["shape"]), tuple(header["tile"]), header["ridge"])
    return spark.read.parquet(f"{path}/tiles"), meta


def load_line(spark: SparkSession, path: str, i: int) -> DataFrame:
    """Cells of one row of a saved matrix: only its block row's files are read, and only the row's part of each tile is kept."""
    tiles, meta = load(spark, path)
    part = tiles.where(F.col("bi") == i // meta.tile[0]).select("bj", F.slice("data", F.lit(i % meta.tile[0]) * F.col("ncols") + 1, F.col("ncols")).alias("data"))
    each = part.select("bj", F.posexplode("data").alias("p", "v"))
    return each.select(F.lit(i).cast("long").alias("i"), (F.col("bj").cast("long") * meta.tile[1] + F.col("p")).alias("j"), "v")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a matrix has been saved at ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/header")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def saved(spark: SparkSession, folder: str) -> DataFrame:
    """``path, shape, tile`` of every matrix saved in a folder, from their headers alone."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/header")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    paths = [f.getPath().toString() for f in found or []]
    rows = spark.read.text(paths).select(F.regexp_replace(F.input_file_name(), "/header/[^/]*$", "").alias("path"), F.from_json("value", "shape array<long>, tile array<long>").alias("h")) if paths else None
    return rows.select("path", "h.shape", "h.tile") if paths else spark.createDataFrame([], "path string, shape array<long>, tile array<long>")


def free(spark: SparkSession, path: str) -> bool:
    """Delete a saved matrix, tiles and header."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
