"""Changing the tile grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.matrix import TILES, Meta, to_cells, to_tiles


def reshard(tiles: DataFrame, meta: Meta, tile: tuple[int, int]) -> tuple[DataFrame, Meta]:
    """Any new tile shape: cells, renumbered by division, and tiles again."""
    new = Meta(meta.shape, tile, meta.ridge)
    return to_tiles(to_cells(tiles, meta), new), new


def reshard_down(tiles: DataFrame, meta: Meta, parts: tuple[int, int]) -> tuple[DataFrame, Meta]:
    """Each tile splits into ``parts``; the tile shape must divide. A map over tiles: no shuffle."""
    if any(t % p for t, p in zip(meta.tile, parts)):
        raise ValueError("parts must divide the tile")
    a, b = (t // p for t, p in zip(meta.tile, parts))

    def split(frames):
        for f in frames:
            rows = []
            for t in f.itertuples():
                x = np.asarray(t.data).reshape(t.nrows, t.ncols)
                for r in range(0, t.nrows, a):
                    for c in range(0, t.ncols, b):
                        y = x[r : r + a, c : c + b]
                        rows.append((t.bi * parts[0] + r // a, t.bj * parts[1] + c // b, *y.shape, y.reshape(-1)))
            yield pd.DataFrame(rows, columns=["bi", "bj", "nrows", "ncols", "data"])

    return tiles.mapInPandas(split, TILES), Meta(meta.shape, (a, b), meta.ridge)


def reshard_tensor(cells: DataFrame, axes: list[str], tile: tuple[int, ...]) -> DataFrame:
    """Cells of any rank to tiles ``b0.., first, data``: values in row-major order of their place, absent ones left out."""
    blocks = [F.expr(f"{x} div {t}").alias(f"b{k}") for k, (x, t) in enumerate(zip(axes, tile))]
    place = F.lit(0).cast("long")
    for x, t in zip(axes, tile):
        place = place * t + F.col(x) % t
    each = cells.select(*blocks, F.struct(place.alias("place"), "v").alias("cell"))
    return each.groupBy(*[f"b{k}" for k in range(len(axes))]).agg(F.sort_array(F.collect_list("cell")).alias("cells"))
