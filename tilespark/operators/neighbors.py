"""Nearest neighbours through products of blocks, and classification accuracy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
TASK_QUERIES = 512


def distances(x: DataFrame, y: DataFrame) -> DataFrame:
    """Cells of squared distances, zeros too, between all rows of two cell matrices that have cells: |x|² + |y|² − 2 x·y.

    The result is a row per pair. Over few columns whole rows meet and no pair is shuffled; else the rows of ``x`` go to every
    block of those of ``y`` and meet them there.
    """
    from .gemm import all_pairs, gemm, inner_indices, inner_product, wide_rows

    few = inner_indices(y, "j")
    if few is not None:
        size = F.sum(F.col("v") * F.col("v"))
        left, right = (wide_rows(c, "i", "j", "v", n, few, size.alias(f"s_{n}")) for c, n in ((x, "i"), (y, "j")))
        kind = x.select(size.alias("s")).schema["s"].dataType
        dot = F.coalesce(inner_product("i", "j", few, kind), F.lit(0))
        return all_pairs(left, right, "i", "j", compact=True).select("i", "j", (F.col("s_i") + F.col("s_j") - 2 * dot).alias("v"))
    square = lambda c, n: c.groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("s")).select(F.col("i").alias(n), F.col("s").alias(f"s_{n}"))
    right = square(y, "j")
    left, right = _met_by_block(square(x, "i"), right, "j", -(-right.count() // BLOCK))
    inner = gemm(x, y, transpose_y=True)
    return left.join(right, "block").drop("block").join(inner, ["i", "j"], "left").select("i", "j", (F.col("s_i") + F.col("s_j") - 2 * F.coalesce("v", F.lit(0))).alias("v"))


def _met_by_block(left: DataFrame, right: DataFrame, by: str, blocks: int) -> tuple[DataFrame, DataFrame]:
    """``right`` dealt into blocks by a hash, and ``left`` once for each of them."""
    every = F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1)))
    return left.withColumn("block", every), right.withColumn("block", F.pmod(F.xxhash64(by), F.lit(max(1, blocks))).cast("int"))


def nearest(queries: DataFrame, data: DataFrame, k: int = 1, others: bool = False) -> DataFrame:
    """``i, j, v, place``: the ``k`` nearest rows of ``data`` to each query row, ``(id, vec)`` both; ties to the smaller id.

    With ``others`` a row of the query's own id does not count.

    Rows are dealt into blocks, and a block of queries meets each block of data once, as one matrix product; each meeting
    keeps ``k`` a query, so what is shuffled after it grows with queries times blocks, not with pairs.
    """
    dealt = lambda df, size, name: F.pmod(F.xxhash64("id"), F.lit(-(-df.count() // size) or 1)).cast("int").alias(name)
    qs = queries.select("id", "vec", dealt(queries, TASK_QUERIES, "qb")).groupBy("qb").agg(F.collect_list("id").alias("q_ids"), F.collect_list("vec").alias("q_vecs"))
    ds = data.select("id", "vec", dealt(data, BLOCK, "block")).groupBy("block").agg(F.collect_list("id").alias("d_ids"), F.collect_list("vec").alias("d_vecs"))
    met = qs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((-(-data.count() // BLOCK) or 1) - 1)))).join(ds, "block")

    def best(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                q, d = np.stack(list(r.q_vecs)).astype(float), np.stack(list(r.d_vecs)).astype(float)
                ids = np.asarray(r.d_ids)
                apart = np.round((q * q).sum(1)[:, None] + (d * d).sum(1)[None] - 2 * q @ d.T, 9)
                if others:
                    apart[np.asarray(r.q_ids)[:, None] == ids[None]] = np.inf
                near = np.lexsort((np.broadcast_to(ids, apart.shape), apart))[:, :k]
                n = near.shape[1]
                made = pd.DataFrame({"i": np.repeat(np.asarray(r.q_ids), n), "j": ids[near].reshape(-1), "v": np.take_along_axis(apart, near, 1).reshape(-1)})
                yield made[np.isfinite(made["v"])]

    found = met.mapInPandas(best, "i long, j long, v double")
    place = F.row_number().over(Window.partitionBy("i").orderBy("v", "j"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def accuracy(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of queries whose nearest row has their label: ``predicted`` (i, j), ``labels`` (id, label)."""
    a = labels.select(F.col("id").alias("i"), F.col("label").alias("own"))
    b = labels.select(F.col("id").alias("j"), F.col("label").alias("near"))
    return predicted.join(a, "i").join(b, "j").agg(F.avg(F.when(F.col("own") == F.col("near"), 1.0).otherwise(0.0)).alias("accuracy"))
