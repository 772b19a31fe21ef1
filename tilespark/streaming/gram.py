"""Streams of rows: products that add up, kept as a table of sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_gram(rows: DataFrame, vector: str) -> DataFrame:
    """XᵀX of a stream (or a table) of vectors, as a running aggregate of at most width² groups.

    Each row's pairs ``i <= j`` are made inside the row, so no join and no buffered state but the sums is needed.
    """
    pair = F.transform(F.sequence(F.lit(0), F.size(vector) - 1), lambda i: F.transform(F.sequence(i, F.size(vector) - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), (F.get(vector, i) * F.get(vector, j)).alias("p"))))
    each = rows.where(F.size(vector) > 0).select(F.explode(F.flatten(pair)).alias("x")).select("x.*")
    return each.groupBy("i", "j").agg(F.sum("p").alias("v"))


def windowed_counts(events: DataFrame, ts: str, by: str, window: str, delay: str) -> DataFrame:
    """Counts per window and key; events later than ``delay`` behind the newest are left out, and windows close then."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, window), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
