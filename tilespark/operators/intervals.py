"""Union of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def busy_time(intervals: DataFrame, by: list[str], span: int = 86_400) -> DataFrame:
    """Length that ``(start, stop)`` intervals of each group cover, overlaps counted once: a running largest stop opens islands.

    A group is cut into stretches of ``span``; only the largest stop of each goes on to the next ones, so that no task has
    to hold a group's intervals in order.
    """
    cut = intervals.withColumn("__stretch", F.floor(F.col("start") / span))
    so_far = Window.partitionBy(*by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = cut.groupBy(*by, "__stretch").agg(F.max("stop").alias("__last")).withColumn("__carried", F.max("__last").over(so_far)).drop("__last")
    inside = Window.partitionBy(*by, "__stretch").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "__stretch")]
    with_before = cut.withColumn("__before", F.max("stop").over(inside)).alias("a").join(stretches.alias("b"), same).select("a.*", "b.__carried")
    before = F.coalesce(F.greatest("__before", "__carried"), "start")
    return with_before.groupBy(*by).agg(F.sum(F.greatest(F.col("stop") - F.greatest("start", before), F.lit(0))).alias("busy"))
