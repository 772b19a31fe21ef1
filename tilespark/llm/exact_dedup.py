"""Exact deduplication with a heavy-hitter split, on DataFrame functions only.

A Misra-Gries style sketch (``freqItems``) names every digest that could hold more than ``support`` of the rows. An
exact count verifies the candidates, and the verified winners, at most ``1 / support`` rows by construction, are
broadcast, so the rows of large groups are decided where they are read. The other digests, each of fewer than
``support`` of the rows, are summed map-side and meet their rows in an ordinary shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import checkpointed

SUPPORT = 0.001


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical; null counts as empty. Of equal texts the row with the largest id stays;
    null ids rank lowest, and of rows that repeat both id and text exactly one stays. An empty table gives an empty result;
    other columns are not looked at.
    """
    rows = checkpointed(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256).alias("text_sha256"),
        ).withColumn("row_no", F.monotonically_increasing_id())
    )
    n = rows.count()
    best = [
        F.max(F.struct("doc_id", "row_no")).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    ]
    candidates = rows.freqItems(["text_sha256"], support).select(F.explode(F.col("text_sha256_freqItems")).alias("text_sha256"))
    winners = checkpointed(
        rows.join(F.broadcast(candidates), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(*best)
        .where(F.col("group_size") >= F.lit(n * support))
    )
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    light = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    light = light.join(light.groupBy("text_sha256").agg(*best).hint("shuffle_hash"), "text_sha256")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("best.row_no")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops; columns and their order stay.

    Rows are matched by id and digest. Where a row repeats (same id, same text), one of the repeats stays. Null and empty texts
    are equal, so one row of them all stays; null ids rank lowest; an empty table stays empty.
    """
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    groups = exact_groups(docs, id_col, text_col, support)
    same = groups.groupBy(F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"))
    kept = checkpointed(same.agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__rows")).where("__kept"))
    match = [F.col(id_col).eqNullSafe(F.col("__keep_id")), digest == F.col("__keep_sha")]
    single = docs.join(kept.where("__rows = 1"), match, "left_semi")
    repeated = kept.where("__rows > 1")
    if repeated.isEmpty():
        return single
    row = docs.join(repeated, match, "left_semi").withColumn("__keep_sha", digest)
    return single.unionByName(row.dropDuplicates([id_col, "__keep_sha"]).select(*docs.columns))
