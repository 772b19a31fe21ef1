"""Small helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of one word: no ASCII white space (tab to carriage return, space).
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; where it is unset, a folder of this machine in local mode, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not f"{context.master}[".startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tilespark-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so a lost executor loses no rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """A checkpointed table of narrow rows, to be broadcast if it has few; beyond that Spark shuffles as usual."""
    return F.broadcast(df) if df.count() <= most_rows else df


class Written:
    """A table written as Parquet under the shared checkpoint folder."""

    def __init__(self, table: DataFrame, path: str):
        self.table, self.path = table, path

    def drop(self) -> None:
        spark = self.table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame) -> Written:
    """``df`` as Parquet in the shared checkpoint folder: smaller there than ``checkpointed``, and dropped by hand."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Written(spark.read.schema(df.schema).parquet(path), path)


def sliced(batch: pa.RecordBatch, column: int, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``most`` bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
    give_back()


def give_back() -> None:
    """What a worker has freed goes back to the machine: workers live on between tasks, and pools keep their largest size."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished phases now: it acts when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def tree_sum(parts: DataFrame, add: Callable[[list[bytes]], bytes], merge: int = 16) -> DataFrame:
    """Rows ``part, chunk, packed``: of each chunk one, the sum over all parts. No task adds more than ``merge`` of them."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // merge], "chunk": [int(frame["chunk"].iloc[0])], "packed": [add(list(frame["packed"]))]})

    most = parts.agg(F.max("part")).first()[0]
    while most is not None:
        by = [F.expr(f"part div {merge}").alias("p"), F.col("chunk").alias("c")]
        parts = checkpointed(parts.groupBy(*by).applyInPandas(one, "part long, chunk long, packed binary"))
        most = most // merge or None
    return parts
