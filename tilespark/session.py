"""Session defaults, and cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: that of ``spark.checkpoint.dir``. Where it is unset, one of this machine in local mode, else an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tilespark-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept where all executors can read it, so iterative plans stay short and survive losses."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Kept:
    """A table written as Parquet in the checkpoint folder until ``drop`` is called: for what a loop replaces at each step."""

    def __init__(self, df: DataFrame):
        self.path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.table = df.sparkSession.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        spark = self.table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
