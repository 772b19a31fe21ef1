import numpy as np
from pyspark.sql import functions as F

from tilespark.streaming.gram import streaming_gram, windowed_counts


def test_gram_of_a_stream(spark, tmp_path):
    x = np.random.default_rng(0).integers(-5, 5, (40, 3))
    for k in range(4):
        spark.createDataFrame([(r.tolist(),) for r in x[k::4]], "vec array<long>").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("vec array<long>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = streaming_gram(stream, "vec").writeStream.format("memory").queryName("gram_sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = np.zeros((3, 3), int)
    for r in spark.table("gram_sums").collect():
        found[r.i, r.j] = r.v
    assert np.array_equal(found, np.triu(x.T @ x))


def test_windows_close_and_leave_out_late_events(spark, tmp_path):
    batches = [[("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], [("2024-01-01 05:00:00", "a")], [("2024-01-01 00:20:00", "a"), ("2024-01-01 09:00:00", "b")]]
    schema = "ts timestamp, event_type string"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    q = None
    for k in range(len(batches)):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / f"[0-{k}]"))
        q = windowed_counts(stream, "ts", "event_type", "1 hour", "30 minutes").writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    found = sorted((str(r.start), r.event_type, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 01:00:00", "b", 1), ("2024-01-01 05:00:00", "a", 1)]
