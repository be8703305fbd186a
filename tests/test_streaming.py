from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from regionflow import schemas
from regionflow.streaming import snapshots


def snap(country, t, i):
    return (country, t, float(i), 0, float(i), 0.0)


def write(table, path, batches):
    for rows in batches:
        snapshots.write_snapshot(table(rows, schemas.SNAPSHOT).coalesce(1), path)


def memory(spark, df, tmp_path, mode="complete"):
    name = f"t_{uuid.uuid4().hex}"
    query = snapshots.sink_memory(df, name, str(tmp_path / uuid.uuid4().hex), mode)
    query.awaitTermination()
    return spark.table(name)


def test_running_metrics_over_files(spark, table, tmp_path):
    path = str(tmp_path / "in")
    write(table, path, [[snap("a", 2, 11), snap("b", 1, 3)], [snap("a", 1, 50), snap("a", 0, 2)], [snap("b", 4, 2)]])
    stream = snapshots.read_snapshot_stream(spark, path, max_files=1)
    got = memory(spark, snapshots.stream_series_metrics(stream), tmp_path)
    assert sorted(map(tuple, got.collect())) == [("a", 1, 50.0), ("b", 2, 3.0)]
    updates = memory(spark, snapshots.stream_series_metrics(stream), tmp_path, "update")
    assert updates.filter("country = 'a'").count() == 2


def test_rolling_windows_complete(spark, table, tmp_path):
    path = str(tmp_path / "in")
    write(table, path, [[snap("a", t, t) for t in range(4)], [snap("a", t, t) for t in range(4, 8)]])
    stream = snapshots.read_snapshot_stream(spark, path, max_files=1)
    stream = stream.withColumn("ts", snapshots.day_timestamp(F.col("t")))
    got = memory(spark, snapshots.rolling_snapshot_agg(stream, "3 days", "1 day"), tmp_path)
    rows = {r["start"].isoformat()[:10]: (r["n"], r["total"]) for r in got.collect()}
    assert rows["2020-01-03"] == (3, 2.0 + 3 + 4) and rows["2019-12-30"] == (1, 0.0) and len(rows) == 10


def test_rolling_windows_append_with_watermark(spark, table, tmp_path):
    """Append gives closed windows only; later files of the wait time still count."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(table, path, [[snap("a", 0, 1), snap("a", 5, 1)], [snap("a", 3, 1)], [snap("a", 30, 1)], [snap("a", 31, 1)]])
    stream = snapshots.read_snapshot_stream(spark, path, max_files=1)
    stream = stream.withColumn("ts", snapshots.day_timestamp(F.col("t")))
    rolled = snapshots.rolling_snapshot_agg(stream, "2 days", watermark="10 days")
    snapshots.sink_files(rolled, out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.schema(rolled.schema).parquet(out)
    assert sorted(r["n"] for r in got.collect()) == [1, 1, 1]


def test_file_sink_resumes_where_it_stopped(spark, table, tmp_path):
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    write(table, path, [[snap("a", 0, 1)]])
    for extra in ([snap("a", 1, 2)], [snap("b", 1, 2)]):
        snapshots.sink_files(snapshots.read_snapshot_stream(spark, path), out, cp).awaitTermination()
        write(table, path, [extra])
    snapshots.sink_files(snapshots.read_snapshot_stream(spark, path), out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_batch_writer_is_idempotent(spark, table, tmp_path):
    write_batch = snapshots.batch_writer(str(tmp_path))
    batch = table([snap("a", 0, 1), snap("b", 0, 2)], schemas.SNAPSHOT)
    for batch_id in (0, 0, 1):
        write_batch(batch, batch_id)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 4
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4
    assert sorted(os.listdir(tmp_path / "csv")) == ["batch_id=0", "batch_id=1"]


def test_snapshot_rows(spark):
    rows = spark.range(120).select(F.col("id").alias("step"), (F.col("id") % 33 == 0).alias("last"))
    assert [r["step"] for r in snapshots.snapshot_rows(rows).collect()] == [0, 50, 100]
    due = {r["step"] for r in snapshots.snapshot_rows(rows, 50, "last").collect()}
    assert due == {0, 33, 50, 66, 99, 100}
