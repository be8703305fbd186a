"""Snapshots written by a run, and the streams that read them."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regionflow import schemas
from regionflow.operators.series import arrival_time, peak
from regionflow.operators.summary import downsample_every
from regionflow.streaming.stateful import open_state

EPOCH_START = "2020-01-01 00:00:00"
_SUMS = ("first_hit", "n", "peak", "total", "n_values")


def snapshot_rows(rows: DataFrame, every: int = 50, last_step: str | None = None) -> DataFrame:
    """The steps a run takes snapshots at: every `every`-th, and each epoch's last."""
    due = F.col("step") % every == 0
    return downsample_every(rows, every) if last_step is None else rows.filter(due | F.col(last_step))


def write_snapshot(snapshots: DataFrame, path: str) -> None:
    """Append snapshot rows; the files feed `read_snapshot_stream`."""
    snapshots.write.mode("append").parquet(path)


def read_snapshot_stream(
    spark: SparkSession,
    path: str,
    schema: str = schemas.SNAPSHOT,
    max_files: int | None = None,
) -> DataFrame:
    """New snapshot files as a stream, with a given schema."""
    reader = spark.readStream.schema(schemas.parse(schema))
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def day_timestamp(t: Column, start: str = EPOCH_START) -> Column:
    """A whole-number day as a TIMESTAMP, so that windows and watermarks apply."""
    return F.timestamp_add("DAY", t, F.lit(start).cast("timestamp"))


def rolling_snapshot_agg(
    stream: DataFrame,
    window: str = "7 days",
    slide: str | None = None,
    watermark: str | None = None,
    key: str = "country",
    ts: str = "ts",
    value: str = "i",
) -> DataFrame:
    """Count, mean, peak and sum per country and sliding window.

    Append mode needs a `watermark`, which must be at least as long as the
    files are out of order: rows later than that are dropped by Spark.
    """
    rows = stream if watermark is None else stream.withWatermark(ts, watermark)
    span = F.window(ts, window) if slide is None else F.window(ts, window, slide)
    return (
        rows.groupBy(span.alias("window"), key)
        .agg(
            F.count("*").alias("n"),
            F.avg(value).alias("mean_value"),
            F.max(value).alias("peak"),
            F.sum(value).alias("total"),
        )
        .select(F.col("window.start").alias("start"), key, "n", "mean_value", "peak", "total")
    )


def stream_series_metrics(
    stream: DataFrame, key: str = "country", t: str = "t", value: str = "i", thresh: float = 10.0
) -> DataFrame:
    """Running arrival and peak per country; for update or complete mode."""
    return stream.groupBy(key).agg(
        arrival_time(F.col(value), F.col(t), thresh).alias("arrival"),
        peak(F.col(value)).alias("peak"),
    )


def series_partials(
    stream: DataFrame, watermark: str, key: str = "country", t: str = "t", value: str = "i",
    ts: str = "ts", thresh: float = 10.0,
) -> DataFrame:
    """First hit, counts, peak and sum per country and day, for append mode.

    `merge_partials` and `rolling_from_days` put them together. Days that are still
    open come from `open_partials`. A row without a time has no day that could
    close: it is a partial of its own, with a null start.
    """
    x = F.col(value).cast("double")
    hit = (x >= F.lit(thresh)) & ~F.isnan(x)
    first_hit = F.when(hit, F.col(t).cast("bigint"))
    days = (
        stream.withWatermark(ts, watermark)
        .groupBy(F.window(ts, "1 day").alias("window"), key)
        .agg(
            F.min(first_hit).alias("first_hit"),
            F.count("*").alias("n"),
            F.max(x).alias("peak"),
            F.sum(x).alias("total"),
            F.count(x).alias("n_values"),
        )
        .select(F.col("window.start").alias("start"), key, *_SUMS)
    )
    untimed = stream.filter(F.col(ts).isNull()).select(
        F.lit(None).cast("timestamp").alias("start"),
        key,
        first_hit.alias("first_hit"),
        F.lit(1).cast("bigint").alias("n"),
        x.alias("peak"),
        x.alias("total"),
        F.when(x.isNotNull(), 1).otherwise(0).cast("bigint").alias("n_values"),
    )
    return days.unionByName(untimed)


def open_partials(spark: SparkSession, checkpoint: str, key: str = "country") -> DataFrame:
    """The days of `series_partials` that its stream has not closed, from the state of its last finished batch.

    Together with the stream's files they hold every row that it has read: a day
    leaves the state in the batch that writes it.
    """
    kinds = "struct<first_hit:bigint,n:bigint,peak:double,total:double,n_values:bigint>"
    state = open_state(spark, checkpoint)
    # the state's parts are the aggregates of `series_partials` in their order
    return state.select(F.col("key.window.start").alias("start"), F.col("key")[key].alias(key), F.col("value").cast(kinds).alias("v")).select(
        "start", key, "v.*"
    )


def rolling_from_days(partials: DataFrame, days: int = 7, key: str = "country") -> DataFrame:
    """`rolling_snapshot_agg` over windows of whole days that slide by one, from the partials of days.

    A partial goes to each of the windows that hold its day; one without a day to
    as many, whose start is null. `start` is a date.
    """
    back = F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("_back")
    spread = partials.groupBy(F.to_date("start").alias("day"), key).agg(
        F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.max("peak").alias("peak"), F.sum("total").alias("total")
    ).select("*", back)
    return (
        spread.groupBy(F.date_sub("day", F.col("_back")).alias("start"), key)
        .agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("n_values")).alias("mean_value"), F.max("peak").alias("peak"), F.sum("total").alias("total"))
    )


def merge_partials(partials: DataFrame, key: str = "country") -> DataFrame:
    """Arrival and peak per country, as `stream_series_metrics` has them, from the partials of all days."""
    return partials.groupBy(key).agg(
        F.coalesce(F.min("first_hit"), F.sum("n")).cast("int").alias("arrival"),
        F.coalesce(F.max("peak"), F.lit(0.0)).alias("peak"),
    )


def sink_files(
    stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True
) -> StreamingQuery:
    """Append-mode Parquet or CSV files, each batch exactly once."""
    writer = (
        stream.writeStream.outputMode("append")
        .format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if fmt == "csv":
        writer = writer.option("header", True)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def batch_writer(path: str, formats: Sequence[str] = ("parquet", "csv")) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: one folder per batch id, overwritten on a retry.

    The batch is computed once: further formats are written from the first.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        source = batch
        for fmt in formats:
            target = os.path.join(path, fmt, f"batch_id={batch_id}")
            source.write.mode("overwrite").option("header", True).format(fmt).save(target)
            if source is batch:
                reader = batch.sparkSession.read.schema(batch.schema).option("header", True)
                source = reader.format(fmt).load(target)

    return write


def sink_each_batch(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    output_mode: str = "update",
    formats: Sequence[str] = ("parquet", "csv"),
    available_now: bool = True,
) -> StreamingQuery:
    """Any output mode to Parquet and CSV folders through foreachBatch."""
    writer = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(batch_writer(path, formats))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def sink_memory(
    stream: DataFrame, name: str, checkpoint: str, output_mode: str = "complete"
) -> StreamingQuery:
    """A driver-side table: for results that are small by design, such as one row per country."""
    return (
        stream.writeStream.outputMode(output_mode)
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
