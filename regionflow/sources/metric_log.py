"""Metric logs: long tables that grow by appending, and headerless text logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.operators.scan import running_total

LOG_SHAPES = {
    "steps": (4, ["eps", "loss", "step"]),
    "epochs": (5, ["avg_loss", "epoch", "epsilon", "reward"]),
    "evals": (3, ["action", "qmax"]),
}


def append_metric_log(log: DataFrame, path: str) -> None:
    """Append (run, step, key, value, seq) rows, one folder per run."""
    log.write.mode("append").partitionBy("run").parquet(path)


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_ragged_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text logs as fields, with their place in the file.

    `block` is the byte offset of the piece a task read and `line` rises within
    it, so (file, block, line) is the order of the lines in the file.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.split("value", ",").alias("fields"),
    )


def _number(k: int) -> Column:
    return F.get("fields", F.lit(k)).try_cast("double")


def ragged_shape(lines: DataFrame, shape: str) -> DataFrame:
    """The typed rows of one shape: 'steps', 'epochs' or 'evals'."""
    width, names = LOG_SHAPES[shape]
    typed = [_number(k + 1).alias(name) for k, name in enumerate(names)]
    return lines.filter(F.size("fields") == width).select(
        "file", "block", "line", _number(0).cast("bigint").alias("ts_ms"), *typed
    )


def read_ragged_metrics(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Three typed tables from one headerless log of three line shapes."""
    lines = read_ragged_lines(spark, path)
    return {shape: ragged_shape(lines, shape) for shape in LOG_SHAPES}


def run_ids(lines: DataFrame) -> DataFrame:
    """Adds `run`: how many step-0 lines the file holds up to this line.

    The count runs within each block; block totals give the blocks their start.
    """
    starts = (F.size("fields") == LOG_SHAPES["steps"][0]) & (_number(3) == 0)
    marked = lines.withColumn("_start_line", F.when(starts, 1).otherwise(0).cast("bigint"))
    return running_total(marked, ["file"], "block", ["line"], "_start_line", "run").drop(
        "_start_line"
    )
