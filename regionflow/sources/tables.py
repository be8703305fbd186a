"""In-memory rows, fixed tables, and batch sinks."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from regionflow import constants as K
from regionflow import schemas


def rows_to_df(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A typed table from a few driver rows (dimension tables only).

    Built through Arrow, so Catalyst knows its size and can broadcast it.
    """
    struct = schemas.parse(schema)
    names = [field.name for field in struct.fields]
    table = pa.Table.from_pylist(
        [dict(zip(names, row, strict=True)) for row in rows], schema=to_arrow_schema(struct)
    )
    return spark.createDataFrame(table, schema=struct)


def profiles(spark: SparkSession) -> DataFrame:
    return rows_to_df(spark, K.PROFILES, K.PROFILE_SCHEMA)


def world(spark: SparkSession) -> DataFrame:
    return rows_to_df(spark, K.WORLD, K.WORLD_SCHEMA)


def world_links(spark: SparkSession) -> DataFrame:
    """The 30 ordered pairs of the six fixed regions."""
    names = [row[1] for row in K.WORLD]
    pairs = [(a, b) for a in names for b in names if a != b]
    return rows_to_df(spark, pairs, "src STRING, dst STRING")


def pair_multipliers(spark: SparkSession) -> DataFrame:
    return rows_to_df(spark, K.PAIR_MULTIPLIERS, "src STRING, dst STRING, mul DOUBLE")


def actions(spark: SparkSession) -> DataFrame:
    return rows_to_df(
        spark, K.ACTIONS, "id INT, label STRING, stringency DOUBLE, base_cost DOUBLE"
    )


def name_aliases(spark: SparkSession) -> DataFrame:
    return rows_to_df(spark, K.NAME_ALIASES, "entity STRING, location STRING")


def default_targets(spark: SparkSession) -> DataFrame:
    return rows_to_df(spark, K.DEFAULT_TARGETS, schemas.TARGETS)


def run_multipliers(spark: SparkSession) -> DataFrame:
    return rows_to_df(
        spark, K.RUN_MULTIPLIERS, "entity STRING, run_beta DOUBLE, run_ifr DOUBLE, run_noise DOUBLE"
    )


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv_single(df: DataFrame, path: str) -> None:
    """One CSV file with a header: for summaries, as one task writes it.

    The rows are shuffled into that task, so what makes them stays spread out.
    """
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_both(df: DataFrame, parquet_path: str, csv_path: str) -> None:
    """Parquet and CSV from one evaluation.

    The CSV is written from the Parquet files, so a lost executor costs nothing
    already written. A failing write raises.
    """
    write_parquet(df, parquet_path)
    spark = df.sparkSession
    write_csv_single(spark.read.schema(df.schema).parquet(parquet_path), csv_path)


def read_surface(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SURFACE).option("header", True).csv(path)


def write_surface(surface: DataFrame, path: str) -> None:
    write_csv_single(surface.select("beta", "travel", "loss"), path)
