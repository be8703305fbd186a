"""Per-key work that stays spread out when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.session import fresh_path

def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rn"
) -> DataFrame:
    """The first `n` rows per key, with their rank from 1.

    For n up to spark.sql.optimizer.windowGroupLimitThreshold Spark cuts each
    task's rows to n per key before the shuffle, so a hot key reaches its final
    task with at most n rows per input task. `order` should leave no ties.
    """
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(place)).filter(F.col(rank) <= n)


def key_of(names: Sequence[str]) -> Column:
    """Key columns as one struct: equal structs have equal parts, nulls included, so it joins without losing rows."""
    return F.struct(*[F.col(n) for n in names])


def find_hot(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """The keys of groups above `hot_rows` rows, or None if there are none.

    Runs one counting job, combined before its shuffle.
    """
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    hot = stored(counted.select(*keys), "hot-keys")
    return None if hot.isEmpty() else hot


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: its lineage is cut."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
