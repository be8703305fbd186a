"""Tables stored by entity, so that series, first-n and average plans over them need no exchange."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from regionflow.session import fresh_path


def write_layout(df: DataFrame, buckets: int, keys: Sequence[str] = ("entity",), order: Sequence[str] = ("day",)) -> str:
    """Writes the rows bucketed by `keys` and sorted by (keys, order) to the shared folder; returns the table's name.

    The rows are dealt out by the keys once, here, so that a bucket is one file.
    Groupings, windows and joins by the keys then read the buckets as they are.
    Choose as many buckets as an entity's share of the largest table needs
    tasks; a single entity never spreads over more than one.
    """
    name = f"layout_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    writer = dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *order)
    writer.option("path", fresh_path(df.sparkSession, name)).saveAsTable(name)
    return name


def read_layout(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def drop_layout(spark: SparkSession, name: str) -> None:
    """Forgets the table; its files go with the program's folder."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
