"""Where queries over the driver tables register, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounds the columns; adding 0 turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def rounded_small(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """`rounded` for many numbers: those that are small and no near tie are rounded without decimals, to the same."""
    scale = F.lit(10.0**digits)

    def near(c: str) -> Column:
        n = F.col(c) * scale
        plain = (F.abs(n) < 1e9) & (F.abs(n - F.floor(n) - 0.5) > 1e-6)
        return F.when(plain, F.floor(n + 0.5) / scale).otherwise(F.round(F.col(c), digits))

    return df.withColumns({c: near(c) + F.lit(0.0) for c in columns})
