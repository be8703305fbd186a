"""Daily series per entity: names, order, padding and their summary metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow.functions.scalar import at_least_one, clean_value
from regionflow.operators.skew import first_per_key


def partition_by_entity(df: DataFrame, n: int, key: str = "entity") -> DataFrame:
    """Hash partitioning by entity.

    Only for writers that want it: grouping and windows add the exchange they
    need, and one entity always lands in one partition.
    """
    return df.repartition(n, key)


def map_entity_names(obs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Keep the locations that `aliases (entity, location)` lists, renamed."""
    return obs.join(aliases, "location").drop("location")


def select_cast(
    df: DataFrame, day: str = "date", value: str = "new_cases", out: str = "value"
) -> DataFrame:
    """Entity, day and a DOUBLE value; text that is no number becomes null."""
    return df.select(
        "entity",
        F.col(day).try_cast("date").alias("day"),
        F.col(value).try_cast("double").alias(out),
    )


def clean_series(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn(value, clean_value(F.col(value)))


def series_sort(df: DataFrame, key: str = "entity", day: str = "day") -> DataFrame:
    """Output order: entity, then date. A range exchange, never one task."""
    return df.orderBy(key, day)


def longest(series: DataFrame, least: int = 0, key: str = "entity") -> Column:
    """The rows of the entity that has most of them, and at least `least`; a scalar subquery."""
    counts = series.groupBy(key).agg(F.count("*").alias("_n"))
    return counts.agg(F.greatest(F.lit(least), F.max("_n")).cast("int").alias("n")).scalar()


def first_n_padded(
    series: DataFrame,
    n: int | Column,
    entities: DataFrame | None = None,
    key: str = "entity",
    day: str = "day",
    value: str = "value",
) -> DataFrame:
    """Exactly n positions per entity: the first n days, then zeros.

    `entities` adds entities without any row (all zeros). At most n values per
    entity are gathered, on the partitioning the ranking already made, so the
    padding needs neither a grid nor a further shuffle.
    """
    kept = first_per_key(series.select(key, day, value), [key], [day, value], n, "_rn")
    arrays = kept.groupBy(key).agg(F.collect_list(F.struct("_rn", value)).alias("_rows"))
    if entities is not None:
        arrays = entities.select(key).distinct().join(arrays, key, "left")
    values = F.coalesce(
        F.transform(F.sort_array("_rows"), lambda x: x[value]), F.array().cast("array<double>")
    )
    padded = F.concat(values, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(values)))
    return arrays.select(key, F.posexplode(padded).alias("t", "value"))


def arrival_time(value: Column, t: Column, thresh: float = 10.0) -> Column:
    """Aggregate: first position with value >= thresh, else the length."""
    hit = (value >= F.lit(thresh)) & ~F.isnan(value)
    return F.coalesce(F.min(F.when(hit, t.cast("bigint"))), F.count(F.lit(1))).cast("int")


def peak(value: Column) -> Column:
    """Aggregate: the largest value, 0 without rows."""
    return F.coalesce(F.max(value), F.lit(0.0))


def final_value(value: Column, t: Column) -> Column:
    """Aggregate: the value at the last position, 0 without rows."""
    return F.coalesce(F.max_by(value, t), F.lit(0.0))


def series_metrics(
    series: DataFrame, keys: Sequence[str] = ("entity",), thresh: float = 10.0
) -> DataFrame:
    """Arrival, peak and final value per key in one grouping."""
    v, t = F.col("value"), F.col("t")
    return series.groupBy(*keys).agg(
        arrival_time(v, t, thresh).alias("arrival"),
        peak(v).alias("peak"),
        final_value(v, t).alias("final"),
    )


def join_population(df: DataFrame, population: DataFrame, key: str = "entity") -> DataFrame:
    """Adds `pop` from `population (entity, pop)`; inner, as every entity has one."""
    return df.join(population.select(key, "pop"), key)


def normalised_metrics(
    series: DataFrame, population: DataFrame, key: str = "entity", thresh: float = 1e-4
) -> DataFrame:
    """Arrival and peak of value / population."""
    share = F.col("value") / at_least_one(F.col("pop").cast("double"))
    return (
        join_population(series, population, key)
        .withColumn("_share", share)
        .groupBy(key)
        .agg(
            arrival_time(F.col("_share"), F.col("t"), thresh).alias("arrival_n"),
            peak(F.col("_share")).alias("peak_n"),
        )
    )


def region_metrics(
    series: DataFrame,
    population: DataFrame,
    key: str = "entity",
    thresh: float = 10.0,
    thresh_n: float = 1e-4,
) -> DataFrame:
    """`series_metrics` and `normalised_metrics` together, in one pass over the series."""
    v, t = F.col("value"), F.col("t")
    share = v / at_least_one(F.col("pop").cast("double"))
    return (
        join_population(series, population, key)
        .groupBy(key)
        .agg(
            arrival_time(v, t, thresh).alias("arrival"),
            peak(v).alias("peak"),
            final_value(v, t).alias("final"),
            arrival_time(share, t, thresh_n).alias("arrival_n"),
            peak(share).alias("peak_n"),
        )
    )
