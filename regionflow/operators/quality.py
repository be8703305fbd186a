"""Checks that return the offending rows; `require_empty` turns them into an error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from regionflow.session import fresh_path


def state_mass(state: str = "") -> Column:
    """All five compartments, rounded, as BIGINT."""
    p = f"{state}." if state else ""
    return F.floor(sum((F.col(f"{p}{c}") for c in "irdv"), F.col(f"{p}s")) + F.lit(0.5)).cast("bigint")


def check_state(states: DataFrame, pop: str = "pop") -> DataFrame:
    """States below 0, with another mass than `pop`, or with t outside [0, t_max]."""
    negative = F.least(*[F.col(c) for c in "sirdv"]) < 0
    outside = (F.col("t") < 0) | (F.col("t") > F.col("t_max"))
    reason = (
        F.when(negative, F.lit("negative compartment"))
        .when(state_mass() != F.col(pop), F.lit("mass not conserved"))
        .when(outside, F.lit("t out of bounds"))
    )
    return states.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def check_local_mass(transitions: DataFrame, before: str = "s", after: str = "s2") -> DataFrame:
    """Rows whose state mass changes, with the change."""
    return transitions.withColumn("mass_change", state_mass(after) - state_mass(before)).filter(
        F.col("mass_change") != 0
    )


def check_global_mass(before: DataFrame, after: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scenarios whose total mass differs: one grouping over both tables."""
    signed = before.select(*by, (-state_mass()).alias("mass")).unionByName(
        after.select(*by, state_mass().alias("mass"))
    )
    return (
        signed.groupBy(*by)
        .agg(F.sum("mass").alias("mass_change"))
        .filter(F.col("mass_change") != 0)
    )


def check_edges(edges: DataFrame, cap: float = 0.12, slack: float = 1e-12) -> DataFrame:
    """Sources with a diagonal weight or a weight sum above the cap."""
    diagonal = F.when(F.col("src") == F.col("dst"), F.abs("w")).otherwise(F.lit(0.0))
    return (
        edges.groupBy("src")
        .agg(F.sum("w").alias("row_sum"), F.max(diagonal).alias("diagonal"))
        .filter((F.col("diagonal") != 0) | (F.col("row_sum") > cap + slack))
    )


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that occur more often in `a` (surplus > 0) or in `b` (surplus < 0)."""
    columns = ["`" + c.replace("`", "``") + "`" for c in a.columns]
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    return (
        both.groupBy(*columns).agg(F.sum("_n").alias("surplus")).filter(F.col("surplus") != 0)
    )


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return row_differences(a, b).isEmpty()


def check_finite(df: DataFrame, column: str = "loss") -> DataFrame:
    """Rows whose value is null, NaN or infinite."""
    x = F.col(column)
    return df.filter(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def require_empty(violations: DataFrame, message: str) -> None:
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"{message}: {first[0].asDict(recursive=True)}")


@dataclass(frozen=True)
class Checked:
    """The rows that pass, the others with their `reasons`, and how many rows there were and fail each check."""

    rows: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


def split_rows(rows: DataFrame, checks: Mapping[str, Column], clean: Mapping[str, Column] | None = None) -> Checked:
    """Rows checked in one pass over their source; a check that holds is a reason to reject a row.

    `clean` adds or replaces columns of the rows that pass; rejects stay as they were
    read. Both go to one table in the shared folder, and the counts (`rows`,
    `rejected` and each check) are gathered while it is written.
    """
    spark, seen = rows.sparkSession, Observation()
    reasons = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda r: r.isNotNull())
    marked = rows.withColumn("reasons", reasons).withColumn("rejected", F.size("reasons") > 0)
    each = [F.count_if(F.array_contains("reasons", name)).alias(name) for name in checks]
    observed = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("rejected").alias("rejected"), *each)
    path = fresh_path(spark, "checked")
    observed.write.partitionBy("rejected").parquet(path)
    table = spark.read.schema(marked.schema).parquet(path)
    passed = table.filter("NOT rejected").select(*rows.columns).withColumns(dict(clean or {}))
    return Checked(passed, table.filter("rejected").drop("rejected"), dict(seen.get))
