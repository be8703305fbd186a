"""Observed case counts from CSV, and the targets made from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.operators.quality import Checked, split_rows
from regionflow.operators.series import (
    clean_series,
    first_n_padded,
    longest,
    map_entity_names,
    select_cast,
    series_metrics,
)


COLUMNS = ("location", "date", "new_cases")
NO_SOURCE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class MissingColumn(ValueError):
    """The source lacks a column that observations need."""


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Location, date and new cases from a CSV with a header.

    Columns are picked by header name and cast, without an inference pass;
    values that do not parse become null.
    """
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in COLUMNS if c not in raw.columns]
    if missing:
        raise MissingColumn(f"{path} has no column {', '.join(missing)}")
    return raw.select(
        "location",
        F.col("date").try_cast("date").alias("date"),
        F.col("new_cases").try_cast("double").alias("new_cases"),
    )


def read_checked(spark: SparkSession, path: str) -> Checked:
    """`read_observations`, with the lines that cannot be read set aside and counted in the same pass.

    Reasons: a line of another length than the header, no location, a date or a
    value that is not one. An empty value is a gap, as before, and no reason.
    """
    header = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in COLUMNS if c not in header]:
        raise MissingColumn(f"{path} has no column {', '.join(missing)}")
    schema = ", ".join(f"`{c}` string" for c in [*header, "_line"])
    raw = spark.read.option("header", True).option("columnNameOfCorruptRecord", "_line").option("columnPruning", False).schema(schema).csv(path)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    place, date, value = (F.col(c) for c in COLUMNS)
    checks = {
        "line of another length": F.col("_line").isNotNull(),
        "no location": blank(place),
        "no date": date.try_cast("date").isNull(),
        "no number": ~blank(value) & value.try_cast("double").isNull(),
    }
    clean = {"date": date.try_cast("date"), "new_cases": value.try_cast("double")}
    found = split_rows(raw.select(*COLUMNS, "_line"), checks, clean)
    return Checked(found.rows.drop("_line"), found.rejects, found.counts)


def observed_series(obs: DataFrame, aliases: DataFrame, least: int = 0) -> DataFrame:
    """Cleaned and ordered series of the aliased entities, whole, all padded to the longest and at least to `least`."""
    named = clean_series(select_cast(map_entity_names(obs, aliases)))
    return first_n_padded(named, longest(named, least), entities=aliases)


def observed_targets(series: DataFrame, thresh: float = 10.0) -> DataFrame:
    """Arrival and peak of observed series as calibration targets."""
    return series_metrics(series, thresh=thresh).select(
        "entity", F.col("arrival").cast("double").alias("t_arrive"), "peak"
    )


def targets_or_default(observed: Callable[[], DataFrame], defaults: DataFrame) -> DataFrame:
    """Observed targets, or `defaults` as a whole when the source cannot be read.

    Only the planning is tried, and only a missing path or a source without one
    of its columns selects the defaults; any other error is raised, and a task
    that fails later still fails the job.
    """
    try:
        table = observed()
        table.schema  # noqa: B018 - resolves the plan
        return table
    except (AnalysisException, MissingColumn) as error:
        if isinstance(error, MissingColumn) or error.getCondition() in NO_SOURCE:
            return defaults
        raise
