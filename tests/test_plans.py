"""Longer series than the driver's, plan sizes, and what a run leaves behind."""

from __future__ import annotations

import datetime
import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from oracle import check, connect
from regionflow import session
from regionflow.functions.vectors import score_dense
from regionflow.operators.skew import stored
from regionflow.plans.catalog import catalog
from regionflow.sources import observations

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RUNS = catalog()
SERIES = [
    "series_metrics", "normalised_metrics", "rmse", "join_targets", "loss_surface", "best_cell", "param_grid",
    "surface_pivot", "surface_file", "ema_spread", "targets_or_default", "observed_targets", "calibrate_on_observed", "region_report", "cleaned_series",
]

needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def long_dir(tmp_path_factory):
    """The driver's tables with 720 days of events, values rising after day 600."""
    folder = tmp_path_factory.mktemp("long")
    for name in os.listdir(SF_DIR):
        if name != "events.parquet":
            os.symlink(f"{SF_DIR}/{name}", folder / name)
    start, rng = datetime.datetime(2024, 1, 1), random.Random(6)
    rows = []
    for n in range(720 * 10):
        day = n // 10
        value = round(rng.uniform(1, 90) + (day - 600) * 40.0 * (day > 600), 2)
        kind = ["view", "click", "purchase", "signup", "error"][n % 5]
        rows.append((n, start + datetime.timedelta(days=day, seconds=n % 10), n % 7, kind, value, "{}"))
    schema = pq.read_schema(f"{SF_DIR}/events.parquet")
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    pq.write_table(pa.table(columns, schema=schema), folder / "events.parquet")
    return str(folder)


@needs_tables
@pytest.mark.parametrize("name", SERIES)
def test_long_series(spark, long_dir, name):
    problem, n, *_ = check(spark, connect(long_dir), RUNS[name].run, RUNS[name].sql, long_dir)
    assert problem is None and n > 0


@needs_tables
def test_cleaned_series_is_ordered(spark):
    rows = [(r["entity"], r["day"]) for r in RUNS["cleaned_series"].run(spark, SF_DIR).collect()]
    assert rows == sorted(rows)


@pytest.fixture(scope="module")
def null_dir(tmp_path_factory):
    """Events without a type, without a time and without both, beside whole ones."""
    folder = tmp_path_factory.mktemp("nulls")
    for name in os.listdir(SF_DIR):
        if name != "events.parquet":
            os.symlink(f"{SF_DIR}/{name}", folder / name)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for n in range(240):
        kind = ["view", "click", None][n % 3]
        ts = None if n % 7 == 0 else start + datetime.timedelta(days=n % 30, seconds=n)
        rows.append((n, ts, n % 7, kind, 150.0 + n / 2, "{}"))
    schema = pq.read_schema(f"{SF_DIR}/events.parquet")
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    pq.write_table(pa.table(columns, schema=schema), folder / "events.parquet")
    return str(folder)


@needs_tables
@pytest.mark.parametrize("name", ["rolling_snapshot_agg", "stream_series_metrics"])
def test_streams_keep_null_types_and_times(spark, null_dir, name):
    problem, *_ = check(spark, connect(null_dir), RUNS[name].run, RUNS[name].sql, null_dir)
    assert problem is None
    rows = RUNS[name].run(spark, null_dir).collect()
    assert any(r["country"] is None for r in rows)


def plan_of(spark, name):
    return RUNS[name].run(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@needs_tables
@pytest.mark.parametrize("name, source, scans", [("flow_step", "orders", 0), ("gravity_edges", "customer", 0), ("apportion_columns", "orders", 1)])
def test_scans(spark, name, source, scans):
    """Queries that write what they read several times do not read the table again."""
    assert plan_of(spark, name).count(f"{source}.parquet") == scans


@needs_tables
@pytest.mark.parametrize("name, most", [("first_n_padded", 2), ("series_metrics", 2), ("flow_step", 8)])
def test_exchanges(spark, name, most):
    assert sum("Exchange hashpartitioning" in x for x in plan_of(spark, name).splitlines()) <= most


def test_scores_of_null_rows(spark):
    layers = [(np.array([[1.0, 2.0]]), np.array([0.5]))]
    rows = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "id INT, q ARRAY<DOUBLE>")
    got = {r["id"]: r["y"] for r in rows.select("id", score_dense(F.col("q"), layers).alias("y")).collect()}
    assert got == {1: [3.5], 2: None}
    bad = spark.createDataFrame([(1, [1.0])], "id INT, q ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="does not have 2 values"):
        bad.select(score_dense(F.col("q"), layers)).collect()


def test_only_a_missing_source_selects_the_defaults(spark, tmp_path):
    defaults = spark.range(1)
    spark.range(2).write.option("header", True).csv(str(tmp_path / "other"))
    for path in ("nowhere", "other"):
        read = lambda p=path: observations.read_observations(spark, str(tmp_path / p))
        assert observations.targets_or_default(read, defaults) is defaults
    with pytest.raises(Exception, match="no_such_column"):
        observations.targets_or_default(lambda: defaults.select("no_such_column"), defaults)


def test_nothing_is_left_behind(spark):
    rows = stored(spark.range(5), "left")
    folder = session.working_folder(spark)
    assert rows.count() == 5 and os.listdir(folder)
    session.release(spark)
    assert not os.path.exists(folder)
