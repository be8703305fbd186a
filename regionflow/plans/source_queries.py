"""Queries that write a source's files from the driver tables and read them back."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.operators.summary import epoch_entity_summary
from regionflow.plans import views as V
from regionflow.plans.registry import query, rounded, table
from regionflow.plans.series_queries import EPOCH_ENTITY_SQL, SURFACE_SQL, surface
from regionflow.operators import calibrate
from regionflow.session import fresh_path
from regionflow.sources import metric_log, observations, tables

BAD_VALUE = "CASE WHEN event_id % 23 = 0 THEN 'n/a' WHEN event_id % 17 = 0 THEN '' ELSE CAST(value - 50e0 AS STRING) END"


def _write_observations(spark: SparkSession, sf_dir: str) -> str:
    """Events as an observations CSV, wanted columns neither first nor in order."""
    path = fresh_path(spark, "observations")
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.expr(BAD_VALUE).alias("new_cases"),
        F.lit("x").alias("continent"),
        F.col("event_type").alias("location"),
        F.to_date("ts").alias("date"),
    )
    rows.write.option("header", True).csv(path)
    return path


_READ = (
    "SELECT event_type AS location, CAST(ts AS DATE) AS day, "
    "CASE WHEN event_id % 23 = 0 OR event_id % 17 = 0 THEN NULL ELSE value - 50e0 END AS value FROM events"
)


@query(
    "read_observations",
    f"SELECT location, CAST(day AS VARCHAR) AS day, count(*) AS n, count(value) AS n_value, round(sum(value), 4) AS total "
    f"FROM ({_READ}) GROUP BY 1, 2",
)
def read_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations.read_observations(spark, _write_observations(spark, sf_dir))
    out = obs.groupBy("location", F.col("date").cast("string").alias("day")).agg(
        F.count("*").alias("n"), F.count("new_cases").alias("n_value"), F.sum("new_cases").alias("total")
    )
    return rounded(out, 4, "total")


def _one_a_day(spark: SparkSession, sf_dir: str) -> str:
    """Daily totals as an observations CSV: one row per location and day."""
    path = fresh_path(spark, "daily")
    rows = V.daily(spark, sf_dir).select(
        F.col("value").alias("new_cases"), F.col("day").alias("date"), F.col("entity").alias("location")
    )
    rows.write.option("header", True).csv(path)
    return path


_ALIASES = [("Views", "view"), ("Clicks", "click"), ("Nowhere", "nowhere")]
_NAMES = "(VALUES ('Views', 'view'), ('Clicks', 'click'), ('Nowhere', 'nowhere')) n(entity, location)"
#: CTE `p` over `s`: the aliased entities' series, padded to the longest of them and to at least 35 days.
_OBSERVED = f"""
    d AS (SELECT unnest(range((SELECT greatest(35, max(n)) FROM (
            SELECT count(*) AS n FROM s JOIN {_NAMES} ON s.entity = n.location GROUP BY location)))) AS t),
    p AS (SELECT n.entity, d.t, coalesce(s.value, 0) AS value
        FROM {_NAMES} CROSS JOIN d LEFT JOIN s ON s.entity = n.location AND s.t = d.t)"""


@query(
    "observed_targets",
    f"""
    WITH s AS ({V.SERIES_SQL}), {_OBSERVED}
    SELECT entity, CAST(coalesce(min(CASE WHEN value >= 4000 THEN t END), count(*)) AS DOUBLE) AS t_arrive,
    round(max(value), 4) AS peak FROM p GROUP BY entity
    """,
)
def observed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File to targets; an aliased entity without rows is all zeros."""
    aliases = tables.rows_to_df(spark, _ALIASES, "entity STRING, location STRING")
    path = _one_a_day(spark, sf_dir)

    def observed() -> DataFrame:
        obs = observations.read_observations(spark, path)
        return observations.observed_targets(observations.observed_series(obs, aliases, least=35), 4000.0)

    targets = observations.targets_or_default(observed, V.targets(spark, sf_dir))
    return rounded(targets, 4, "peak")


_CALIBRATED = f"""
    WITH s AS ({V.SERIES_SQL}), {_OBSERVED},
    goal AS (SELECT entity, coalesce(min(CASE WHEN value >= 4000 THEN t END), count(*)) AS t_arrive, max(value) AS peak
        FROM p GROUP BY entity),
    m AS (SELECT beta, travel, CASE entity WHEN 'view' THEN 'Views' WHEN 'click' THEN 'Clicks' ELSE entity END AS entity,
        coalesce(min(CASE WHEN value >= 4000 THEN t END), count(*)) AS arrival, max(value) AS peak
        FROM ({V.TRAJECTORY_SQL}) GROUP BY 1, 2, 3),
    r AS (SELECT beta, travel, arrival - coalesce(g.t_arrive, arrival) AS a, m.peak - coalesce(g.peak, m.peak) AS b
        FROM m LEFT JOIN goal g ON g.entity = m.entity),
    surface AS (SELECT beta, travel, 0.5 * sqrt(avg(a * a)) + 0.5 * sqrt(avg(b * b)) AS loss FROM r GROUP BY beta, travel)
    SELECT g.beta, g.travel, round(loss, 4) AS loss FROM surface s JOIN ({V.GRID_SQL}) g ON g.beta = s.beta AND g.travel = s.travel
    ORDER BY s.loss, grid_pos LIMIT 1
"""


@query("calibrate_on_observed", _CALIBRATED)
def calibrate_on_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations file to targets, the grid's runs against them, and the best cell."""
    aliases = tables.rows_to_df(spark, _ALIASES, "entity STRING, location STRING")
    obs = observations.read_observations(spark, _one_a_day(spark, sf_dir))
    goals = observations.observed_targets(observations.observed_series(obs, aliases, least=35), 4000.0)
    names = F.when(F.col("entity") == "view", "Views").when(F.col("entity") == "click", "Clicks").otherwise(F.col("entity"))
    runs = V.trajectories(spark, sf_dir).withColumn("entity", names)
    losses = calibrate.loss_surface(runs, goals, thresh=4000.0)
    return rounded(calibrate.best_cell(losses, calibrate.param_grid(spark)), 4, "loss")


@query("targets_or_default", f"SELECT entity, t_arrive, round(peak, 4) AS peak FROM ({V.TARGET_SQL})")
def targets_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file is missing, so the default targets are used as a whole."""
    missing = fresh_path(spark, "missing")
    targets = observations.targets_or_default(
        lambda: observations.read_observations(spark, missing), V.targets(spark, sf_dir)
    )
    return rounded(targets, 4, "peak")


@query(
    "rows_to_df",
    f"SELECT CAST(greatest(0, least(7, a)) AS INTEGER) AS id, CASE greatest(0, least(7, a)) WHEN 0 THEN 'None' "
    "WHEN 1 THEN 'Distancing' WHEN 2 THEN 'TravelBan' WHEN 3 THEN 'Lockdown' WHEN 4 THEN 'NormalCare' "
    "WHEN 5 THEN 'SurgeCare' WHEN 6 THEN 'TargetedVax' ELSE 'MassVax' END AS label, count(*) AS n "
    f"FROM ({V.STATE_SQL}) GROUP BY 1, 2",
)
def rows_to_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per action, named by the in-memory action table."""
    ids = F.greatest(F.lit(0), F.least(F.lit(7), F.col("a"))).alias("id")
    counts = V.states(spark, sf_dir).groupBy(ids).agg(F.count("*").alias("n"))
    return tables.actions(spark).select("id", "label").join(counts, "id")


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(epoch_entity_summary(V.steps(spark, sf_dir)), 6, "avg_reward", "epsilon")


@query("write_parquet", EPOCH_ENTITY_SQL)
def write_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "summary")
    tables.write_parquet(_summary(spark, sf_dir), path, ["epoch"])
    return spark.read.parquet(path)


@query("write_csv_single", f"SELECT *, CAST(1 AS BIGINT) AS n_files FROM ({EPOCH_ENTITY_SQL})")
def write_csv_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file holds all rows; the file count is read with them."""
    path = fresh_path(spark, "summary")
    rows = _summary(spark, sf_dir)
    tables.write_csv_single(rows, path)
    back = spark.read.schema(rows.schema).option("header", True).csv(path)
    n_files = back.agg(F.count_distinct(F.col("_metadata.file_path"))).scalar()
    return back.withColumn("n_files", n_files)


@query(
    "write_both",
    f"SELECT 'parquet' AS sink, * FROM ({EPOCH_ENTITY_SQL}) UNION ALL SELECT 'csv', * FROM ({EPOCH_ENTITY_SQL})",
)
def write_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _summary(spark, sf_dir)
    parquet, csv = fresh_path(spark, "both"), fresh_path(spark, "both")
    tables.write_both(rows, parquet, csv)
    a = spark.read.parquet(parquet).withColumn("sink", F.lit("parquet"))
    b = spark.read.schema(rows.schema).option("header", True).csv(csv).withColumn("sink", F.lit("csv"))
    return a.unionByName(b)


@query("surface_file", SURFACE_SQL)
def surface_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loss surface written to CSV and read again."""
    path = fresh_path(spark, "surface")
    tables.write_surface(surface(spark, sf_dir), path)
    return rounded(tables.read_surface(spark, path), 4, "loss")


@query(
    "append_metric_log",
    f"SELECT run, count(*) AS n, count(DISTINCT step) AS n_steps, round(sum(value), 4) AS total FROM ({V.METRIC_SQL}) GROUP BY run",
)
def append_metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to one log."""
    path = fresh_path(spark, "metrics")
    log = V.metric_log(spark, sf_dir)
    metric_log.append_metric_log(log.filter("seq % 2 = 0"), path)
    metric_log.append_metric_log(log.filter("seq % 2 = 1"), path)
    out = metric_log.read_metric_log(spark, path).groupBy("run").agg(
        F.count("*").alias("n"), F.count_distinct("step").alias("n_steps"), F.sum("value").alias("total")
    )
    return rounded(out, 4, "total")


LOGS = 32
_RAGGED = """
    CASE WHEN event_id % 5 = 4 THEN concat_ws(',', event_id + 1000000, value, event_id % 50, 0.5, user_id)
         WHEN event_id % 5 = 3 THEN concat_ws(',', event_id + 1000000, event_id % 8, value)
         ELSE concat_ws(',', event_id + 1000000, 0.25, value, event_id % 100) END
"""


def _write_ragged(spark: SparkSession, sf_dir: str) -> str:
    """Events as a fixed number of headerless logs of three line shapes, one file each."""
    path = fresh_path(spark, "ragged")
    lines = table(spark, sf_dir, "events").select(
        (F.col("user_id") % LOGS).alias("log"), "event_id", F.expr(_RAGGED).alias("line")
    )
    (
        lines.repartition(LOGS, "log")
        .sortWithinPartitions("log", "event_id")
        .select("log", "line")
        .write.partitionBy("log")
        .text(path)
    )
    return os.path.join(path, "*")


@query(
    "read_ragged_metrics",
    """
    SELECT event_id + 1000000 AS ts_ms, 'steps' AS shape, 0.25e0 AS a, value AS b, CAST(event_id % 100 AS DOUBLE) AS c, NULL::DOUBLE AS d
    FROM events WHERE event_id % 5 < 3
    UNION ALL SELECT event_id + 1000000, 'epochs', value, event_id % 50, 0.5, user_id FROM events WHERE event_id % 5 = 4
    UNION ALL SELECT event_id + 1000000, 'evals', event_id % 8, value, NULL, NULL FROM events WHERE event_id % 5 = 3
    """,
)
def read_ragged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = metric_log.read_ragged_metrics(spark, _write_ragged(spark, sf_dir))
    out = None
    for shape, (_, names) in metric_log.LOG_SHAPES.items():
        values = [F.col(c) for c in names] + [F.lit(None).cast("double")] * (4 - len(names))
        rows = parts[shape].select(
            "ts_ms", F.lit(shape).alias("shape"), *[v.alias(n) for v, n in zip(values, "abcd", strict=True)]
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "run_ids",
    f"SELECT event_id + 1000000 AS ts_ms, CAST(sum(CASE WHEN event_id % 5 < 3 AND event_id % 100 = 0 THEN 1 ELSE 0 END) "
    f"OVER (PARTITION BY user_id % {LOGS} ORDER BY event_id) AS BIGINT) AS run FROM events",
)
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = metric_log.read_ragged_lines(spark, _write_ragged(spark, sf_dir))
    return metric_log.run_ids(lines).select(F.col("fields")[0].cast("bigint").alias("ts_ms"), "run")
