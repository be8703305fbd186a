"""Queries over stored forms of the tables: layouts, logs that grow, checked sources, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.operators import digest, network, series
from regionflow.plans import views as V
from regionflow.plans.registry import query, rounded, rounded_small, table
from regionflow.plans.series_queries import HORIZON, REPORT_SQL, THRESH, report_population
from regionflow.session import fresh_path
from regionflow.sources import layout, metric_store, observations

BUCKETS = 8


@query("report_on_layout", REPORT_SQL)
def report_on_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`region_report` over series and populations stored by entity: no exchange by entity is left."""
    daily = layout.read_layout(spark, layout.write_layout(V.daily(spark, sf_dir, "user_id"), BUCKETS))
    people = layout.read_layout(spark, layout.write_layout(report_population(spark, sf_dir), BUCKETS, order=["pop"]))
    days = series.longest(daily, HORIZON)
    report = series.region_metrics(series.first_n_padded(daily, days), people, thresh=THRESH, thresh_n=0.05)
    seen = daily.groupBy("entity").agg(F.count("*").alias("n_days"))
    named = report.withColumn("days", days).join(seen, "entity")
    return rounded(rounded(named, 4, "peak", "final"), 6, "peak_n")


_LATEST = """
    WITH w AS (SELECT concat('run', event_id % 3) AS run, CAST(floor(event_id / 10e0) AS BIGINT) AS step, event_type AS key, value,
        event_id AS seq, CAST(event_id * 7 % 5 AS BIGINT) AS append FROM events)
    SELECT run, step, key, arg_max(value, (append, seq)) AS value FROM w {} GROUP BY run, step, key
"""


def _appended(spark: SparkSession, sf_dir: str) -> str:
    """The metric log in five appends, each over all its runs and steps."""
    path, log = fresh_path(spark, "metrics"), V.metric_log(spark, sf_dir)
    for k in range(5):
        metric_store.append(log.filter(F.col("seq") * 7 % 5 == k), path)
    return path


@query("latest_metrics", _LATEST.format(""))
def latest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of every key over five appends, the first three of them compacted."""
    path, log = fresh_path(spark, "metrics"), V.metric_log(spark, sf_dir)
    for k in range(5):
        metric_store.append(log.filter(F.col("seq") * 7 % 5 == k), path)
        if k == 2:
            metric_store.compact(spark, path)
    return metric_store.read_latest(spark, path).select("run", "step", "key", "value")


@query("latest_metrics_of_steps", _LATEST.format("WHERE run = 'run1' AND step BETWEEN 100 AND 180"))
def latest_metrics_of_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some steps of one run: files that cannot hold them are not opened."""
    return metric_store.read_latest(spark, _appended(spark, sf_dir), "run1", 100, 180).select("run", "step", "key", "value")


_BAD_DATE = "CASE WHEN event_id % 29 = 0 THEN 'soon' ELSE CAST(CAST(ts AS DATE) AS STRING) END"
_BAD_PLACE = "CASE WHEN event_id % 31 = 0 THEN '  ' ELSE event_type END"
_BAD_NUMBER = "CASE WHEN event_id % 23 = 0 THEN 'n/a' WHEN event_id % 17 = 0 THEN '' ELSE CAST(value - 50e0 AS STRING) END"


@query(
    "checked_observations",
    """
    WITH e AS (SELECT event_id % 29 = 0 AS d, event_id % 31 = 0 AS p, event_id % 23 = 0 AS v, event_id % 37 = 0 AS l,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE value - 50e0 END AS x FROM events)
    SELECT 'kept' AS what, count(*) AS n, round(sum(x), 4) AS total FROM e WHERE NOT (d OR p OR v OR l)
    UNION ALL SELECT 'rejected', count(*), NULL FROM e WHERE d OR p OR v OR l
    UNION ALL SELECT 'no date', count(*), NULL FROM e WHERE d
    UNION ALL SELECT 'no location', count(*), NULL FROM e WHERE p
    UNION ALL SELECT 'no number', count(*), NULL FROM e WHERE v
    UNION ALL SELECT 'line of another length', count(*), NULL FROM e WHERE l
    """,
)
def checked_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with four kinds of bad lines: what is kept, what is rejected and why, from one pass."""
    path = fresh_path(spark, "bad-lines")
    rows = table(spark, sf_dir, "events").select(
        F.concat_ws(",", F.expr(_BAD_PLACE), F.expr(_BAD_DATE), F.expr(_BAD_NUMBER), F.when(F.col("event_id") % 37 == 0, "more"))
    )
    # whole lines as one column, cut by a character that they do not hold, so that commas stay as they are
    rows.toDF("location,date,new_cases").write.option("header", True).option("sep", "\x01").csv(path)
    found = observations.read_checked(spark, path)
    kept = found.rows.agg(F.lit("kept").alias("what"), F.count("*").alias("n"), F.sum("new_cases").alias("total"))
    why = found.rejects.select(F.explode("reasons").alias("what")).groupBy("what").agg(F.count("*").alias("n"))
    rest = found.rejects.agg(F.lit("rejected").alias("what"), F.count("*").alias("n")).unionByName(why)
    return rounded(kept.unionByName(rest.withColumn("total", F.lit(None).cast("double"))), 4, "total")


@query(
    "digest_differences",
    """
    SELECT event_id, event_type, value, CAST(sum(d) AS BIGINT) AS surplus FROM (
        SELECT event_id, event_type, value, 1 AS d FROM events
        UNION ALL SELECT event_id, event_type, CASE WHEN event_id = 77 THEN value + 1 ELSE value END, -1 FROM events WHERE event_id <> 500
        UNION ALL SELECT event_id, event_type, value, -1 FROM events WHERE event_id = 9)
    GROUP BY 1, 2, 3 HAVING sum(d) <> 0
    """,
)
def digest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events against events with a row changed, one left out and one twice."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    changed = F.when(F.col("event_id") == 77, F.col("value") + 1).otherwise(F.col("value"))
    other = events.filter("event_id <> 500").withColumn("value", changed).unionByName(events.filter("event_id = 9"))
    return digest.differences(events, other)


_PLACE = "CAST((c_custkey * 7919 % 18001) / 100e0 - 90 AS DOUBLE) AS lat, CAST((c_custkey * 104729 % 36000) / 100e0 - 180 AS DOUBLE) AS lon"


@query(
    "pairs_within",
    f"""
    WITH p AS (SELECT c_custkey AS id, {_PLACE} FROM customer),
    d AS (SELECT a.id AS src, b.id AS dst, pow(sin(radians(b.lat - a.lat) / 2), 2)
        + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM p a JOIN p b ON a.id < b.id)
    SELECT src, dst, round(12742.0 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km FROM d WHERE 12742.0 * atan2(sqrt(h), sqrt(1 - h)) <= 200
    """,
)
def pairs_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers at most 200 km apart, wherever on the globe they are put."""
    places = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *[F.expr(x) for x in _PLACE.split(", ")])
    return rounded_small(network.pairs_within(places, 200.0), 6, "km")
