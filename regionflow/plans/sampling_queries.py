"""Replay-table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.functions import scalar as S
from regionflow.operators import sampling, sum_tree
from regionflow.plans import views as V
from regionflow.plans.registry import query, rounded, table
from regionflow.session import fresh_path


@query("keep_last_n", "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 5000")
def keep_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffer of 5,000 slots after all events have been pushed."""
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    return sampling.keep_last_n(rows, 5000, "event_id", chunk=3000)


@query(
    "keep_last_n_by_key",
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) "
    "WHERE n <= 50",
)
def keep_last_n_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id")
    return sampling.keep_last_n(rows, 50, "event_id", ["user_id"])


@query(
    "keep_last_n_null_keys",
    "WITH x AS (SELECT CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS user_id, event_id FROM events) "
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM x) "
    "WHERE n <= 50",
)
def keep_last_n_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without a user share a buffer."""
    user = F.when(F.col("event_id") % 17 != 0, F.col("user_id")).alias("user_id")
    rows = table(spark, sf_dir, "events").select(user, "event_id")
    return sampling.keep_last_n(rows, 50, "event_id", ["user_id"])


@query(
    "keep_last_transitions",
    f"SELECT k, a, r, s2_i FROM (SELECT k, a, i_2 - i AS r, i_2 AS s2_i, row_number() OVER (PARTITION BY entity ORDER BY k DESC) "
    f"AS n FROM ({V.STATE_SQL})) WHERE n <= 4",
)
def keep_last_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A four-slot buffer of transitions per nation."""
    rows = V.transitions(spark, sf_dir).select(
        "entity", "k", "a", (F.col("s2.i") - F.col("s.i")).alias("r"), F.col("s2.i").alias("s2_i")
    )
    return sampling.keep_last_n(rows, 4, "k", ["entity"]).drop("entity")


@query("sample_n", "SELECT c_custkey, c_acctbal FROM customer ORDER BY md5(concat('123|', c_custkey)) LIMIT 512")
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return sampling.sample_n(rows, 512, 123, "c_custkey")


@query(
    "sample_n_events",
    "SELECT event_id FROM events ORDER BY md5(concat('7|', event_id)) LIMIT 4000",
)
def sample_n_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_n(table(spark, sf_dir, "events").select("event_id"), 4000, 7, "event_id")


_DRAW = "(c_custkey * 6180339887 % 10000000000) / 1e10"
_PRIO = "SELECT event_id, pow(abs(value - 100) + 1e-6, 0.6) AS p FROM events"


@query(
    "weighted_sample",
    f"""
    WITH p AS ({_PRIO}),
    c AS (SELECT event_id, p, sum(p) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cum FROM p),
    t AS (SELECT sum(p) AS total, count(*) AS n FROM p),
    d AS (SELECT c_custkey AS draw_id, {_DRAW} * total AS goal, total, n FROM customer, t
        QUALIFY row_number() OVER (ORDER BY c_custkey) <= n)
    SELECT draw_id, event_id, round(p, 6) AS p, round(pow(n * (p / total), -0.4), 6) AS weight
    FROM d ASOF JOIN c ON d.goal <= c.cum
    """,
)
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draw per customer from the events, by their priority."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") - 100).alias("td"))
    draws = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("draw_id"), F.expr(_DRAW).alias("u")
    )
    picked = sampling.weighted_sample(rows, draws, "event_id")
    return rounded(picked, 6, "p", "weight")


@query(
    "update_priorities",
    f"""
    WITH u AS (SELECT o_custkey AS event_id, arg_max(o_totalprice / 1000 - 250, o_orderkey) AS td FROM orders GROUP BY 1)
    SELECT p.event_id, round(CASE WHEN td IS NULL THEN p ELSE pow(abs(td) + 1e-6, 0.6) END, 6) AS p
    FROM ({_PRIO}) p LEFT JOIN u ON u.event_id = p.event_id
    """,
)
def update_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    prio = table(spark, sf_dir, "events").select(
        "event_id", S.priority(F.col("value") - 100).alias("p")
    )
    updates = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("event_id"),
        (F.col("o_totalprice") / 1000 - 250).alias("td"),
        F.col("o_orderkey").alias("seq"),
    )
    return rounded(sampling.update_priorities(prio, updates, "event_id"), 6, "p")


@query(
    "sum_tree_draws",
    f"""
    WITH u AS (SELECT o_custkey AS event_id, arg_max(o_totalprice / 1000 - 250, (o_orderkey % 3, o_orderkey)) AS td
        FROM orders WHERE o_custkey < (SELECT count(*) FROM events) GROUP BY 1),
    p AS (SELECT e.event_id, CASE WHEN td IS NULL THEN e.p ELSE pow(abs(td) + 1e-6, 0.6) END AS p
        FROM ({_PRIO}) e LEFT JOIN u ON u.event_id = e.event_id),
    c AS (SELECT event_id, p, sum(p) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cum FROM p),
    t AS (SELECT sum(p) AS total, count(*) AS n FROM p),
    d AS (SELECT c_custkey AS draw_id, {_DRAW} * total AS goal, total, n FROM customer, t)
    SELECT draw_id, event_id, round(p, 6) AS p, round(pow(n * (p / total), -0.4), 6) AS weight
    FROM d ASOF JOIN c ON d.goal <= c.cum
    """,
)
def sum_tree_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draw per customer from a stored tree of the events' priorities, after three rounds of updates."""
    events, path = table(spark, sf_dir, "events"), fresh_path(spark, "sum-tree")
    n = events.count()
    sum_tree.build(events.select("event_id", (F.col("value") - 100).alias("td")), path, n, "event_id")
    updates = table(spark, sf_dir, "orders").filter(F.col("o_custkey") < n).select(
        F.col("o_custkey").alias("event_id"), (F.col("o_totalprice") / 1000 - 250).alias("td"), F.col("o_orderkey").alias("seq")
    )
    for k in range(3):
        sum_tree.update(spark, path, updates.filter(F.col("seq") % 3 == k), "event_id")
    draws = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("draw_id"), F.expr(_DRAW).alias("u"))
    return rounded(sum_tree.draw(spark, path, draws, "event_id"), 6, "p", "weight")


@query("anneal", "SELECT event_id, round(least(1.0, 0.4 + 1e-4 * event_id), 9) AS beta FROM events")
def anneal(spark: SparkSession, sf_dir: str) -> DataFrame:
    beta = S.anneal(F.lit(0.4), F.col("event_id"))
    return rounded(table(spark, sf_dir, "events").select("event_id", beta.alias("beta")), 9, "beta")
