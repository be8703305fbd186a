"""Series, calibration, summary and reshape queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow import constants as K
from regionflow.functions import scalar as S
from regionflow.operators import calibrate, reshape, series, summary
from regionflow.operators.skew import stored
from regionflow.plans import views as V
from regionflow.plans.registry import query, rounded
from regionflow.sources.tables import rows_to_df

#: Days that a report covers at least; longer series are covered whole.
HORIZON = 40
THRESH = 400.0

_USER_PADDED = V.padded_sql(V.SERIES_USER_SQL, HORIZON)
_METRICS = (
    "CAST(coalesce(min(CASE WHEN value >= {thresh} THEN t END), count(*)) AS INTEGER) AS arrival, "
    "round(max(value), 4) AS peak, round(arg_max(value, t), 4) AS final"
)


def _padded_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.first_n_padded(V.daily(spark, sf_dir, "user_id"), HORIZON)


def report_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.observations(spark, sf_dir, "user_id").groupBy("entity").agg(F.count("*").alias("n"))
    return rows.select("entity", (F.col("n") * 37 + 1000).alias("pop"))


REPORT_SQL = f"""
    WITH s AS ({V.SERIES_USER_SQL}),
    d AS (SELECT entity, count(*) AS n_days FROM s GROUP BY entity),
    longest AS (SELECT CAST(greatest({HORIZON}, max(n_days)) AS INTEGER) AS days FROM d),
    p AS (SELECT g.entity, CAST(g.t AS INTEGER) AS t, coalesce(s.value, 0e0) AS value
          FROM (SELECT entity, unnest(range(days)) AS t FROM d, longest) g LEFT JOIN s ON s.entity = g.entity AND s.t = g.t),
    m AS (SELECT entity, {_METRICS.format(thresh=THRESH)} FROM p GROUP BY entity),
    n AS (SELECT entity, count(*) * 37 + 1000 AS pop FROM ({V.OBS_USER_SQL}) GROUP BY entity),
    r AS (SELECT p.entity, CAST(coalesce(min(CASE WHEN value / greatest(1, pop) >= 0.05 THEN t END), count(*)) AS INTEGER)
          AS arrival_n, round(max(value / greatest(1, pop)), 6) AS peak_n
          FROM p JOIN n ON n.entity = p.entity GROUP BY p.entity)
    SELECT m.entity, arrival, peak, final, arrival_n, peak_n, days, n_days
    FROM m JOIN r ON m.entity = r.entity JOIN d ON d.entity = m.entity, longest
    """


@query("region_report", REPORT_SQL)
def region_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows to padded series to arrival, peak and final, plain and per head, of an entity's `n_days` days padded to `days`."""
    daily = stored(V.daily(spark, sf_dir, "user_id"), "daily")
    days = series.longest(daily, HORIZON)
    report = series.region_metrics(
        series.first_n_padded(daily, days), report_population(spark, sf_dir), thresh=THRESH, thresh_n=0.05
    )
    seen = daily.groupBy("entity").agg(F.count("*").alias("n_days"))
    named = report.withColumn("days", days).join(seen, "entity")
    return rounded(rounded(named, 4, "peak", "final"), 6, "peak_n")


@query(
    "cleaned_series",
    f"SELECT entity, CAST(day AS VARCHAR) AS day, round(value, 4) AS value FROM ({V.daily_sql(V.OBS_SQL)})",
)
def cleaned_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted daily values, negatives and gaps as 0. The order itself is checked in the tests."""
    obs = series.clean_series(V.observations(spark, sf_dir))
    by_day = obs.groupBy("entity", "day").agg(F.sum("value").alias("value"))
    ordered = series.series_sort(by_day)
    return rounded(ordered.withColumn("day", F.col("day").cast("string")), 4, "value")


@query(
    "map_entity_names",
    f"""
    SELECT CASE entity WHEN 'view' THEN 'Views' WHEN 'click' THEN 'Clicks' ELSE 'Errors' END AS entity,
    count(*) AS n, count(value) AS n_value, round(sum(value), 4) AS total
    FROM ({V.OBS_SQL}) WHERE entity IN ('view', 'click', 'error') GROUP BY 1
    """,
)
def map_entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the five source names are listed; casts keep what parses."""
    aliases = rows_to_df(
        spark,
        [("Views", "view"), ("Clicks", "click"), ("Errors", "error")],
        "entity STRING, location STRING",
    )
    obs = V.observations(spark, sf_dir).withColumnsRenamed(
        {"entity": "location", "day": "date", "value": "new_cases"}
    )
    rows = series.select_cast(series.map_entity_names(obs, aliases))
    return rounded(
        rows.groupBy("entity").agg(
            F.count("*").alias("n"), F.count("value").alias("n_value"), F.sum("value").alias("total")
        ),
        4,
        "total",
    )


@query(
    "partition_by_entity",
    f"SELECT entity, count(*) AS n, 1 AS n_partitions FROM ({V.OBS_USER_SQL}) GROUP BY entity",
)
def partition_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After hash partitioning every entity lies in one partition."""
    spread = series.partition_by_entity(V.daily(spark, sf_dir, "user_id"), 6)
    obs = V.observations(spark, sf_dir, "user_id").groupBy("entity").agg(F.count("*").alias("n"))
    places = spread.withColumn("p", F.spark_partition_id()).groupBy("entity").agg(
        F.count_distinct("p").cast("int").alias("n_partitions")
    )
    return obs.join(places, "entity")


@query("first_n_padded", f"SELECT entity, t, round(value, 4) AS value FROM ({_USER_PADDED})")
def first_n_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty positions per user, zeros after the last day seen."""
    return rounded(_padded_users(spark, sf_dir), 4, "value")


@query(
    "first_n_cut",
    f"SELECT entity, t, round(value, 4) AS value FROM ({V.padded_sql(V.SERIES_SQL, 12)})",
)
def first_n_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer series are cut to their first twelve days."""
    return rounded(series.first_n_padded(V.daily(spark, sf_dir), 12), 4, "value")


@query(
    "series_metrics",
    f"SELECT entity, {_METRICS.format(thresh=THRESH)} FROM ({V.SERIES_USER_SQL}) GROUP BY entity",
)
def series_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.series(spark, sf_dir, "user_id")
    return rounded(series.series_metrics(rows, thresh=THRESH), 4, "peak", "final")


@query(
    "normalised_metrics",
    f"""
    WITH s AS ({V.SERIES_USER_SQL}), n AS (SELECT entity, count(*) * 37 + 1000 AS pop FROM ({V.OBS_USER_SQL}) GROUP BY 1)
    SELECT s.entity, CAST(coalesce(min(CASE WHEN value / greatest(1, pop) >= 0.05 THEN t END), count(*)) AS INTEGER)
    AS arrival_n, round(max(value / greatest(1, pop)), 6) AS peak_n
    FROM s JOIN n ON n.entity = s.entity GROUP BY s.entity
    """,
)
def normalised_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.series(spark, sf_dir, "user_id")
    shares = series.normalised_metrics(rows, report_population(spark, sf_dir), thresh=0.05)
    return rounded(shares, 6, "peak_n")


_CELL_METRICS = f"""
    m AS (SELECT beta, travel, entity,
        coalesce(min(CASE WHEN value >= 3000 THEN t END), count(*)) AS arrival, max(value) AS peak,
        arg_max(value, t) AS final
        FROM ({V.TRAJECTORY_SQL}) GROUP BY beta, travel, entity),
    resid AS (SELECT m.*, arrival - coalesce(g.t_arrive, arrival) AS arrival_resid,
        m.peak - coalesce(g.peak, m.peak) AS peak_resid
        FROM m LEFT JOIN ({V.TARGET_SQL}) g ON g.entity = m.entity),
    surface AS (SELECT beta, travel, 0.5 * sqrt(avg(arrival_resid * arrival_resid))
        + 0.5 * sqrt(avg(peak_resid * peak_resid)) AS loss FROM resid GROUP BY beta, travel)
"""


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.loss_surface(
        V.trajectories(spark, sf_dir), V.targets(spark, sf_dir), thresh=3000.0
    )


@query(
    "join_targets",
    f"""
    WITH {_CELL_METRICS} SELECT beta, travel, entity, round(arrival_resid, 6) AS arrival_resid,
    round(peak_resid, 4) AS peak_resid FROM resid
    """,
)
def join_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.series_metrics(
        V.trajectories(spark, sf_dir), ["beta", "travel", "entity"], thresh=3000.0
    )
    resid = calibrate.join_targets(rows, V.targets(spark, sf_dir)).select(
        "beta", "travel", "entity", "arrival_resid", "peak_resid"
    )
    return rounded(rounded(resid, 6, "arrival_resid"), 4, "peak_resid")


@query(
    "rmse",
    f"""
    SELECT entity, round(sqrt(sum((value - 400) * (value - 400)) / greatest(1, count(*))), 4) AS rmse
    FROM ({V.SERIES_USER_SQL}) GROUP BY entity
    """,
)
def rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.series(spark, sf_dir, "user_id")
    return rounded(
        rows.groupBy("entity").agg(calibrate.rmse(F.col("value") - 400.0).alias("rmse")), 4, "rmse"
    )


SURFACE_SQL = f"WITH {_CELL_METRICS} SELECT beta, travel, round(loss, 4) AS loss FROM surface"


@query("loss_surface", SURFACE_SQL)
def loss_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(surface(spark, sf_dir), 4, "loss")


@query(
    "best_cell",
    f"""
    WITH {_CELL_METRICS} SELECT g.beta, g.travel, round(loss, 4) AS loss
    FROM surface s JOIN ({V.GRID_SQL}) g ON g.beta = s.beta AND g.travel = s.travel
    ORDER BY s.loss, grid_pos LIMIT 1
    """,
)
def best_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = calibrate.param_grid(spark)
    return rounded(calibrate.best_cell(surface(spark, sf_dir), grid), 4, "loss")


@query(
    "param_grid",
    f"""
    SELECT CAST(g.grid_pos AS INTEGER) AS grid_pos, g.beta, g.travel, count(*) AS n, round(sum(value), 6) AS total
    FROM ({V.TRAJECTORY_SQL}) t JOIN ({V.GRID_SQL}) g ON g.beta = t.beta AND g.travel = t.travel GROUP BY 1, 2, 3
    """,
)
def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells joined with the trajectories run under them."""
    runs = V.trajectories(spark, sf_dir).groupBy("beta", "travel").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )
    grid = calibrate.param_grid(spark)
    return rounded(grid.join(runs, ["beta", "travel"]), 6, "total")


_PIVOT = ", ".join(
    f'round(max(CASE WHEN travel = {t}e0 THEN loss END), 4) AS "{t}"' for t in K.TRAVEL_GRID
)


@query("surface_pivot", f"WITH {_CELL_METRICS} SELECT beta, {_PIVOT} FROM surface GROUP BY beta")
def surface_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = reshape.surface_pivot(surface(spark, sf_dir), K.TRAVEL_GRID)
    return wide.select(
        "beta", *[(F.round(F.col(f"`{t}`"), 4) + F.lit(0.0)).alias(str(t)) for t in K.TRAVEL_GRID]
    )


@query(
    "epoch_summary",
    f"""
    SELECT epoch, round(avg(reward), 6) AS avg_reward, round(avg(loss), 6) AS avg_loss,
    round(arg_max(eps, step), 6) AS epsilon, arg_max(i, step) AS final_i, arg_max(d, step) AS final_d
    FROM ({V.STEP_SQL}) GROUP BY epoch
    """,
)
def epoch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.steps(spark, sf_dir).withColumnsRenamed(
        {"reward": "total_reward", "loss": "avg_loss", "eps": "epsilon", "i": "final_i", "d": "final_d"}
    )
    return rounded(summary.epoch_summary(rows), 6, "avg_reward", "avg_loss", "epsilon")


EPOCH_ENTITY_SQL = f"""
    SELECT epoch, entity, round(avg(reward), 6) AS avg_reward, arg_max(s, step) AS final_s,
    arg_max(i, step) AS final_i, arg_max(d, step) AS final_d, round(arg_max(eps, step), 6) AS epsilon
    FROM ({V.STEP_SQL}) GROUP BY epoch, entity
"""


@query("epoch_entity_summary", EPOCH_ENTITY_SQL)
def epoch_entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.epoch_entity_summary(V.steps(spark, sf_dir))
    return rounded(rows, 6, "avg_reward", "epsilon")


@query(
    "reward_spread",
    f"""
    SELECT step, round(avg(reward), 6) AS mean, round(var_pop(reward), 6) AS variance,
    round(stddev_pop(reward), 6) AS std, round(max(reward) - min(reward), 6) AS range,
    CASE WHEN sum(CAST(reward AS DECIMAL(18, 4))) <> 0 THEN round(stddev_pop(reward) / abs(avg(reward)), 4) ELSE 0 END AS cv
    FROM ({V.LINE_SQL}) GROUP BY step
    """,
)
def reward_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards are taken as decimals, so a mean of 0 is 0 and its variation too."""
    lines = V.line_steps(spark, sf_dir).withColumn("reward", F.col("reward").cast("decimal(18,4)"))
    rows = summary.reward_spread(lines)
    shown = rows.withColumn("range", F.col("range").cast("double"))
    return rounded(rounded(shown, 6, "mean", "variance", "std", "range"), 4, "cv")


@query(
    "cross_entity_mean",
    f"SELECT step, round(avg(eps), 10) AS eps_mean, round(avg(loss), 10) AS loss_mean FROM ({V.LINE_SQL}) GROUP BY step",
)
def cross_entity_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.cross_entity_mean(V.line_steps(spark, sf_dir))
    return rounded(rows, 10, "eps_mean", "loss_mean")


@query(
    "epoch_totals",
    f"SELECT epoch, round(sum(reward), 6) AS total_reward, round(sum(loss) / 500, 6) AS avg_loss "
    f"FROM ({V.LINE_SQL}) GROUP BY epoch",
)
def epoch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.epoch_totals(V.line_steps(spark, sf_dir), 500)
    return rounded(rows, 6, "total_reward", "avg_loss")


@query(
    "world_total",
    f"SELECT scenario, CAST(sum(s) AS BIGINT) AS s_total, CAST(sum(i) AS BIGINT) AS i_total "
    f"FROM ({V.STOCK_SQL}) GROUP BY scenario",
)
def world_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.world_total(V.stocks(spark, sf_dir), ["s", "i"], ["scenario"])


@query(
    "linear_decay",
    f"""
    SELECT epoch, count(*) AS n, round(sum(1.0 + (0.1 - 1.0) * least(1.0, step / 10000.0)), 6) AS eps_total
    FROM ({V.LINE_SQL}) GROUP BY epoch
    """,
)
def linear_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.line_steps(spark, sf_dir).withColumn("x", S.linear_decay(F.col("step"), decay=10_000))
    totals = rows.groupBy("epoch").agg(F.count("*").alias("n"), F.sum("x").alias("eps_total"))
    return rounded(totals, 6, "eps_total")


@query("downsample_every", f"SELECT step, count(*) AS n FROM ({V.LINE_SQL}) WHERE step % 50 = 0 GROUP BY step")
def downsample_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.downsample_every(V.line_steps(spark, sf_dir), 50).groupBy("step").agg(F.count("*").alias("n"))


_EMA_ROWS = f"""
    x AS (SELECT entity, step, reward, row_number() OVER (PARTITION BY entity ORDER BY step) AS k
          FROM ({V.STEP_SQL}))
"""


@query(
    "ema",
    f"""
    WITH RECURSIVE {_EMA_ROWS},
    e AS (SELECT entity, k, step, 0.2 * reward AS ema FROM x WHERE k = 1
          UNION ALL SELECT x.entity, x.k, x.step, 0.2 * x.reward + 0.8 * e.ema
          FROM e JOIN x ON x.entity = e.entity AND x.k = e.k + 1)
    SELECT entity, step, round(ema, 6) AS ema FROM e
    """,
)
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.steps(spark, sf_dir).select("entity", "step", "reward")
    return rounded(summary.ema(rows).select("entity", "step", "ema"), 6, "ema")


@query(
    "ema_seeded",
    f"""
    WITH RECURSIVE {_EMA_ROWS},
    e AS (SELECT entity, k, step, reward AS ema FROM x WHERE k = 1
          UNION ALL SELECT x.entity, x.k, x.step,
            CASE WHEN e.ema = 0 THEN x.reward ELSE 0.2 * x.reward + 0.8 * e.ema END
          FROM e JOIN x ON x.entity = e.entity AND x.k = e.k + 1)
    SELECT entity, step, round(ema, 6) AS ema FROM e
    """,
)
def ema_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.steps(spark, sf_dir).select("entity", "step", "reward")
    out = summary.ema(rows, seed_first=True)
    return rounded(out.select("entity", "step", "ema"), 6, "ema")


@query(
    "ema_spread",
    f"""
    WITH RECURSIVE s AS (SELECT * FROM ({V.SERIES_SQL})),
    e AS (SELECT entity, t, 0.2 * value AS ema FROM s WHERE t = 0
          UNION ALL SELECT s.entity, s.t, 0.2 * s.value + 0.8 * e.ema FROM e JOIN s ON s.entity = e.entity AND s.t = e.t + 1)
    SELECT t, round(avg(ema), 4) AS mean, round(var_pop(ema), 2) AS variance, round(stddev_pop(ema), 4) AS std,
    round(max(ema) - min(ema), 4) AS range, round(stddev_pop(ema) / abs(avg(ema)), 6) AS cv FROM e GROUP BY t
    """,
)
def ema_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread over entities of their moving averages."""
    averages = summary.ema(V.series(spark, sf_dir), step="t", value="value")
    rows = summary.reward_spread(averages, ["t"], "ema")
    return rounded(rounded(rounded(rows, 4, "mean", "std", "range"), 2, "variance"), 6, "cv")


@query(
    "running_mean",
    f"""
    SELECT epoch, step, round(sum(loss) OVER (PARTITION BY epoch ORDER BY step ROWS UNBOUNDED PRECEDING)
    / greatest(1, step + 1), 6) AS running_mean FROM ({V.STEP_SQL})
    """,
)
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.steps(spark, sf_dir).select("epoch", "step", "loss")
    out = summary.running_mean(rows, t="step", chunk=5_000)
    return rounded(out.select("epoch", "step", "running_mean"), 6, "running_mean")


_NULLABLE = "CASE WHEN step % 17 = 0 THEN NULL ELSE {} END"


def _some_null(rows: DataFrame, key: str) -> DataFrame:
    """Every seventeenth step without its key."""
    return rows.withColumn(key, F.when(F.col("step") % 17 != 0, F.col(key)))


@query(
    "running_mean_null_keys",
    f"""
    WITH x AS (SELECT {_NULLABLE.format('epoch')} AS epoch, step, loss FROM ({V.STEP_SQL}))
    SELECT epoch, step, round(sum(loss) OVER (PARTITION BY epoch ORDER BY step ROWS UNBOUNDED PRECEDING)
    / greatest(1, step + 1), 6) AS running_mean FROM x
    """,
)
def running_mean_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps without an epoch have a running mean of their own."""
    rows = _some_null(V.steps(spark, sf_dir).select("epoch", "step", "loss"), "epoch")
    out = summary.running_mean(rows, t="step", chunk=5_000)
    return rounded(out.select("epoch", "step", "running_mean"), 6, "running_mean")


@query(
    "ema_null_keys",
    f"""
    WITH RECURSIVE x AS (SELECT entity, step, reward, row_number() OVER (PARTITION BY entity ORDER BY step) AS k
        FROM (SELECT {_NULLABLE.format('entity')} AS entity, step, reward FROM ({V.STEP_SQL}))),
    e AS (SELECT entity, k, step, 0.2 * reward AS ema FROM x WHERE k = 1
          UNION ALL SELECT x.entity, x.k, x.step, 0.2 * x.reward + 0.8 * e.ema
          FROM e JOIN x ON x.entity IS NOT DISTINCT FROM e.entity AND x.k = e.k + 1)
    SELECT entity, step, round(ema, 6) AS ema FROM e
    """,
)
def ema_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps without an entity are averaged together."""
    rows = _some_null(V.steps(spark, sf_dir).select("entity", "step", "reward"), "entity")
    return rounded(summary.ema(rows).select("entity", "step", "ema"), 6, "ema")


_LAST = f"SELECT run, step, key, arg_max(value, seq) AS value FROM ({V.METRIC_SQL}) GROUP BY run, step, key"


@query(
    "metrics_wide",
    "SELECT run, step, "
    + ", ".join(f"max(CASE WHEN key = '{k}' THEN value END) AS {k}" for k in V.METRIC_KEYS)
    + f" FROM ({_LAST}) GROUP BY run, step",
)
def metrics_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.metric_log(spark, sf_dir)
    return reshape.metrics_wide(log, reshape.log_keys(log), ["run", "step"])


@query("metrics_long", _LAST)
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.metric_log(spark, sf_dir)
    wide = reshape.metrics_wide(log, reshape.log_keys(log), ["run", "step"])
    return reshape.metrics_long(wide, ["run", "step"])


_NAMED = f"""
    n AS (SELECT epoch, entity, reward, i / greatest(s, 1) AS rate FROM ({V.STEP_SQL}))
    SELECT epoch, 'toy_rew_' || entity AS key, round(avg(reward), 6) AS value FROM n GROUP BY epoch, entity
    UNION ALL SELECT epoch, entity || '_infection_rate', round(max(rate), 6) FROM n GROUP BY epoch, entity
    UNION ALL SELECT epoch, 'reward_mean', round(avg(reward), 6) FROM n GROUP BY epoch
    UNION ALL SELECT epoch, 'reward_range', round(max(reward) - min(reward), 6) FROM n GROUP BY epoch
"""


@query("entity_metric_log", f"WITH {_NAMED}")
def entity_metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log rows of an epoch: a key per entity and metric, and keys over all entities."""
    rows = V.steps(spark, sf_dir).withColumn("rate", F.col("i") / F.greatest(F.col("s"), F.lit(1.0)))
    by_entity = rows.groupBy("epoch", "entity").agg(F.avg("reward").alias("reward"), F.max("rate").alias("rate"))
    spread = summary.reward_spread(rows, ["epoch"])
    own = reshape.entity_keys(by_entity, {"reward": "toy_rew_{}", "rate": "{}_infection_rate"}, ["epoch"])
    whole = reshape.metrics_long(
        spread.select("epoch", F.col("mean").alias("reward_mean"), F.col("range").alias("reward_range")), ["epoch"]
    )
    return rounded(own.unionByName(whole), 6, "value")
