"""Operator inputs made from the driver tables.

Scalar expressions are written once, in SQL text that both Spark and the
checking engine read, so that only the operators differ between the two sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regionflow import constants as K
from regionflow.functions.scalar import clean_value
from regionflow.operators.skew import stored
from regionflow.plans.registry import table

RAW_VALUE = "CASE WHEN event_id % 17 = 0 THEN NULL ELSE value - 50e0 END"

# attributes of a nation, from its key k
ENTITY_COLUMNS = {
    "lat": "CAST((37 * k) % 120 - 60 AS DOUBLE)",
    "lon": "CAST((73 * k) % 360 - 180 AS DOUBLE)",
    "beds_per_1k": "0.5e0 + (k % 9) * 1.5e0",
    "beta_mul": "0.8e0 + (k % 6) * 0.1e0",
    "ifr_mul": "0.8e0 + (k % 7) * 0.1e0",
    "noise": "0.03e0 + (k % 6) * 0.01e0",
    "density": "CAST(36 + (k * 53) % 500 AS DOUBLE)",
    "gdp": "CAST(2000 + (k * 7919) % 68000 AS DOUBLE)",
    "healthcare": "0.31e0 + ((k * 7) % 14) * 0.05e0",
    "mobility": "0.4e0 + (k % 6) * 0.1e0",
    "elderly": "0.07e0 + (k % 8) * 0.03e0",
    "climate": "0.4e0 + (k % 5) * 0.1e0",
    "connectivity": "0.4e0 + (k % 12) * 0.05e0",
    "resilience": "0.3e0 + (k % 13) * 0.05e0",
    "airports": "CAST(1 + k % 5 AS DOUBLE)",
    "air_scale": "0.5e0 + (k % 4) * 0.25e0",
}

# a state, its action and its noise draw, from the customer key k
STATE_COLUMNS = {
    "s": "CAST(900000 + (k * 37) % 100000 AS DOUBLE)",
    "i": "CAST(CASE WHEN k % 13 = 0 THEN k % 7 ELSE (k * 101) % 50000 END AS DOUBLE)",
    "r": "CAST((k * 53) % 30000 AS DOUBLE)",
    "d": "CAST((k * 211) % 30000 AS DOUBLE)",
    "v": "CAST((k * 17) % 40000 AS DOUBLE)",
    "hosp_cap": "CAST(100 + (k % 50) * 700 AS DOUBLE)",
    "t": "CAST(k % 120 AS INT)",
    "t_max": "CAST(110 AS INT)",
    "seed": "CAST(1 AS INT)",
    "a": "CAST(k % 10 AS INT)",
    "z": "((k * 7919) % 2001 - 1000) / 500e0",
    # a second state and outcome, for reward scoring
    "s_2": "CAST(890000 + (k * 29) % 100000 AS DOUBLE)",
    "i_2": "CAST((k * 97) % 52000 AS DOUBLE)",
    "r_2": "CAST((k * 59) % 33000 AS DOUBLE)",
    "d_2": "CAST((k * 211) % 30000 + k % 40 AS DOUBLE)",
}


def _named(columns: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in columns.items())


def _columns(columns: dict[str, str]) -> list[Column]:
    return [F.expr(text).alias(name) for name, text in columns.items()]


# ---------------------------------------------------------------- SQL side
OBS_SQL = f"SELECT event_type AS entity, CAST(ts AS DATE) AS day, {RAW_VALUE} AS value FROM events"
OBS_USER_SQL = (
    f"SELECT CAST(user_id AS VARCHAR) AS entity, CAST(ts AS DATE) AS day, {RAW_VALUE} AS value FROM events"
)


def daily_sql(obs: str) -> str:
    return (
        "SELECT entity, day, sum(CASE WHEN value IS NULL OR value < 0 THEN 0e0 ELSE value END) AS value "
        f"FROM ({obs}) GROUP BY entity, day"
    )


def series_sql(obs: str) -> str:
    return (
        "SELECT entity, CAST(row_number() OVER (PARTITION BY entity ORDER BY day) - 1 AS INTEGER) AS t, "
        f"value FROM ({daily_sql(obs)})"
    )


SERIES_SQL = series_sql(OBS_SQL)
SERIES_USER_SQL = series_sql(OBS_USER_SQL)


def padded_sql(series: str, n: int) -> str:
    return (
        f"SELECT e.entity, CAST(p.t AS INTEGER) AS t, coalesce(s.value, 0e0) AS value "
        f"FROM (SELECT DISTINCT entity FROM ({series})) e CROSS JOIN range({n}) p(t) "
        f"LEFT JOIN ({series}) s ON s.entity = e.entity AND s.t = p.t"
    )


ENTITY_SQL = (
    f"SELECT n_name AS entity, k AS idx, 1000 * (1 + coalesce(c, 0)) AS pop, {_named(ENTITY_COLUMNS)} "
    "FROM (SELECT n_name, n_nationkey AS k FROM nation) "
    "LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = k"
)
LINKS_SQL = (
    "SELECT DISTINCT a.n_name AS src, b.n_name AS dst FROM customer "
    "JOIN nation a ON a.n_nationkey = c_nationkey "
    "JOIN nation b ON b.n_nationkey = (c_custkey * 7 + 3) % 25 WHERE a.n_name <> b.n_name"
)
PAIR_SQL = (
    "SELECT a.n_name AS src, b.n_name AS dst, 1e0 + ((7 * a.n_nationkey + 3 * b.n_nationkey) % 5) / 10e0 AS mul "
    "FROM nation a JOIN nation b ON (a.n_nationkey + b.n_nationkey) % 3 = 0"
)
STATE_SQL = (
    f"SELECT k, n_name AS entity, {_named(STATE_COLUMNS)} "
    "FROM (SELECT c_custkey AS k, c_nationkey FROM customer) JOIN nation ON n_nationkey = c_nationkey"
)
STATE_PROFILE_SQL = (
    "SELECT st.*, e.pop, " + ", ".join(f"e.{c}" for c in ENTITY_COLUMNS) + " "
    f"FROM ({STATE_SQL}) st JOIN ({ENTITY_SQL}) e ON e.entity = st.entity"
)
STOCK_SQL = (
    "SELECT o_orderpriority AS scenario, n_name AS entity, "
    "CAST(1000 * count(DISTINCT o_custkey) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS i "
    "FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey "
    "GROUP BY 1, 2"
)
STEP_COLUMNS = {
    "epoch": "CAST(o_orderkey % 20 AS INT)",
    "step": "o_orderkey",
    "entity": "o_orderpriority",
    "reward": "o_totalprice / 1000e0 - 250e0",
    "s": "CAST(o_custkey % 1000 AS DOUBLE)",
    "i": "CAST(o_custkey % 77 AS DOUBLE)",
    "d": "CAST(o_custkey % 13 AS DOUBLE)",
    "eps": "1e0 / (1 + o_orderkey % 100)",
    "loss": "o_totalprice / 100000e0",
}
STEP_SQL = f"SELECT {_named(STEP_COLUMNS)} FROM orders"
LINE_COLUMNS = {
    "epoch": "CAST(l_orderkey % 20 AS INT)",
    "step": "l_orderkey",
    "entity": "concat(l_returnflag, l_linestatus)",
    "reward": "l_discount - l_tax",
    "loss": "l_quantity",
    "eps": "l_extendedprice / 1000e0",
}
LINE_SQL = f"SELECT {_named(LINE_COLUMNS)} FROM lineitem"
METRIC_COLUMNS = {
    "run": "concat('run', event_id % 3)",
    "step": "CAST(floor(event_id / 10e0) AS BIGINT)",
    "key": "event_type",
    "value": "value",
    "seq": "event_id",
}
METRIC_SQL = f"SELECT {_named(METRIC_COLUMNS)} FROM events"

METRIC_KEYS = ["click", "error", "purchase", "signup", "view"]


# -------------------------------------------------------------- Spark side
def observations(spark: SparkSession, sf_dir: str, by: str = "event_type") -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col(by).cast("string").alias("entity"), F.to_date("ts").alias("day"), F.expr(RAW_VALUE).alias("value")
    )


def daily(spark: SparkSession, sf_dir: str, by: str = "event_type") -> DataFrame:
    """One cleaned value per entity and day, summed before the shuffle."""
    obs = observations(spark, sf_dir, by)
    return (
        obs.withColumn("value", clean_value(F.col("value")))
        .groupBy("entity", "day")
        .agg(F.sum("value").alias("value"))
    )


def series(spark: SparkSession, sf_dir: str, by: str = "event_type") -> DataFrame:
    """All days of every entity, numbered from 0."""
    place = F.row_number().over(Window.partitionBy("entity").orderBy("day")) - 1
    return daily(spark, sf_dir, by).select("entity", place.alias("t"), "value")


def nation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per pair of nations they record (a, b, c), loops included: one pass over customer, written once."""
    b = F.expr("CAST((c_custkey * 7 + 3) % 25 AS INT)").alias("b")
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("a"), b).agg(F.count("*").alias("c"))
    return stored(counts, "nation-links")


def entities(spark: SparkSession, sf_dir: str, ends: DataFrame | None = None) -> DataFrame:
    ends = nation_links(spark, sf_dir) if ends is None else ends
    customers = ends.groupBy(F.col("a").alias("k")).agg(F.sum("c").alias("c"))
    nation = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("k"))
    pop = (F.lit(1000) * (F.lit(1) + F.coalesce("c", F.lit(0)))).cast("bigint")
    return nation.join(customers, "k", "left").select(
        F.col("n_name").alias("entity"),
        F.col("k").alias("idx"),
        pop.alias("pop"),
        *_columns(ENTITY_COLUMNS),
    )


def _linked(spark: SparkSession, sf_dir: str, ends: DataFrame | None = None) -> DataFrame:
    """Links between nations that customers record, loops included: (a, b, src, dst)."""
    nation = table(spark, sf_dir, "nation")
    ends = (nation_links(spark, sf_dir) if ends is None else ends).select("a", "b")
    src = nation.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("src"))
    dst = nation.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("dst"))
    return ends.join(src, "a").join(dst, "b")


def links(spark: SparkSession, sf_dir: str, ends: DataFrame | None = None) -> DataFrame:
    return _linked(spark, sf_dir, ends).select("src", "dst")


def pair_multipliers(spark: SparkSession, sf_dir: str, ends: DataFrame | None = None) -> DataFrame:
    """Multipliers of the linked pairs whose key sum is divisible by 3."""
    mul = F.expr("1e0 + ((7 * a + 3 * b) % 5) / 10e0").alias("mul")
    return _linked(spark, sf_dir, ends).filter("(a + b) % 3 = 0").select("src", "dst", mul)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("entity"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return customers.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "k", "entity", *_columns(STATE_COLUMNS)
    )


def states_with_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).join(entities(spark, sf_dir).drop("idx"), "entity")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States and outcomes as nested structs, with the profile columns."""
    rows = states_with_profile(spark, sf_dir).withColumnsRenamed({"s": "s_1", "i": "i_1", "r": "r_1", "d": "d_1"})
    rest = ["v", "hosp_cap", "t", "t_max", "seed"]
    before = F.struct(*[F.col(f"{c}_1").alias(c) for c in "sird"], *rest)
    after = F.struct(*[F.col(f"{c}_2").alias(c) for c in "sird"], *rest)
    profile = ["pop", *ENTITY_COLUMNS]
    return rows.select("k", "entity", "a", before.alias("s"), after.alias("s2"), *profile)


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks per scenario (order priority) and nation."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey")
    # one row per scenario and customer first, so that orders shuffle pre-aggregated
    buyers = orders.groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("entity")
    )
    return (
        buyers.join(customer, "o_custkey")
        .groupBy(F.col("o_orderpriority").alias("scenario"), "c_nationkey")
        .agg(
            (F.count("*") * 1000).cast("double").alias("s"),
            F.sum("n").cast("double").alias("i"),
        )
        .join(nation, "c_nationkey")
        .select("scenario", "entity", "s", "i")
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*_columns(STEP_COLUMNS))


def line_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_columns(LINE_COLUMNS))


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*_columns(METRIC_COLUMNS))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series under every grid cell: value * (beta / 0.25) * travel."""
    cells = [
        F.struct(F.lit(beta).alias("beta"), F.lit(travel).alias("travel"))
        for beta in K.BETA_GRID
        for travel in K.TRAVEL_GRID
    ]
    rows = series(spark, sf_dir).withColumn("cell", F.explode(F.array(*cells)))
    value = F.col("value") * (F.col("cell.beta") / 0.25) * F.col("cell.travel")
    return rows.select("cell.beta", "cell.travel", "entity", "t", value.alias("value"))


GRID_SQL = (
    "SELECT 5 * b + t AS grid_pos, beta, travel FROM (VALUES (0, 0.24e0), (1, 0.25e0), (2, 0.26e0), (3, 0.27e0)) x(b, beta) "
    "CROSS JOIN (VALUES (0, 0.5e0), (1, 0.6e0), (2, 0.7e0), (3, 0.8e0), (4, 0.9e0)) y(t, travel)"
)
TRAJECTORY_SQL = (
    "SELECT g.beta, g.travel, s.entity, s.t, s.value * (g.beta / 0.25e0) * g.travel AS value "
    f"FROM ({SERIES_SQL}) s CROSS JOIN ({GRID_SQL}) g"
)
# observed goals: every second entity by name length has one
TARGET_SQL = (
    "SELECT entity, CAST(3 + length(entity) AS DOUBLE) AS t_arrive, 0.9e0 * max(value) AS peak "
    f"FROM ({SERIES_SQL}) WHERE length(entity) % 2 = 1 GROUP BY entity"
)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        series(spark, sf_dir)
        .filter(F.length("entity") % 2 == 1)
        .groupBy("entity")
        .agg((F.lit(0.9) * F.max("value")).alias("peak"))
        .select("entity", (F.lit(3) + F.length("entity")).cast("double").alias("t_arrive"), "peak")
    )
