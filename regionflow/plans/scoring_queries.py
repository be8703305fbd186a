"""Scalar, policy, transition, reward and array-column queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow import constants as K
from regionflow.functions import scalar as S
from regionflow.functions import vectors
from regionflow.operators import quality, scoring
from regionflow.plans import views as V
from regionflow.plans.registry import query, rounded, table
from regionflow.sources import tables


# Fixed values, written out here once more so that the SQL does not share the operators' tables.
_BANDS = {
    "health": "CASE WHEN {x} > 0.8 THEN 0.2e0 WHEN {x} > 0.5 THEN 0.6e0 ELSE 0.9e0 END",
    "health_country": "CASE WHEN {x} > 0.8 THEN 0.3e0 WHEN {x} > 0.5 THEN 0.5e0 ELSE 0.7e0 END",
    "healthcare": "CASE WHEN {x} > 0.8 THEN 0.2e0 WHEN {x} > 0.5 THEN 1e0 ELSE 8e0 END",
    "gdp": "CASE WHEN {x} > 50000 THEN 0.3e0 WHEN {x} > 20000 THEN 1e0 WHEN {x} > 5000 THEN 2.5e0 ELSE 5e0 END",
    "gdp_cost": "CASE WHEN {x} > 50000 THEN 0.3e0 WHEN {x} > 20000 THEN 1e0 WHEN {x} > 5000 THEN 3e0 ELSE 8e0 END",
    "density": "CASE WHEN {x} > 400 THEN 3e0 WHEN {x} > 200 THEN 2e0 WHEN {x} > 100 THEN 1e0 ELSE 0.5e0 END",
}
_ACTIONS = {
    "label": "['None', 'Distancing', 'TravelBan', 'Lockdown', 'NormalCare', 'SurgeCare', 'TargetedVax', 'MassVax']",
    "stringency": "[0e0, 0.4e0, 0.6e0, 0.8e0, 0.1e0, 0.2e0, 0.1e0, 0.15e0]",
    "cost": "[0e0, 0.05e0, 0.08e0, 0.15e0, 0.01e0, 0.06e0, 0.03e0, 0.05e0]",
}
_PROFILES = """
    ('USA', 331000000, 39.8, -98.5, 2.9, 1.0, 1.0, 0.05, 36.0, 65000.0, 0.85, 0.9, 0.20, 0.7, 0.95, 0.9),
    ('Japan', 125000000, 36.2, 138.2, 13.1, 0.8, 0.9, 0.03, 347.0, 42000.0, 0.95, 0.6, 0.30, 0.5, 0.8, 0.8),
    ('India', 1380000000, 20.6, 78.9, 0.5, 1.3, 1.2, 0.08, 464.0, 2100.0, 0.3, 0.4, 0.07, 0.8, 0.4, 0.3),
    ('Italy', 60000000, 41.9, 12.6, 3.2, 1.1, 1.4, 0.04, 206.0, 35000.0, 0.8, 0.7, 0.28, 0.6, 0.85, 0.7),
    ('Germany', 83000000, 51.2, 10.5, 8.0, 0.9, 0.8, 0.03, 240.0, 46000.0, 0.9, 0.8, 0.25, 0.4, 0.9, 0.85),
    ('China', 1400000000, 35.9, 104.2, 4.3, 1.0, 1.0, 0.06, 153.0, 10500.0, 0.6, 0.5, 0.18, 0.7, 0.7, 0.6)
"""
_UNKNOWN_PROFILE = {
    "pop": 50000000, "lat": 0.0, "lon": 0.0, "beds_per_1k": 3.0, "beta_mul": 1.0, "ifr_mul": 1.0, "noise": 0.05,
    "density": 100.0, "gdp": 30000.0, "healthcare": 0.7, "mobility": 0.8, "elderly": 0.15, "climate": 0.6,
    "connectivity": 0.8, "resilience": 0.7,
}


def _sql_bands(x: str, name: str) -> str:
    return _BANDS[name].format(x=x)


def _sql_actions(a: str, name: str) -> str:
    return f"({_ACTIONS[name]})[1 + greatest(0, least(7, {a}))]"


@query("decode_action", f"SELECT k, {_sql_actions('a', 'label')} AS label FROM ({V.STATE_SQL})")
def decode_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.decode_action(V.states(spark, sf_dir)).select("k", "label")


@query(
    "action_stringency",
    f"SELECT k, {_sql_actions('a', 'stringency')} AS stringency, round(a / 7.0, 6) AS level FROM ({V.STATE_SQL})",
)
def action_stringency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.states(spark, sf_dir).select(
        "k",
        S.action_stringency(F.col("a")).alias("stringency"),
        S.action_level(F.col("a")).alias("level"),
    )
    return rounded(rows, 6, "level")


@query(
    "band_value",
    f"SELECT k, {_sql_bands('healthcare', 'health')} AS health, {_sql_bands('gdp', 'gdp')} AS gdp, "
    f"{_sql_bands('density', 'density')} AS density FROM ({V.STATE_PROFILE_SQL})",
)
def band_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.states_with_profile(spark, sf_dir).select(
        "k",
        S.band(F.col("healthcare"), K.HEALTH_WEIGHT_MAIN).alias("health"),
        S.band(F.col("gdp"), K.GDP_FACTOR).alias("gdp"),
        S.band(F.col("density"), K.DENSITY_FACTOR).alias("density"),
    )


@query(
    "state_features",
    f"""
    SELECT k, round(s / n, 9) AS f0, round(i / n, 9) AS f1, round(r / n, 9) AS f2, round(d / n, 9) AS f3,
    round(v / n, 9) AS f4, round(i / greatest(1, hosp_cap), 9) AS f5, round(t / greatest(1, t_max), 9) AS f6
    FROM (SELECT *, greatest(1, s + i + r + d) AS n FROM ({V.STATE_SQL}))
    """,
)
def state_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.states(spark, sf_dir).select("k", S.state_features().alias("f"))
    names = [f"f{n}" for n in range(7)]
    return rounded(rows.select("k", *[F.col("f")[n].alias(c) for n, c in enumerate(names)]), 9, *names)


@query(
    "clip",
    """
    SELECT event_id, greatest(0, least(1, (value - 100) / 100)) AS unit, greatest(-15, least(5, value - 250)) AS reward,
    greatest(-10, least(10, value - 30)) AS q FROM events
    """,
)
def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        S.clamp01((v - 100) / 100).alias("unit"),
        S.clip_reward(v - 250).alias("reward"),
        S.clip_q(v - 30).alias("q"),
    )
    return rows.withColumns({c: F.col(c) + F.lit(0.0) for c in ("unit", "reward", "q")})


@query(
    "health_indicators",
    f"""
    SELECT k, round(i / greatest(1, s), 9) AS infection_rate, round(i / (beds_per_1k * pop / 1000), 6) AS healthcare_load,
    round(i / pop, 6) AS per_capita, round(a / 7.0, 6) AS policy_stringency FROM ({V.STATE_PROFILE_SQL})
    """,
)
def health_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["infection_rate", "healthcare_load", "per_capita", "policy_stringency"]
    rows = scoring.health_indicators(V.states_with_profile(spark, sf_dir)).select("k", *names)
    return rounded(rounded(rows, 9, names[0]), 6, *names[1:])


@query(
    "terminal_flag",
    f"""
    SELECT k, t >= t_max OR i / greatest(1, s + i + r + d) < 1e-5 OR d / greatest(1, s + i + r + d) > 0.02 AS done
    FROM ({V.STATE_SQL})
    """,
)
def terminal_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.states(spark, sf_dir).select("k", S.is_terminal().alias("done"))


_RUN_MUL = (
    "SELECT n_name AS entity, 0.7e0 + (n_nationkey % 5) * 0.2e0 AS mb, 0.8e0 + (n_nationkey % 3) * 0.3e0 AS mi, "
    "0.5e0 + (n_nationkey % 7) * 0.1e0 AS mn FROM nation WHERE n_nationkey % 4 <> 0"
)


@query(
    "run_parameters",
    f"""
    SELECT k, round(0.25 * coalesce(mb, 1) * (1 + density / 500 * 0.3) * (2 - healthcare * 0.8), 9) AS beta,
    round(0.008 * coalesce(mi, 1) * (1 + elderly * 2) * (2.5 - healthcare * 1.5), 9) AS ifr,
    round(0.05 * coalesce(mn, 1) * (1 + (1 - resilience) * 0.8), 9) AS env_noise
    FROM ({V.STATE_PROFILE_SQL}) p LEFT JOIN ({_RUN_MUL}) x ON x.entity = p.entity
    """,
)
def run_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    mul = table(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 0").select(
        F.col("n_name").alias("entity"),
        F.expr("0.7e0 + (n_nationkey % 5) * 0.2e0").alias("run_beta"),
        F.expr("0.8e0 + (n_nationkey % 3) * 0.3e0").alias("run_ifr"),
        F.expr("0.5e0 + (n_nationkey % 7) * 0.1e0").alias("run_noise"),
    )
    rows = V.states_with_profile(spark, sf_dir).join(mul, "entity", "left")
    out = scoring.run_parameters(rows, 0.25).select("k", "beta", "ifr", "env_noise")
    return rounded(out, 9, "beta", "ifr", "env_noise")


@query(
    "calibration_parameters",
    f"""
    SELECT k, round(0.25 * (1 + density / 1000 * 0.5) * (3 - healthcare * 2), 9) AS beta,
    round(0.008 * (1 + elderly * 2), 9) AS ifr, round(0.05 * (1 + (1 - resilience)), 9) AS env_noise
    FROM ({V.STATE_PROFILE_SQL})
    """,
)
def calibration_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.calibration_parameters(V.states_with_profile(spark, sf_dir), 0.25)
    return rounded(out.select("k", "beta", "ifr", "env_noise"), 9, "beta", "ifr", "env_noise")


@query(
    "reproduction_number",
    "SELECT event_id, CASE WHEN event_id % 10 > 0 THEN round(value / (event_id % 10), 6) ELSE 0 END AS r0 FROM events",
)
def reproduction_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    r0 = S.reproduction_number(F.col("value"), (F.col("event_id") % 10).cast("double"))
    return rounded(table(spark, sf_dir, "events").select("event_id", r0.alias("r0")), 6, "r0")


@query(
    "mobility_reduction",
    f"""
    SELECT k, round(least(i / greatest(1, s) * 10 * 1.5, 0.9) * least(gdp / 70000, 1) * resilience * (a / 7.0), 9)
    AS reduction FROM ({V.STATE_PROFILE_SQL})
    """,
)
def mobility_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = S.infection_rate(F.col("i"), F.col("s")) * 10
    out = S.mobility_reduction(rate, F.col("gdp"), F.col("resilience"), S.action_level(F.col("a")))
    rows = V.states_with_profile(spark, sf_dir).select("k", out.alias("reduction"))
    return rounded(rows, 9, "reduction")


_FACTORS = """
    CASE a WHEN 1 THEN resilience * 0.75 + 0.5 WHEN 2 THEN (1 - connectivity) * 0.4 + 0.4
           WHEN 3 THEN resilience * 0.5 + 0.2 ELSE 1 END AS beta_factor,
    CASE WHEN a = 5 THEN 1 + healthcare ELSE 1 END AS cap_factor,
    CASE WHEN a = 5 THEN 1.3e0 ELSE 1 END AS gamma_factor,
    CASE a WHEN 6 THEN 0.02 * healthcare WHEN 7 THEN 0.05 * healthcare ELSE 0 END AS vax_rate
"""
_EFFECTS = ["beta_factor", "cap_factor", "gamma_factor", "vax_rate"]


@query(
    "policy_effect",
    f"SELECT entity, CAST(a AS INTEGER) AS a, pop, "
    + ", ".join(f"round({c}, 9) AS {c}" for c in _EFFECTS)
    + f" FROM (SELECT *, {_FACTORS} FROM ({V.ENTITY_SQL}) CROSS JOIN range(8) x(a))",
)
def policy_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each action does in each region."""
    rows = scoring.policy_effect(V.entities(spark, sf_dir)).select("entity", "a", "pop", *_EFFECTS)
    return rounded(rows.withColumns({c: F.col(c).cast("double") for c in _EFFECTS}), 9, *_EFFECTS)


def _clamp01(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def _split(total: str, weights: list[str], names: list[str]) -> str:
    """Largest remainder over three weights, as list operations."""
    w = "[" + ", ".join(weights) + "]"
    raw = f"list_transform({w}, lambda x: CASE WHEN {total} > 0 THEN x / list_sum({w}) * {total} ELSE 0e0 END)"
    base = f"list_transform({raw}, lambda x: floor(x))"
    order = (
        f"list_transform(list_sort(list_transform([1, 2, 3], "
        f"lambda j: {{'f': -(({raw})[j] - floor(({raw})[j])), 'j': j}})), lambda q: q.j)"
    )
    left = f"({total} - list_sum({base}))"
    return ", ".join(
        f"CAST(({base})[{n + 1}] + CASE WHEN list_position({order}, {n + 1}) <= {left} THEN 1 ELSE 0 END AS BIGINT) AS {name}"
        for n, name in enumerate(names)
    )


_STEP_SQL = f"""
    WITH x AS (SELECT p.*, least(7, p.a) AS act FROM ({V.STATE_PROFILE_SQL}) p),
    f AS (SELECT x.* EXCLUDE (a), act AS a FROM x),
    g AS (SELECT *, {_FACTORS} FROM f),
    h AS (SELECT *, hosp_cap * cap_factor AS cap, 1 + 0.05 * (0.2 + noise * 1.5) * z AS stoch FROM g),
    q AS (SELECT *, {_clamp01('0.35 * beta_mul * beta_factor * stoch')} AS eff_beta,
        {_clamp01('0.12 * gamma_factor * stoch')} AS p_rec,
        {_clamp01('0.008 * ifr_mul * CASE WHEN i > cap THEN 6 ELSE 1 END * stoch')} AS p_die FROM h),
    p AS (SELECT *, {_clamp01('eff_beta * (i / greatest(1, s + i + r))')} AS p_inf, {_clamp01('vax_rate')} AS p_vax FROM q),
    o AS (SELECT *,
        {_split('s', ['greatest(0e0, 1 - p_inf - p_vax)', 'p_inf', 'p_vax'], ['stay', 'inf', 'vax'])},
        {_split('i', ['greatest(0e0, 1 - p_rec - p_die)', 'p_rec', 'p_die'], ['still', 'rec', 'die'])} FROM p),
    nxt AS (SELECT *, s - inf - vax AS s_next, still + inf AS i_next, r + rec AS r_next, d + die AS d_next, v + vax AS v_next FROM o)
"""


@query(
    "step_transition",
    f"""
    {_STEP_SQL} SELECT k, s_next + ((s + i + r + d + v) - (s_next + i_next + r_next + d_next + v_next)) AS s,
    CAST(i_next AS DOUBLE) AS i, r_next AS r, d_next AS d, v_next AS v, round(cap, 6) AS hosp_cap,
    CAST(t + 1 AS INTEGER) AS t FROM nxt
    """,
)
def step_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    stepped = scoring.step_transition(V.states_with_profile(spark, sf_dir))
    rows = stepped.select("k", *[F.col(f"next.{c}") for c in ("s", "i", "r", "d", "v", "hosp_cap", "t")])
    return rounded(rows, 6, "hosp_cap")


@query(
    "math_functions",
    """
    SELECT event_id, round(pow(value, 0.6), 6) AS p, round(sqrt(value), 6) AS q, round(sin(value), 6) AS s,
    round(cos(value), 6) AS c, round(atan2(value, 100), 6) AS a, round(radians(value), 6) AS r,
    CAST(greatest(0, floor(value - 100 + 0.5)) AS BIGINT) AS w FROM events
    """,
)
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.pow(v, F.lit(0.6)).alias("p"),
        F.sqrt(v).alias("q"),
        F.sin(v).alias("s"),
        F.cos(v).alias("c"),
        F.atan2(v, F.lit(100.0)).alias("a"),
        F.radians(v).alias("r"),
        S.whole(v - 100).alias("w"),
    )
    return rounded(rows, 6, "p", "q", "s", "c", "a", "r")


_LOOKUP = list(_UNKNOWN_PROFILE)
_REGIONS = ["USA", "Japan", "India", "Italy", "Germany", "China", "Elsewhere"]
_FOUND = ", ".join(
    f"CAST(coalesce(p.{c}, {v}) AS {'BIGINT' if c == 'pop' else 'DOUBLE'}) AS {c}" for c, v in _UNKNOWN_PROFILE.items()
)


@query(
    "lookup_profile",
    f"SELECT c_custkey, {_FOUND} FROM customer LEFT JOIN (VALUES {_PROFILES}) p(entity, {', '.join(_LOOKUP)}) "
    f"ON p.entity = {_REGIONS}[1 + c_nationkey % 7]",
)
def lookup_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of six known regions and one without a profile."""
    names = F.array(*[F.lit(name) for name in _REGIONS])
    region = F.element_at(names, F.lit(1) + F.col("c_nationkey") % 7)
    people = table(spark, sf_dir, "customer").select("c_custkey", region.alias("entity"))
    found = scoring.lookup_profile(people, tables.profiles(spark), _LOOKUP)
    return found.select("c_custkey", *_LOOKUP)


@query("join_population", f"SELECT k, pop FROM ({V.STATE_PROFILE_SQL})")
def join_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionflow.operators.series import join_population as join

    return join(V.states(spark, sf_dir), V.entities(spark, sf_dir)).select("k", "pop")


_COST = f"""{_sql_actions('a', 'cost')} * {_sql_bands('gdp', 'gdp_cost')}
    * CASE WHEN a IN (2, 3) THEN 1 + (1 - resilience) * 2 ELSE 1 END * 30"""
_BONUS = """CASE least(7, a) WHEN 3 THEN 0.05 * resilience WHEN 2 THEN 0.03 * connectivity WHEN 1 THEN 0.02
    WHEN 6 THEN 0.02 * healthcare WHEN 7 THEN 0.04 * healthcare ELSE 0 END"""
_REWARD = f"""
    WITH x AS (SELECT *, greatest(1, s_2 + i_2 + r_2 + d_2) AS n, {_sql_bands('healthcare', 'health')} AS hw,
        {_sql_bands('healthcare', 'healthcare')} AS hc, {_sql_bands('gdp', 'gdp')} AS gf,
        {_sql_bands('density', 'density')} AS df, {_COST} AS cost, {_BONUS} AS bonus
        FROM ({V.STATE_PROFILE_SQL})),
    y AS (SELECT *, -((i_2 - i) / n * 200 * df * hw * gf + (d_2 - d) / n * 2000 * (1 + elderly * 8) * hc * hw
        + greatest(0, i_2 / greatest(1, hosp_cap) - 1) * 1000 * hw * hc + cost * (1 - hw) * gf) AS base FROM x)
"""


@query(
    "reward_main",
    f"{_REWARD} SELECT k, round(greatest(-15, least(5, base)), 6) AS reward, "
    "round(greatest(-15000, least(5000, base * (1 + 0.75 * 0.4) + 0.4 * bonus)), 6) AS wide FROM y",
)
def reward_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the usual clip, and with risk and a clip wide enough to show every term."""
    rows = V.transitions(spark, sf_dir).select(
        "k", scoring.reward_main().alias("reward"), scoring.reward_main(risk=0.4, clip=5000.0).alias("wide")
    )
    return rounded(rows, 6, "reward", "wide")


@query(
    "reward_country",
    f"""
    WITH x AS (SELECT *, {_sql_bands('healthcare', 'health_country')} AS hw, {_sql_actions('a', 'stringency')} AS str,
        i / (beds_per_1k * pop / 1000) AS load FROM ({V.STATE_PROFILE_SQL}))
    SELECT k, round(-(greatest(0, load - 1) * 10 * hw + str * (gdp / 50000) * (1 - hw)
        + (d_2 - d) * ifr_mul * hw * (1 + elderly)), 10) AS reward FROM x
    """,
)
def reward_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.transitions(spark, sf_dir).select("k", scoring.reward_country().alias("reward"))
    return rounded(rows, 10, "reward")


@query("action_cost", f"SELECT k, round({_COST}, 6) AS cost FROM ({V.STATE_PROFILE_SQL})")
def action_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.transitions(spark, sf_dir).select("k", scoring.action_cost(F.col("a")).alias("cost"))
    return rounded(rows, 6, "cost")


@query("action_bonus", f"SELECT k, round({_BONUS}, 6) AS bonus FROM ({V.STATE_PROFILE_SQL})")
def action_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    bonus = scoring.action_bonus(S.action_id(F.col("a")))
    return rounded(V.transitions(spark, sf_dir).select("k", bonus.alias("bonus")), 6, "bonus")


# ---------------------------------------------------------- array columns
# each embedding is cut into eight vectors of eight; the next two are its successors, around the end
_CUT = "CAST(embedding[8 * {0} + 1:8 * {0} + 8] AS DOUBLE[])"
_Q_SQL = f"""
    SELECT vec_id * 8 + pos AS vec_id, {_CUT.format('pos')} AS q, {_CUT.format('((pos + 1) % 8)')} AS q_next,
    {_CUT.format('((pos + 2) % 8)')} AS q_target, (label + CAST(pos AS INTEGER)) % 8 AS a,
    CAST(embedding[8 * pos + 1] AS DOUBLE) * 20 AS r, (vec_id + pos) % 7 = 0 AS done
    FROM embeddings, range(8) p(pos)
"""


def _q_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight vectors of eight from each embedding, each with the two after it."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", "label", F.explode(F.array(*[F.lit(k) for k in range(8)])).alias("pos")
    )
    part = lambda k: F.slice("embedding", (F.col("pos") + k) % 8 * 8 + 1, F.lit(8)).cast("array<double>")
    return rows.select(
        (F.col("vec_id") * 8 + F.col("pos")).alias("vec_id"),
        part(0).alias("q"),
        part(1).alias("q_next"),
        part(2).alias("q_target"),
        ((F.col("label") + F.col("pos")) % 8).alias("a"),
        (F.element_at("embedding", F.col("pos") * 8 + 1).cast("double") * 20).alias("r"),
        ((F.col("vec_id") + F.col("pos")) % 7 == 0).alias("done"),
    )


def _spread(rows: DataFrame, column: str, digits: int = 6) -> DataFrame:
    return rounded(rows.select("vec_id", F.posexplode(column).alias("n", "x")), digits, "x")


@query(
    "argmax",
    f"SELECT vec_id, CAST(list_position(q, list_max(q)) - 1 AS INTEGER) AS action, round(list_max(q), 6) AS qmax FROM ({_Q_SQL})",
)
def argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _q_rows(spark, sf_dir).select(
        "vec_id", vectors.argmax(F.col("q")).alias("action"), F.array_max("q").alias("qmax")
    )
    return rounded(rows, 6, "qmax")


@query(
    "td_target",
    f"""
    WITH x AS (SELECT *, CASE WHEN done THEN r ELSE r + 0.99 * q_target[list_position(q_next, list_max(q_next))] END AS t
        FROM ({_Q_SQL})),
    y AS (SELECT vec_id, a, q, greatest(-10, least(10, t)) AS t, unnest(range(8)) AS n FROM x)
    SELECT vec_id, CAST(n AS INTEGER) AS n, round(CASE WHEN n = a THEN t ELSE q[n + 1] END, 6) AS x FROM y
    """,
)
def td_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    target = vectors.td_target(c("q"), c("a"), c("r"), c("done"), c("q_next"), c("q_target"))
    return _spread(_q_rows(spark, sf_dir).select("vec_id", target.alias("y")), "y")


HIDDEN = 12


def _layer(rows: int, columns: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed weights: ((7 j + 3 k + shift) mod 11 - 5) / 10, biases (j mod 5 - 2) / 20."""
    j, k = np.arange(rows)[:, None], np.arange(columns)[None, :]
    return ((7 * j + 3 * k + shift) % 11 - 5) / 10, (np.arange(rows) % 5 - 2) / 20


def _sql_layer(source: str, rows: int, columns: int, shift: int, relu: bool) -> str:
    dot = (
        f"list_sum(list_transform(range({columns}), lambda k: "
        f"({source})[k + 1] * (((7 * j + 3 * k + {shift}) % 11 - 5) / 10.0))) + (j % 5 - 2) / 20.0"
    )
    return f"list_transform(range({rows}), lambda j: {f'greatest(0, {dot})' if relu else dot})"


@query(
    "score_dense",
    f"""
    WITH a AS (SELECT vec_id, {_sql_layer('q', HIDDEN, 8, 0, True)} AS h FROM ({_Q_SQL})),
    b AS (SELECT vec_id, {_sql_layer('h', HIDDEN, HIDDEN, 1, True)} AS h FROM a),
    c AS (SELECT vec_id, {_sql_layer('h', 8, HIDDEN, 2, False)} AS y FROM b),
    d AS (SELECT vec_id, y, unnest(range(8)) AS n FROM c)
    SELECT vec_id, CAST(n AS INTEGER) AS n, round(greatest(-0.5, least(0.5, y[n + 1])), 6) AS x FROM d
    """,
)
def score_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = [_layer(HIDDEN, 8, 0), _layer(HIDDEN, HIDDEN, 1), _layer(8, HIDDEN, 2)]
    scores = vectors.score_dense(F.col("q"), layers, clamp=0.5)
    return _spread(_q_rows(spark, sf_dir).select("vec_id", scores.alias("y")), "y")


_FEATURES = (
    "[s / n, i / n, r / n, d / n, v / n, i / greatest(1, hosp_cap), CAST(t AS DOUBLE) / greatest(1, t_max)]"
)


@query(
    "greedy_actions",
    f"""
    WITH f AS (SELECT k, {_FEATURES} AS q FROM (SELECT *, greatest(1, s + i + r + d) AS n FROM ({V.STATE_SQL}))),
    a AS (SELECT k, {_sql_layer('q', HIDDEN, 7, 0, True)} AS h FROM f),
    c AS (SELECT k, {_sql_layer('h', 8, HIDDEN, 2, False)} AS y FROM a)
    SELECT k, CAST(list_position(y, list_max(y)) - 1 AS INTEGER) AS action, round(list_max(y), 6) AS qmax FROM c
    """,
)
def greedy_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state's features, their scores, and the action of the highest score."""
    layers = [_layer(HIDDEN, 7, 0), _layer(8, HIDDEN, 2)]
    scores = V.states(spark, sf_dir).select("k", vectors.score_dense(S.state_features(), layers).alias("y"))
    picked = scores.select("k", vectors.argmax(F.col("y")).alias("action"), F.array_max("y").alias("qmax"))
    return rounded(picked, 6, "qmax")


# -------------------------------------------------------------- state checks
@query(
    "check_state",
    f"""
    SELECT k, CASE WHEN i - 10 < 0 THEN 'negative compartment'
        WHEN CAST(floor(s + (i - 10) + r + d + v + 0.5) AS BIGINT) <> 1000000 + k % 3 THEN 'mass not conserved'
        ELSE 't out of bounds' END AS reason
    FROM ({V.STATE_SQL}) WHERE i - 10 < 0 OR CAST(floor(s + (i - 10) + r + d + v + 0.5) AS BIGINT) <> 1000000 + k % 3
        OR t < 0 OR t > t_max
    """,
)
def check_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.states(spark, sf_dir).withColumns(
        {"i": F.col("i") - 10, "pop": F.lit(1_000_000) + F.col("k") % 3}
    )
    return quality.check_state(rows).select("k", "reason")


@query(
    "check_local_mass",
    f"SELECT k, CAST((s_2 + i_2 + r_2 + d_2) - (s + i + r + d) AS BIGINT) AS mass_change FROM ({V.STATE_SQL}) "
    "WHERE (s_2 + i_2 + r_2 + d_2) <> (s + i + r + d)",
)
def check_local_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_local_mass(V.transitions(spark, sf_dir)).select("k", "mass_change")


@query(
    "check_finite",
    "SELECT event_id FROM events WHERE event_id % 17 = 0 OR event_id % 19 = 0",
)
def check_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and infinite losses are reported."""
    loss = F.when(F.col("event_id") % 19 == 0, F.lit(float("inf"))).otherwise(F.expr(V.RAW_VALUE))
    rows = table(spark, sf_dir, "events").select("event_id", loss.alias("loss"))
    return quality.check_finite(rows).select("event_id")
