"""Profiles, action effects, one-step transitions and rewards, row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow import constants as K
from regionflow.functions import scalar as S
from regionflow.operators.apportion import apportion_columns


def lookup_profile(
    df: DataFrame,
    profiles: DataFrame,
    columns: Sequence[str] = tuple(K.DEFAULT_PROFILE),
    key: str = "entity",
) -> DataFrame:
    """Adds profile columns; an entity without a profile gets the default record."""
    known = profiles.select(F.col("entity").alias(key), *[F.col(c).alias(f"_p_{c}") for c in columns])
    joined = df.join(known, key, "left")
    types = {c: known.schema[f"_p_{c}"].dataType for c in columns}
    found = {
        c: F.coalesce(f"_p_{c}", F.lit(K.DEFAULT_PROFILE[c])).cast(types[c]) for c in columns
    }
    return joined.withColumns(found).drop(*[f"_p_{c}" for c in columns])


def decode_action(df: DataFrame, action: str = "a", out: str = "label") -> DataFrame:
    return df.withColumn(out, S.action_label(F.col(action)))


def health_indicators(df: DataFrame) -> DataFrame:
    """Infection rate, bed load, cases per head and scaled last action."""
    return df.withColumns(
        {
            "infection_rate": S.infection_rate(F.col("i"), F.col("s")),
            "healthcare_load": S.healthcare_load(F.col("i"), F.col("beds_per_1k"), F.col("pop")),
            "per_capita": S.per_capita(F.col("i"), F.col("pop")),
            "policy_stringency": S.action_level(F.col("a")),
        }
    )


def run_parameters(df: DataFrame, beta: Column | float) -> DataFrame:
    """Beta, ifr and noise of a run, from profile and run multipliers (default 1)."""
    beta = beta if isinstance(beta, Column) else F.lit(beta)
    mul = {c: F.coalesce(F.col(c), F.lit(1.0)) for c in ("run_beta", "run_ifr", "run_noise")}
    return df.withColumns(
        {
            "beta": beta * mul["run_beta"] * (1.0 + (F.col("density") / 500.0) * 0.3)
            * (2.0 - F.col("healthcare") * 0.8),
            "ifr": F.lit(K.BASE_IFR) * mul["run_ifr"] * (1.0 + F.col("elderly") * 2.0)
            * (2.5 - F.col("healthcare") * 1.5),
            "env_noise": F.lit(K.BASE_NOISE) * mul["run_noise"]
            * (1.0 + (1.0 - F.col("resilience")) * 0.8),
        }
    )


def calibration_parameters(df: DataFrame, beta: Column | float) -> DataFrame:
    """Beta, ifr and noise during calibration, from the profile alone."""
    beta = beta if isinstance(beta, Column) else F.lit(beta)
    return df.withColumns(
        {
            "beta": beta * (1.0 + (F.col("density") / 1000.0) * 0.5) * (3.0 - F.col("healthcare") * 2.0),
            "ifr": F.lit(K.BASE_IFR) * (1.0 + F.col("elderly") * 2.0),
            "env_noise": F.lit(K.BASE_NOISE) * (1.0 + (1.0 - F.col("resilience"))),
        }
    )


def policy_factors(a: Column) -> dict[str, Column]:
    """What an action does in a region: factors on beta, beds and gamma, vaccination rate."""
    care, resilience = F.col("healthcare"), F.col("resilience")
    one = F.lit(1.0)
    return {
        "beta_factor": F.when(a == K.DISTANCING, resilience * 0.75 + 0.5)
        .when(a == K.TRAVEL_BAN, (1.0 - F.col("connectivity")) * 0.4 + 0.4)
        .when(a == K.LOCKDOWN, resilience * 0.5 + 0.2)
        .otherwise(one),
        "cap_factor": F.when(a == K.SURGE_CARE, 1.0 + care).otherwise(one),
        "gamma_factor": F.when(a == K.SURGE_CARE, F.lit(1.3)).otherwise(one),
        "vax_rate": F.when(a == K.TARGETED_VAX, 0.02 * care)
        .when(a == K.MASS_VAX, 0.05 * care)
        .otherwise(F.lit(0.0)),
    }


def policy_effect(entities: DataFrame) -> DataFrame:
    """The factors of every action for each entity: eight rows per entity."""
    ids = F.array(*[F.lit(row[0]) for row in K.ACTIONS])
    return entities.withColumn("a", F.explode(ids)).withColumns(policy_factors(F.col("a")))


def step_transition(
    df: DataFrame,
    beta: Column | float = K.BASE_BETA,
    gamma: Column | float = K.BASE_GAMMA,
    ifr: Column | float = K.BASE_IFR,
    noise: Column | float = K.BASE_NOISE,
) -> DataFrame:
    """Adds `next`: the state one step later, given the noise draw in column z.

    Rows carry the state columns, action `a`, `z` and the profile columns
    beta_mul, ifr_mul, noise, healthcare, connectivity and resilience.
    """
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    rows = df.withColumns({f"_{k}": v for k, v in policy_factors(S.action_id(F.col("a"))).items()})
    rows = rows.withColumns({f"_{c}": S.whole(F.col(c)) for c in "sirdv"})
    rows = rows.withColumns(
        {
            "_cap": F.col("hosp_cap") * F.col("_cap_factor"),
            "_mix": S.at_least_one((F.col("_s") + F.col("_i") + F.col("_r")).cast("double")),
            "_stoch": 1.0 + as_col(noise) * (0.2 + F.col("noise") * 1.5) * F.col("z"),
        }
    )
    sick = F.when(F.col("_i") > F.col("_cap"), F.lit(6.0)).otherwise(F.lit(1.0))
    rows = rows.withColumns(
        {
            "_beta": S.clamp01(as_col(beta) * F.col("beta_mul") * F.col("_beta_factor") * F.col("_stoch")),
            "_rec": S.clamp01(as_col(gamma) * F.col("_gamma_factor") * F.col("_stoch")),
            "_die": S.clamp01(as_col(ifr) * F.col("ifr_mul") * sick * F.col("_stoch")),
            "_vax": S.clamp01(F.col("_vax_rate")),
        }
    ).withColumn("_inf", S.clamp01(F.col("_beta") * (F.col("_i") / F.col("_mix"))))
    rest = lambda p, q: F.greatest(F.lit(0.0), 1.0 - F.col(p) - F.col(q))
    rows = apportion_columns(
        rows,
        {
            "_s": [
                ("_stay", rest("_inf", "_vax")),
                ("_new_inf", F.col("_inf")),
                ("_new_vax", F.col("_vax")),
            ],
            "_i": [
                ("_still", rest("_rec", "_die")),
                ("_new_rec", F.col("_rec")),
                ("_new_die", F.col("_die")),
            ],
        },
    )
    rows = rows.withColumns(
        {
            "_s2": F.col("_s") - F.col("_new_inf") - F.col("_new_vax"),
            "_i2": F.col("_still") + F.col("_new_inf"),
            "_r2": F.col("_r") + F.col("_new_rec"),
            "_d2": F.col("_d") + F.col("_new_die"),
            "_v2": F.col("_v") + F.col("_new_vax"),
        }
    )
    total = lambda cols: sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    residual = total(["_s", "_i", "_r", "_d", "_v"]) - total(["_s2", "_i2", "_r2", "_d2", "_v2"])
    s2 = F.when(residual != 0, F.greatest(F.lit(0), F.col("_s2") + residual)).otherwise(F.col("_s2"))
    state = F.struct(
        s2.cast("double").alias("s"),
        *[F.col(f"_{c}2").cast("double").alias(c) for c in "irdv"],
        F.col("_cap").alias("hosp_cap"),
        (F.col("t") + 1).cast("int").alias("t"),
        "t_max",
        "seed",
    )
    # a generator, as later filters on the state would otherwise be pushed down
    # with copies of the whole step
    return rows.select(*df.columns, F.explode(F.array(state)).alias("next"))


def action_cost(a: Column) -> Column:
    moves_less = (a == K.LOCKDOWN) | (a == K.TRAVEL_BAN)
    mobility = F.when(moves_less, 1.0 + (1.0 - F.col("resilience")) * 2.0).otherwise(F.lit(1.0))
    return S.action_base_cost(a) * S.band(F.col("gdp"), K.GDP_COST_FACTOR) * mobility * 30.0


def action_bonus(a: Column) -> Column:
    return (
        F.when(a == K.LOCKDOWN, 0.05 * F.col("resilience"))
        .when(a == K.TRAVEL_BAN, 0.03 * F.col("connectivity"))
        .when(a == K.DISTANCING, F.lit(0.02))
        .when(a == K.TARGETED_VAX, 0.02 * F.col("healthcare"))
        .when(a == K.MASS_VAX, 0.04 * F.col("healthcare"))
        .otherwise(F.lit(0.0))
    )


def reward_main(
    s: str = "s", s2: str = "s2", action: str = "a", risk: float = 0.0, clip: float = K.REWARD_CLIP
) -> Column:
    """Reward of a transition between two state structs, clipped to [-3c, c]."""
    a = S.action_id(F.col(action))
    n = S.at_least_one(S.living_total(s2))
    hw = S.band(F.col("healthcare"), K.HEALTH_WEIGHT_MAIN)
    hc = S.band(F.col("healthcare"), K.HEALTHCARE_FACTOR)
    gdp = S.band(F.col("gdp"), K.GDP_FACTOR)
    use = F.col(f"{s2}.i") / S.at_least_one(F.col(f"{s2}.hosp_cap"))
    infection = (
        (F.col(f"{s2}.i") - F.col(f"{s}.i")) / n * 200.0
        * S.band(F.col("density"), K.DENSITY_FACTOR) * hw * gdp
    )
    mortality = (
        (F.col(f"{s2}.d") - F.col(f"{s}.d")) / n * 2000.0 * (1.0 + F.col("elderly") * 8.0) * hc * hw
    )
    overflow = F.greatest(F.lit(0.0), use - 1.0) * 1000.0 * hw * hc
    cost = action_cost(a) * (1.0 - hw) * gdp
    base = -(infection + mortality + overflow + cost)
    return S.clip_reward(base * F.lit(1.0 + 0.75 * risk) + F.lit(risk) * action_bonus(a), clip)


def reward_country(s: str = "s", s2: str = "s2", action: str = "a") -> Column:
    """Reward from bed load, economic cost of the policy, and deaths."""
    hw = S.band(F.col("healthcare"), K.HEALTH_WEIGHT_COUNTRY)
    load = S.healthcare_load(F.col(f"{s}.i"), F.col("beds_per_1k"), F.col("pop"))
    care = F.when(load > 1.0, (load - 1.0) * 10.0 * hw).otherwise(F.lit(0.0))
    economy = S.action_stringency(F.col(action)) * (F.col("gdp") / 50000.0) * (1.0 - hw)
    deaths = (F.col(f"{s2}.d") - F.col(f"{s}.d")) * F.col("ifr_mul") * hw * (1.0 + F.col("elderly"))
    return -(care + economy + deaths)
