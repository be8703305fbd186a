"""Scalar column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionflow import constants as K


def clean_value(value: Column) -> Column:
    """Negative, NaN and null all become 0."""
    value = F.nanvl(value, F.lit(0.0))
    return F.coalesce(F.when(value < 0, F.lit(0.0)).otherwise(value), F.lit(0.0))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """x held within [low, high]; null and NaN stay as they are."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(low, F.least(high, x)))


def clamp01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def clip_reward(x: Column, c: float = K.REWARD_CLIP) -> Column:
    """The penalty side is three times as wide as the gain side."""
    return clamp(x, -3.0 * c, c)


def clip_q(x: Column, c: float = 10.0) -> Column:
    return clamp(x, -c, c)


def at_least_one(x: Column) -> Column:
    return F.greatest(F.lit(1.0), x)


def whole(x: Column) -> Column:
    """Rounded half up, never negative, as BIGINT."""
    return F.greatest(F.lit(0), F.floor(x + F.lit(0.5))).cast("bigint")


def band(x: Column, bands: tuple[Sequence[tuple[float, float]], float]) -> Column:
    """The value of the first bound that x is strictly above."""
    steps, rest = bands
    out = None
    for bound, value in steps:
        above = x > F.lit(bound)
        out = F.when(above, F.lit(value)) if out is None else out.when(above, F.lit(value))
    return F.lit(rest) if out is None else out.otherwise(F.lit(rest))


def action_id(a: Column) -> Column:
    """An action id clamped to the known actions."""
    return F.greatest(F.lit(0), F.least(F.lit(K.MAX_ACTION), a)).cast("int")


def action_level(a: Column) -> Column:
    """The action id scaled to [0, 1]."""
    return a.cast("double") / F.lit(float(K.MAX_ACTION))


def _per_action(a: Column, position: int) -> Column:
    values = F.array(*[F.lit(row[position]) for row in K.ACTIONS])
    return F.element_at(values, action_id(a) + 1)


def action_label(a: Column) -> Column:
    return _per_action(a, 1)


def action_stringency(a: Column) -> Column:
    return _per_action(a, 2)


def action_base_cost(a: Column) -> Column:
    return _per_action(a, 3)


def living_total(state: str = "") -> Column:
    """s+i+r+d; vaccinated people are counted apart."""
    p = f"{state}." if state else ""
    return F.col(f"{p}s") + F.col(f"{p}i") + F.col(f"{p}r") + F.col(f"{p}d")


def state_features(state: str = "") -> Column:
    """Seven features of a state: shares of s,i,r,d,v, bed use and elapsed time."""
    p = f"{state}." if state else ""
    n = at_least_one(living_total(state))
    shares = [F.col(f"{p}{c}") / n for c in "sirdv"]
    use = F.col(f"{p}i") / at_least_one(F.col(f"{p}hosp_cap"))
    elapsed = F.col(f"{p}t").cast("double") / at_least_one(F.col(f"{p}t_max").cast("double"))
    return F.array(*shares, use, elapsed)


def infection_rate(i: Column, s: Column) -> Column:
    return i / at_least_one(s)


def healthcare_load(i: Column, beds_per_1k: Column, pop: Column) -> Column:
    return F.try_divide(i, beds_per_1k * pop / F.lit(1000.0))


def per_capita(i: Column, pop: Column) -> Column:
    return F.try_divide(i, pop.cast("double"))


def is_terminal(state: str = "") -> Column:
    """Out of time, nearly nobody infected, or more than 2 % dead."""
    p = f"{state}." if state else ""
    n = at_least_one(living_total(state))
    return (
        (F.col(f"{p}t") >= F.col(f"{p}t_max"))
        | (F.col(f"{p}i") / n < F.lit(1e-5))
        | (F.col(f"{p}d") / n > F.lit(0.02))
    )


def linear_decay(steps: Column, start: float = 1.0, end: float = 0.1, decay: int = 100_000) -> Column:
    share = F.least(F.lit(1.0), steps.cast("double") / F.lit(float(max(1, decay))))
    return F.lit(start) + F.lit(end - start) * share


def reproduction_number(beta: Column, gamma: Column) -> Column:
    return F.when(gamma > 0, beta / gamma).otherwise(F.lit(0.0))


def mobility_reduction(rate: Column, gdp: Column, resilience: Column, policy: Column) -> Column:
    return (
        F.least(rate * F.lit(1.5), F.lit(0.9))
        * (F.least(gdp / F.lit(70000.0), F.lit(1.0)) * resilience * policy)
    )


def anneal(beta: Column, k: Column | int = 1, to: float = 1.0, rate: float = 1e-4) -> Column:
    k = k if isinstance(k, Column) else F.lit(k)
    return F.least(F.lit(to), beta + F.lit(rate) * k)


def priority(td: Column, alpha: float = 0.6) -> Column:
    return F.pow(F.abs(td) + F.lit(1e-6), F.lit(alpha))
