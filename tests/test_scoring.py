from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionflow import constants as K
from regionflow.functions import scalar as S
from regionflow.functions import vectors
from regionflow.operators import quality, scoring
from regionflow.schemas import STATE_FIELDS
from regionflow.sources import tables

STATE = "s DOUBLE, i DOUBLE, r DOUBLE, d DOUBLE, v DOUBLE, hosp_cap DOUBLE, t INT, t_max INT, seed INT"
ROW = f"entity STRING, a INT, z DOUBLE, {STATE}"
START = (1000000.0, 1000.0, 0.0, 0.0, 0.0, 10000.0, 0, 10, 1)


def stepped(spark, table, rows, **rates):
    df = scoring.lookup_profile(table(rows, ROW), tables.profiles(spark))
    return {(r["entity"], r["a"]): r["next"] for r in scoring.step_transition(df, **rates).collect()}


def test_unknown_entity_gets_the_default_profile(spark, table):
    df = table([("Japan",), ("Atlantis",)], "entity STRING")
    got = {r["entity"]: r for r in scoring.lookup_profile(df, tables.profiles(spark)).collect()}
    assert got["Japan"]["beds_per_1k"] == 13.1 and got["Japan"]["elderly"] == 0.30
    assert {c: got["Atlantis"][c] for c in K.DEFAULT_PROFILE} == K.DEFAULT_PROFILE


def test_regions_differ_after_one_step(spark, table):
    world = {row[1]: row for row in K.WORLD}
    beta = F.when(F.col("entity") == "China", 0.26 * world["China"][6]).otherwise(0.26 * world["Japan"][6])
    got = stepped(spark, table, [("China", 0, 0.1, *START), ("Japan", 0, 0.1, *START)], beta=beta)
    assert got["China", 0]["i"] != got["Japan", 0]["i"]


def test_one_step_by_hand(spark, table):
    """Default profile, no noise: 350 infected, 120 recover and 8 die of 1000."""
    got = stepped(spark, table, [("Nowhere", 0, 0.0, *START)])["Nowhere", 0]
    p = 0.35 * 1000 / 1001000
    infected = round(1000000 * p)
    assert (got["s"], got["i"]) == (1000000 - infected, 1000 - 128 + infected)
    assert (got["r"], got["d"], got["v"], got["t"]) == (120.0, 8.0, 0.0, 1)


def test_policies_and_surge(spark, table):
    full = (900000.0, 50000.0, 10.4, 0.0, 5.0, 10000.0, 3, 10, 1)
    rows = [("India", a, 0.5, *full) for a in range(8)]
    got = stepped(spark, table, rows)
    for a in range(8):
        assert sum(got["India", a][c] for c in "sirdv") == 900000 + 50000 + 10 + 5
    assert got["India", 5]["hosp_cap"] == pytest.approx(10000 * 1.3)
    assert got["India", 3]["i"] < got["India", 1]["i"] < got["India", 0]["i"]
    assert got["India", 6]["v"] == 5 + round(900000 * 0.02 * 0.3)
    assert got["India", 7]["v"] > got["India", 6]["v"] and got["India", 5]["r"] > got["India", 0]["r"]


def test_action_tables(table):
    df = table([(-4,), (0,), (3,), (7,), (12,)], "a INT")
    a = F.col("a")
    got = df.select(S.action_label(a), S.action_stringency(a), S.action_base_cost(a)).collect()
    assert [tuple(r) for r in got] == [
        ("None", 0.0, 0.0), ("None", 0.0, 0.0), ("Lockdown", 0.8, 0.15), ("MassVax", 0.15, 0.05), ("MassVax", 0.15, 0.05),
    ]


def test_bands_are_strict(table):
    df = table([(0.8,), (0.81,), (0.5,), (0.51,)], "x DOUBLE")
    got = [r[0] for r in df.select(S.band(F.col("x"), K.HEALTH_WEIGHT_MAIN)).collect()]
    assert got == [0.6, 0.2, 0.9, 0.6]


def test_features_leave_vaccinated_out_of_n(table):
    df = table([(90.0, 10.0, 0.0, 0.0, 50.0, 5.0, 3, 12, 0)], STATE)
    assert df.select(S.state_features()).first()[0] == [0.9, 0.1, 0.0, 0.0, 0.5, 2.0, 0.25]


def test_terminal(table):
    rows = [
        (100.0, 5.0, 0.0, 0.0, 0.0, 1.0, 10, 10, 0),
        (1e6, 1.0, 0.0, 0.0, 0.0, 1.0, 1, 10, 0),
        (90.0, 5.0, 0.0, 5.0, 0.0, 1.0, 1, 10, 0),
        (95.0, 5.0, 0.0, 0.0, 0.0, 1.0, 1, 10, 0),
    ]
    got = [r[0] for r in table(rows, STATE).select(S.is_terminal()).collect()]
    assert got == [True, True, True, False]


def _pair(table, spark, entity, a, before, after):
    names = STATE_FIELDS
    df = table([(entity, a, *before, *after)], "entity STRING, a INT, "
               + ", ".join(f"{p}_{c} {'INT' if c in ('t', 't_max', 'seed') else 'DOUBLE'}" for p in "xy" for c in names))
    both = df.select(
        "entity", "a",
        F.struct(*[F.col(f"x_{c}").alias(c) for c in names]).alias("s"),
        F.struct(*[F.col(f"y_{c}").alias(c) for c in names]).alias("s2"),
    )
    return scoring.lookup_profile(both, tables.profiles(spark))


def test_rewards_by_hand(spark, table):
    before = (900.0, 100.0, 0.0, 0.0, 0.0, 50.0, 0, 10, 1)
    after = (880.0, 110.0, 5.0, 5.0, 0.0, 50.0, 1, 10, 1)
    df = _pair(table, spark, "Germany", 3, before, after)
    got = df.select(
        scoring.reward_main(clip=1e9).alias("wide"), scoring.reward_main().alias("main"), scoring.reward_country().alias("own"),
        scoring.action_cost(F.col("a")).alias("cost"), scoring.action_bonus(F.col("a")).alias("bonus"),
    ).first()
    cost = 0.15 * 1.0 * (1 + 0.15 * 2) * 30
    base = -(0.01 * 200 * 2 * 0.2 * 1 + 0.005 * 2000 * 3 * 0.2 * 0.2 + 1.2 * 1000 * 0.2 * 0.2 + cost * 0.8 * 1)
    assert got["cost"] == pytest.approx(cost) and got["bonus"] == pytest.approx(0.05 * 0.85)
    assert got["wide"] == pytest.approx(base) and got["main"] == -15.0
    assert got["own"] == pytest.approx(-(0.8 * 46000 / 50000 * 0.7 + 5 * 0.8 * 0.3 * 1.25))


def test_parameters(spark, table):
    df = scoring.lookup_profile(table([("USA",), ("Oz",)], "entity STRING"), tables.profiles(spark))
    run = scoring.run_parameters(df.join(tables.run_multipliers(spark), "entity", "left"), 0.25)
    got = {r["entity"]: r for r in run.collect()}
    assert got["USA"]["beta"] == pytest.approx(0.25 * 1.1 * (1 + 36 / 500 * 0.3) * (2 - 0.85 * 0.8))
    assert got["Oz"]["env_noise"] == pytest.approx(0.05 * (1 + 0.3 * 0.8))
    cal = {r["entity"]: r for r in scoring.calibration_parameters(df, 0.25).collect()}
    assert cal["USA"]["beta"] == pytest.approx(0.25 * (1 + 0.036 * 0.5) * (3 - 1.7))
    assert cal["Oz"]["ifr"] == pytest.approx(0.008 * 1.3)


def test_argmax_takes_the_first(table):
    df = table([([1.0, 5.0, 5.0],), ([-2.0],)], "q ARRAY<DOUBLE>")
    assert [r[0] for r in df.select(vectors.argmax(F.col("q"))).collect()] == [1, 0]


def test_td_target(table):
    schema = "q ARRAY<DOUBLE>, a INT, r DOUBLE, done BOOLEAN, n ARRAY<DOUBLE>, t ARRAY<DOUBLE>"
    df = table([([0.0, 1.0], 1, 2.0, False, [3.0, 1.0], [4.0, 9.0]), ([0.0, 1.0], 0, 99.0, True, [3.0, 1.0], [4.0, 9.0])], schema)
    c = F.col
    got = [r[0] for r in df.select(vectors.td_target(c("q"), c("a"), c("r"), c("done"), c("n"), c("t"))).collect()]
    assert got[0] == pytest.approx([0.0, 2 + 0.99 * 4]) and got[1] == [10.0, 1.0]


def test_score_dense(spark, table):
    rng = np.random.default_rng(5)
    layers = [(rng.normal(size=(6, 7)), rng.normal(size=6)), (rng.normal(size=(6, 6)), rng.normal(size=6)), (rng.normal(size=(8, 6)), rng.normal(size=8))]
    rows = [(n, *row[1:]) for n, row in enumerate(K.EVALUATION_STATES)]
    df = table(rows, f"n INT, {STATE}").withColumn("x", S.state_features())
    got = {r["n"]: r for r in df.select("n", "x", vectors.score_dense(F.col("x"), layers, 3.0).alias("y")).collect()}
    for r in got.values():
        x = np.array(r["x"])
        for k, (w, b) in enumerate(layers):
            x = w @ x + b
            x = np.maximum(x, 0) if k < 2 else np.clip(x, -3, 3)
        assert r["y"] == pytest.approx(list(x))


def test_state_checks(table):
    rows = [(10, 9.0, 1.0, 0.0, 0.0, 0.0, 10.0, 0, 10, 1), (10, 9.0, -1.0, 2.0, 0.0, 0.0, 10.0, 0, 10, 1),
            (11, 9.0, 1.0, 0.0, 0.0, 0.0, 10.0, 0, 10, 1), (10, 9.0, 1.0, 0.0, 0.0, 0.0, 10.0, 11, 10, 1)]
    bad = quality.check_state(table(rows, f"pop INT, {STATE}"))
    assert sorted(r["reason"] for r in bad.collect()) == ["mass not conserved", "negative compartment", "t out of bounds"]
    quality.require_empty(quality.check_state(table(rows[:1], f"pop INT, {STATE}")), "state")
    with pytest.raises(ValueError, match="state"):
        quality.require_empty(bad, "state")


def test_local_mass_after_a_step(spark, table):
    rows = [(e, a, z, *START) for e in ("India", "Japan", "Oz") for a in range(8) for z in (-1.0, 2.0)]
    df = scoring.step_transition(scoring.lookup_profile(table(rows, ROW), tables.profiles(spark)))
    pairs = df.select(F.struct(*STATE_FIELDS).alias("s"), F.col("next").alias("s2"))
    assert quality.check_local_mass(pairs).isEmpty()


def test_same_rows(spark):
    a = spark.range(100).select((F.col("id") % 7).alias("x"))
    assert quality.same_rows(a, a.repartition(5))
    diff = quality.row_differences(a, a.limit(99).union(spark.range(1).select(F.lit(55).cast("bigint").alias("x"))))
    assert sorted(r["surplus"] for r in diff.collect()) == [-1, 1]


def test_finite(table):
    df = table([(1.0,), (None,), (float("nan"),), (float("-inf"),)], "loss DOUBLE")
    assert quality.check_finite(df).count() == 3
