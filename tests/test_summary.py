from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from regionflow.operators import calibrate, reshape, scan, summary
from regionflow.operators.quality import check_finite
from regionflow.sources.tables import rows_to_df

ROWS = "entity STRING, step INT, reward DOUBLE"


def loop(values, alpha, seed_first=False):
    e, out = 0.0, []
    for x in values:
        e = x if seed_first and e == 0.0 else alpha * x + (1 - alpha) * e
        out.append(e)
    return out


def test_ema_value(table):
    df = table([("a", n, float(n + 1)) for n in range(3)], ROWS)
    assert summary.ema(df).filter("step = 2").first()["ema"] == pytest.approx(1.048)


@pytest.mark.parametrize("chunk", [1, None])
@pytest.mark.parametrize("alpha", [0.0, 0.2, 0.9, 1.0])
@pytest.mark.parametrize("seed_first", [False, True])
def test_ema_equals_the_loop(table, chunk, alpha, seed_first):
    rng = random.Random(1)
    steps = sorted(rng.sample(range(0, 4000, 2), 300))
    data = {
        "a": [(s, rng.uniform(-5, 9)) for s in steps],
        "b": [(s, 0.0 if n < 7 else rng.random()) for n, s in enumerate(steps[::3])],
        "c": [(5000, 3.0)],
    }
    df = table([(k, s, x) for k, rows in data.items() for s, x in rows], ROWS)
    got = summary.ema(df, alpha=alpha, every=2, seed_first=seed_first, chunk=chunk)
    found = {(r["entity"], r["step"]): r["ema"] for r in got.collect()}
    for key, rows in data.items():
        expected = loop([x for _, x in rows], alpha, seed_first)
        for (step, _), e in zip(rows, expected, strict=True):
            assert found[key, step] == pytest.approx(e, rel=1e-9, abs=1e-12)


def test_ema_skips_other_steps(table):
    df = table([("a", n, 1.0 if n % 50 == 0 else 99.0) for n in range(151)], ROWS)
    got = [r["ema"] for r in summary.ema(df, every=50).orderBy("step").collect()]
    assert got == pytest.approx(loop([1.0] * 4, 0.2))


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_running_mean(table, chunk):
    rng = random.Random(2)
    data = [(e, t, rng.random()) for e in (1, 2) for t in range(30)]
    df = table(data, "epoch INT, t INT, loss DOUBLE")
    found = {(r["epoch"], r["t"]): r["running_mean"] for r in summary.running_mean(df, chunk=chunk).collect()}
    for e, t, _ in data:
        so_far = sum(x for f, u, x in data if f == e and u <= t)
        assert found[e, t] == pytest.approx(so_far / max(1, t + 1))


def test_reward_spread(table):
    df = table([("a", 1, 2.0), ("b", 1, 4.0), ("a", 2, -1.0), ("b", 2, 1.0)], ROWS)
    got = {r["step"]: r for r in summary.reward_spread(df).collect()}
    assert got[1]["mean"] == 3.0 and got[1]["variance"] == 1.0 and got[1]["range"] == 2.0
    assert got[1]["cv"] == pytest.approx(1 / 3) and got[2]["cv"] == 0.0


def test_epoch_entity_summary_takes_the_last_step(table):
    schema = "epoch INT, step INT, entity STRING, reward DOUBLE, s DOUBLE, i DOUBLE, d DOUBLE, eps DOUBLE"
    data = [(1, n, "a", float(n), 10.0 - n, float(n), 2.0 * n, 1 / (n + 1)) for n in range(6)]
    random.Random(4).shuffle(data)
    got = summary.epoch_entity_summary(rows_to_df(table([], ROWS).sparkSession, data, schema).repartition(3)).first()
    assert (got["avg_reward"], got["final_s"], got["final_i"], got["final_d"]) == (2.5, 5.0, 5.0, 10.0)
    assert got["epsilon"] == pytest.approx(1 / 6)


def test_epoch_totals_use_the_configured_steps(table):
    df = table([(1, 2.0, 3.0), (1, 1.0, 7.0)], "epoch INT, reward DOUBLE, loss DOUBLE")
    got = summary.epoch_totals(df, 500).first()
    assert got["total_reward"] == 3.0 and got["avg_loss"] == pytest.approx(10 / 500)
    assert summary.epoch_totals(df, 0).first()["avg_loss"] == 10.0


def test_rmse(table):
    df = table([(3.0,), (4.0,)], "x DOUBLE")
    assert df.agg(calibrate.rmse(F.col("x"))).first()[0] == pytest.approx(math.sqrt(12.5))
    assert df.filter("x > 9").agg(calibrate.rmse(F.col("x"))).first()[0] == 0.0


TRAJECTORY = "beta DOUBLE, travel DOUBLE, entity STRING, t INT, value DOUBLE"


def test_no_targets_no_loss(spark, table):
    grid = calibrate.param_grid(spark, [0.24, 0.26], [0.8, 1.0])
    data = [(b, s, e, t, 1000 * b * s * t) for b in (0.24, 0.26) for s in (0.8, 1.0) for e in "xy" for t in range(9)]
    none = table([], "entity STRING, t_arrive DOUBLE, peak DOUBLE")
    surface = calibrate.loss_surface(table(data, TRAJECTORY), none)
    assert surface.count() == 4 and surface.filter("loss <> 0").isEmpty() and check_finite(surface).isEmpty()
    assert tuple(calibrate.best_cell(surface, grid).first()) == (0.24, 0.8, 0.0)


def test_loss_of_a_cell(table):
    data = [(0.2, 1.0, "x", t, v) for t, v in enumerate([0.0, 10.0, 30.0])]
    data += [(0.2, 1.0, "y", t, v) for t, v in enumerate([0.0, 0.0, 5.0])]
    targets = table([("x", 3.0, 20.0)], "entity STRING, t_arrive DOUBLE, peak DOUBLE")
    got = calibrate.loss_surface(table(data, TRAJECTORY), targets).first()["loss"]
    assert got == pytest.approx(0.5 * math.sqrt(4 / 2) + 0.5 * math.sqrt(100 / 2))


SURFACE = "beta DOUBLE, travel DOUBLE, loss DOUBLE"


def test_best_cell_rules(spark, table):
    grid = calibrate.param_grid(spark, [0.1, 0.2], [1.0, 2.0])
    nan, inf = float("nan"), float("inf")
    tie = table([(0.2, 1.0, 3.0), (0.1, 2.0, 3.0), (0.1, 1.0, nan), (0.2, 2.0, inf)], SURFACE)
    assert tuple(calibrate.best_cell(tie, grid).first()) == (0.1, 2.0, 3.0)
    none = calibrate.best_cell(table([(0.1, 1.0, nan)], SURFACE), grid).first()
    assert tuple(none)[:2] == (0.1, 1.0) and none["loss"] > 1e300
    empty = calibrate.best_cell(table([], SURFACE), calibrate.param_grid(spark, [], [])).first()
    assert tuple(empty)[:2] == (0.25, 1.0) and empty["loss"] > 1e300


def test_grid_is_beta_major(spark):
    rows = calibrate.param_grid(spark).orderBy("grid_pos").collect()
    assert len(rows) == 20 and tuple(rows[1]) == (1, 0.24, 0.6) and tuple(rows[5]) == (5, 0.25, 0.5)


def test_surface_pivot(table):
    df = table([(0.2, 1.0, 5.0), (0.1, 1.0, 3.0), (0.1, 2.0, 4.0)], SURFACE)
    got = [tuple(r) for r in reshape.surface_pivot(df, [1.0, 2.0]).collect()]
    assert got == [(0.1, 3.0, 4.0), (0.2, 5.0, None)]
    twice = table([(0.1, 1.0, 3.0), (0.1, 1.0, 3.0)], SURFACE)
    with pytest.raises(Exception, match="more than one loss"):
        reshape.surface_pivot(twice, [1.0]).collect()


def test_last_write_wins(table):
    log = table(
        [("r", 1, "a", 1.0, 0), ("r", 1, "a", 2.0, 5), ("r", 1, "b", 3.0, 1), ("r", 2, "c", 9.0, 2)],
        "run STRING, step BIGINT, key STRING, value DOUBLE, seq BIGINT",
    )
    wide = reshape.metrics_wide(log, ["a", "b", "c"])
    assert sorted(tuple(r) for r in wide.collect()) == [(1, 2.0, 3.0, None), (2, None, None, 9.0)]
    long = reshape.metrics_long(wide, ["step"])
    assert sorted(tuple(r) for r in long.collect()) == [(1, "a", 2.0), (1, "b", 3.0), (2, "c", 9.0)]


@pytest.mark.parametrize("chunk", [1, 3, None])
def test_null_keys_and_steps_are_averaged_too(table, chunk):
    rows = [(None, 1, 4.0), (None, 2, 8.0), ("a", 1, 2.0), ("a", None, 6.0)]
    got = {(r["entity"], r["step"]): r["ema"] for r in summary.ema(table(rows, ROWS), alpha=0.5, chunk=chunk).collect()}
    assert got == {(None, 1): 2.0, (None, 2): 5.0, ("a", None): 3.0, ("a", 1): 2.5}
    losses = table([(None, 0, 1.0), (None, 1, 3.0), (1, None, 5.0), (1, 0, 7.0)], "epoch INT, t INT, loss DOUBLE")
    means = {(r["epoch"], r["t"]): r["running_mean"] for r in summary.running_mean(losses, chunk=1).collect()}
    assert means == {(None, 0): 1.0, (None, 1): 2.0, (1, None): 5.0, (1, 0): 12.0}


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_ema_over_many_levels_of_chunks(table, monkeypatch, fan):
    monkeypatch.setattr(scan, "FAN", fan)
    rng = random.Random(3)
    data = [(n * 7 if n % 5 else n * 7 + 3, rng.random()) for n in range(200)]
    got = summary.ema(table([("a", n, x) for n, x in data], ROWS), chunk=3).orderBy("step").collect()
    assert [r["ema"] for r in got] == pytest.approx(loop([x for _, x in data], 0.2))
    total = summary.running_mean(table([(1, n, x) for n, x in data], "epoch INT, t INT, loss DOUBLE"), chunk=2).orderBy("t").collect()
    so_far = 0.0
    for r, (n, x) in zip(total, data, strict=True):
        so_far += x
        assert r["running_mean"] == pytest.approx(so_far / (n + 1))


def test_one_key_over_many_chunks(spark):
    """50,000 chunk ends of one key: no task reads more than 10,000 of them, and the values are those of a loop."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("a").alias("entity"), F.col("id").alias("step"), ((F.col("id") * 7919) % 1000 / 1000.0).alias("reward"))
    out = summary.ema(rows, chunk=20)
    got = {r["step"]: r["ema"] for r in out.filter("step % 99991 = 0 OR step = 999999").collect()}
    e = 0.0
    for k in range(n):
        e = 0.2 * ((k * 7919) % 1000 / 1000.0) + 0.8 * e
        if k in got:
            assert got.pop(k) == pytest.approx(e, rel=1e-9)
    assert not got


def test_levels_are_dealt_to_many_tasks(spark):
    ends = spark.range(50_000).select(F.struct(F.struct(F.lit("a").alias("k")).alias("key"), F.col("id").alias("chunk")).alias("_at"), F.lit(0.5).alias("a"), F.lit(1.0).alias("b"))
    assert scan.entering(ends).filter("_in >= 1.99").count() == 50_000 - 8
    cut = ends.select(F.struct(F.floor(F.col("_at.chunk") / scan.FAN)).alias("_block")).repartition(-(-50_000 // scan.TASK_ROWS) * 2, "_block")
    assert max(r["n"] for r in cut.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) <= 10_000


def test_variation_of_a_zero_mean_is_zero(table):
    rows = table([("a", 1, 0.1), ("b", 1, 0.2), ("c", 1, -0.3)], ROWS)
    exact = summary.reward_spread(rows.withColumn("reward", F.col("reward").cast("decimal(18,4)"))).first()
    assert (exact["mean"], exact["cv"]) == (0.0, 0.0)


def test_unlisted_keys_and_travels_are_errors(table):
    log = table([(1, "a", 1.0, 0), (1, "b", 2.0, 1)], "step INT, key STRING, value DOUBLE, seq INT")
    assert reshape.log_keys(log) == ["a", "b"]
    with pytest.raises(Exception, match="unlisted key b"):
        reshape.metrics_wide(log, ["a"]).collect()
    surface = table([(0.2, 0.5, 1.0), (0.2, 0.6, 2.0)], "beta DOUBLE, travel DOUBLE, loss DOUBLE")
    with pytest.raises(Exception, match="unlisted travel 0.6"):
        reshape.surface_pivot(surface, [0.5]).collect()


def test_entity_keys(table):
    got = reshape.entity_keys(table([("a", 3, 1.5), ("b", 3, None)], ROWS), {"reward": "toy_rew_{}"}).collect()
    assert [(r["step"], r["key"], r["value"]) for r in got] == [(3, "toy_rew_a", 1.5)]
