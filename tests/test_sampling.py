from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from regionflow.operators import sampling
from regionflow.schemas import TRANSITION


def state(n):
    return {"s": 1000.0 - n, "i": float(n), "r": 0.0, "d": 0.0, "v": 0.0, "hosp_cap": 100.0, "t": n, "t_max": 999, "seed": 1}


@pytest.fixture(scope="module")
def transitions(spark):
    rows = [(state(n), n % 3, float(n), state(n + 1), False) for n in range(16)]
    return spark.createDataFrame(rows, TRANSITION).withColumn("seq", F.col("s.t"))


def test_newest_rows_survive(transitions):
    got = sampling.keep_last_n(transitions.filter("seq < 8"), 4)
    assert {int(r["s"]["i"]) for r in got.collect()} == {4, 5, 6, 7}


@pytest.mark.parametrize("n", [1, 7, 10, 95, 500])
@pytest.mark.parametrize("chunk", [1, 10, 1000])
def test_keep_last_n_by_key(spark, n, chunk):
    df = spark.range(300).select((F.col("id") % 3 == 0).alias("k"), (F.col("id") * 3 + 1).alias("seq"))
    got = sampling.keep_last_n(df, n, "seq", ["k"], chunk).collect()
    for key in (True, False):
        mine = [3 * v + 1 for v in range(300) if (v % 3 == 0) is key]
        assert sorted(r["seq"] for r in got if r["k"] is key) == mine[-n:]


def test_sample_is_the_same_for_the_same_seed(transitions):
    a = sampling.sample_n(transitions, 12, 123, "seq")
    b = sampling.sample_n(transitions.repartition(5), 12, 123, "seq")
    pick = lambda df: sorted(r["seq"] for r in df.collect())
    assert pick(a) == pick(b) and len(set(pick(a))) == 12
    assert pick(sampling.sample_n(transitions, 12, 124, "seq")) != pick(a)
    assert len(pick(sampling.sample_n(transitions, 99, 1, "seq"))) == 16


def test_sample_n_of_a_big_table(spark):
    got = sampling.sample_n(spark.range(150_000), 70_001, 9)
    assert got.count() == 70_001 and got.distinct().count() == 70_001


@pytest.mark.parametrize("fanout", [3, 10, 1000])
@pytest.mark.parametrize("stride", [1, 3_000_000_000])
def test_weighted_sample_against_a_scan(table, fanout, stride):
    rng = random.Random(8)
    tds = [rng.uniform(-3, 3) if n != 40 else 900.0 for n in range(90)] + [0.0] * 10
    draws = [(d, rng.random()) for d in range(95)] + [(95, 0.0), (96, 1.0), (150, 0.5)]
    got = sampling.weighted_sample(
        table([(n * stride, x) for n, x in enumerate(tds)], "id BIGINT, td DOUBLE"),
        table(draws, "draw_id BIGINT, u DOUBLE"),
        fanout=fanout,
    )
    found = {r["draw_id"]: r for r in got.collect()}
    prio = [(abs(x) + 1e-6) ** 0.6 for x in tds]
    total = sum(prio)
    assert set(found) == {d for d, _ in draws}
    for d, u in draws:
        acc, picked = 0.0, len(prio) - 1
        for n, p in enumerate(prio):
            acc += p
            if acc >= u * total * (1 - 1e-12):
                picked = n
                break
        assert found[d]["id"] == picked * stride
        assert found[d]["weight"] == pytest.approx((len(prio) * prio[picked] / total) ** -0.4)


def test_draws_meet_few_nodes_and_are_spread(spark, table):
    """Draws from one file: no task takes them all past every node, and none is lost where one row has most of the weight."""
    tds = [1e9 if n == 77 else 0.0 if n % 3 else n / 7 for n in range(500)]
    rows = table(list(enumerate(tds)), "id BIGINT, td DOUBLE")
    near = F.when(F.col("id") % 2 == 0, F.col("id") / 999).otherwise(F.pow(F.lit(10.0), -F.col("id") / 70))
    draws = spark.range(0, 500, 1, 1).select(F.col("id").alias("draw_id"), near.alias("u"))
    got = sampling.weighted_sample(rows, draws, fanout=8)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in text and "hashpartitioning(draw_id" in text
    sums, acc = [], 0.0
    for x in tds:
        acc += (abs(x) + 1e-6) ** 0.6
        sums.append(acc)
    found = {r["draw_id"]: r["id"] for r in got.collect()}
    assert len(found) == 500 == got.count() and len(set(found.values())) > 20
    for r in draws.collect():
        goal, n = r["u"] * acc, found[r["draw_id"]]
        assert (n == 0 or sums[n - 1] <= goal * (1 + 1e-9)) and goal <= sums[n] * (1 + 1e-9)
    children = sampling._children(table([(n, 1.0) for n in range(64)] + [(64, 1e9)], "node BIGINT, p DOUBLE"), 256)
    assert sampling._in_cells(children, 256).count() < 2 * (256 + 65)


def test_tiny_priorities_fall_back_to_the_first_row(table):
    rows = table([(0, 0.0), (1, 0.0)], "id BIGINT, td DOUBLE")
    draws = table([(0, 0.9), (1, 0.0)], "draw_id BIGINT, u DOUBLE")
    got = sampling.weighted_sample(rows, draws, alpha=3.0)
    assert {r["id"] for r in got.collect()} == {0}


def test_draws_are_limited_by_count_not_by_id(table):
    rows = table([(n, 1.0) for n in range(3)], "id BIGINT, td DOUBLE")
    draws = table([(d, 0.5) for d in (7, 100, 3, 2_000_000_000, 50)], "draw_id BIGINT, u DOUBLE")
    assert {r["draw_id"] for r in sampling.weighted_sample(rows, draws).collect()} == {3, 7, 50}


@pytest.mark.parametrize("bad", [-1, None])
def test_bad_slots_are_an_error(table, bad):
    rows = table([(0, 1.0), (bad, 1.0)], "id BIGINT, td DOUBLE")
    draws = table([(0, 0.5)], "draw_id BIGINT, u DOUBLE")
    with pytest.raises(Exception, match="missing or negative"):
        sampling.weighted_sample(rows, draws).collect()


def test_no_rows_serve_no_draws(table):
    draws = table([(0, 0.5)], "draw_id BIGINT, u DOUBLE")
    assert sampling.weighted_sample(table([], "id BIGINT, td DOUBLE"), draws).count() == 0


def test_null_keys_and_slots_are_kept(table):
    rows = table([("a", 1), ("a", 2), (None, 3), (None, 4), (None, None), ("b", None)], "k STRING, seq INT")
    got = sorted((r["k"] or "", r["seq"] or 0) for r in sampling.keep_last_n(rows, 2, "seq", ["k"], 1).collect())
    assert got == [("", 3), ("", 4), ("a", 1), ("a", 2), ("b", 0)]
    assert sampling.keep_last_n(rows, 6, "seq", chunk=1).count() == 6
    assert {r["seq"] for r in sampling.keep_last_n(rows, 3, "seq", chunk=1).collect()} == {2, 3, 4}


def test_last_priority_wins(table):
    prio = table([(0, 1.0), (1, 2.0)], "id BIGINT, p DOUBLE")
    updates = table([(1, 5.0, 0), (1, -2.0, 1), (9, 1.0, 2)], "id BIGINT, td DOUBLE, seq BIGINT")
    got = {r["id"]: r["p"] for r in sampling.update_priorities(prio, updates).collect()}
    assert got == {0: 1.0, 1: pytest.approx((2 + 1e-6) ** 0.6)}
