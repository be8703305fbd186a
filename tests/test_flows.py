from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from regionflow.operators import flows, network, quality
from regionflow.operators.apportion import apportion, apportion_columns
from regionflow.sources import tables

CASES = [
    (10, [1.0, 1.0, 1.0], [4, 3, 3]),
    (7, [0.5, 0.25, 0.25], [3, 2, 2]),
    (100, [0.0, 3.0, 3.0, 1.0], [0, 43, 43, 14]),
    (3, [0.1, 0.2, 0.3, 0.4], [0, 1, 1, 1]),
    (0, [1.0, 2.0], [0, 0]),
    (5, [0.0, 0.0], [0, 0]),
]
SCHEMA = "g INT, idx BIGINT, total BIGINT, other BIGINT, w DOUBLE"


def brute(total, weights):
    """Largest remainder, one group."""
    whole = sum(weights)
    if total <= 0 or whole <= 0:
        return [0] * len(weights)
    raw = [w / whole * total for w in weights]
    out = [math.floor(x) for x in raw]
    order = sorted(range(len(raw)), key=lambda k: (-(raw[k] - out[k]), k))
    for k in order[: total - sum(out)]:
        out[k] += 1
    return out


def shares(df, group_count, column="share"):
    got = [[] for _ in range(group_count)]
    for r in sorted(df.collect(), key=lambda r: (r["g"], r["idx"])):
        got[r["g"]].append(r[column])
    return got


@pytest.mark.parametrize("hot_rows", [None, 0, 3])
def test_apportion_values(table, hot_rows):
    rows = [(g, k, total, 0, w) for g, (total, ws, _) in enumerate(CASES) for k, w in enumerate(ws)]
    got = apportion(table(rows, SCHEMA), ["g"], {"total": "share"}, hot_rows=hot_rows)
    assert shares(got, len(CASES)) == [expected for _, _, expected in CASES]


def test_apportion_columns_values(table):
    three = [(total, ws, out) for total, ws, out in CASES if len(ws) == 3]
    df = table([(n, t, *ws) for n, (t, ws, _) in enumerate(three)], "n INT, t BIGINT, a DOUBLE, b DOUBLE, c DOUBLE")
    split = apportion_columns(df, {"t": [(f"{c}2", F.col(c)) for c in "abc"]})
    got = sorted(tuple(r) for r in split.select("n", "a2", "b2", "c2").collect())
    assert [list(r[1:]) for r in got] == [out for _, _, out in three]


@pytest.mark.parametrize("hot_rows", [None, 50, 0])
def test_apportion_against_brute_force(table, hot_rows):
    """Big, small, tied and sparse groups; two totals at once."""
    rng = random.Random(3)
    groups = [
        (123, [1.0] * 700),
        (5000, [float(rng.randrange(1, 50)) for _ in range(900)]),
        (17, [rng.random() ** 4 for _ in range(2500)]),
        (40, [float(n % 3) for n in range(60)]),
        (9, [2.0, 3.0, 5.0]),
        (0, [1.0] * 80),
    ]
    rows = [(g, 10 * k + 3, t, 3 * t + 1, w) for g, (t, ws) in enumerate(groups) for k, w in enumerate(ws)]
    rng.shuffle(rows)
    df = table(rows, SCHEMA)
    got = apportion(df, ["g"], {"total": "share", "other": "second"}, hot_rows=hot_rows).collect()
    by = lambda c: [
        [r[c] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["idx"])]
        for g in range(len(groups))
    ]
    assert by("share") == [brute(t, ws) for t, ws in groups]
    assert by("second") == [brute(3 * t + 1, ws) for t, ws in groups]


ORDER = ["USA", "Japan", "Italy", "India", "Germany", "China"]
S = [1000000, 120000, 1000000, 80000, 60000, 300000]
I = [1000, 200, 900, 100, 80, 400]


@pytest.fixture(scope="module")
def edges(spark):
    world = tables.world(spark)
    fixed = network.gravity_edges(world, tables.world_links(spark), tables.pair_multipliers(spark))
    return fixed.join(world.select(F.col("entity").alias("dst"), "idx"), "dst")


@pytest.fixture(scope="module")
def states(table):
    rows = [(n, float(s), float(i), 0.0, 0.0, 0.0, 0) for n, s, i in zip(ORDER, S, I, strict=True)]
    return table(rows, "entity STRING, s DOUBLE, i DOUBLE, r DOUBLE, d DOUBLE, v DOUBLE, t INT")


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_net_flow_values(states, edges, hot_rows):
    moves = flows.allocate_exports(flows.exports(states, edges), edges, hot_rows=hot_rows)
    net = {r["entity"]: (r["net_s"], r["net_i"]) for r in flows.net_flow(moves).collect()}
    assert [net[n][0] for n in ORDER] == [-110374, -892, -114693, 121495, 28839, 75625]
    assert [net[n][1] for n in ORDER] == [-109, -10, -102, 128, 24, 69]
    assert sum(v[0] for v in net.values()) == 0 and sum(v[1] for v in net.values()) == 0


def test_exports_are_split_completely(states, edges):
    exported = flows.exports(states, edges)
    moved = flows.allocate_exports(exported, edges, hot_rows=None).groupBy(F.col("src").alias("entity")).agg(
        F.sum("move_s").alias("out_s"), F.sum("move_i").alias("out_i")
    )
    both = exported.join(moved, "entity")
    assert both.count() == 6
    assert both.filter("out_s <> export_s OR out_i <> export_i").isEmpty()


def test_flow_step_per_scenario_keeps_mass(states, edges):
    two = states.withColumn("scenario", F.lit(1)).unionByName(
        states.withColumn("scenario", F.lit(2)).withColumn("s", F.col("s") * 3)
    )
    after = flows.flow_step(two, edges, 500, ["scenario"])
    assert after.count() == 12 and after.filter("t <> 1").isEmpty()
    assert quality.check_global_mass(two, after, ["scenario"]).isEmpty()


def test_flows_never_go_below_zero(table, states):
    net = table([("USA", -2_000_000, 5), ("Peru", 1, 1)], "entity STRING, net_s BIGINT, net_i BIGINT")
    after = {r["entity"]: r for r in flows.apply_flows(states, net, 0).collect()}
    assert after["USA"]["s"] == 0.0 and after["USA"]["i"] == 1005.0 and after["USA"]["t"] == 0
    assert after["Japan"]["s"] == 120000.0 and "Peru" not in after


def test_entity_without_edges_stays(table):
    states = table([("a", 10.0, 1.0, 0), ("b", 10.0, 1.0, 0)], "entity STRING, s DOUBLE, i DOUBLE, t INT")
    edges = table([("a", "b", 0.5, 1), ("a", "a", 9.0, 0)], "src STRING, dst STRING, w DOUBLE, idx INT")
    after = {r["entity"]: (r["s"], r["i"]) for r in flows.flow_step(states, edges, 9).collect()}
    assert after == {"a": (5.0, 1.0), "b": (15.0, 1.0)}


@pytest.mark.parametrize("hot_rows", [None, 0, 2])
@pytest.mark.parametrize("scale", [1e-20, 1.0, 1e21])
def test_shares_do_not_depend_on_scale_or_group_size(table, scale, hot_rows):
    weights = {1: [1, 2, 3, 4, 5, 6], 2: [1] * 7, None: [3, 3, 1], 3: [0, 0]}
    rows = [(g, n, 10, 10, w * scale) for g, ws in weights.items() for n, w in enumerate(ws)]
    got: dict = {}
    for r in apportion(table(rows, SCHEMA), ["g"], {"total": "share"}, hot_rows=hot_rows).orderBy("idx").collect():
        got.setdefault(r["g"], []).append(r["share"])
    assert got == {1: [1, 1, 1, 2, 2, 3], 2: [2, 2, 2, 1, 1, 1, 1], None: [4, 4, 2], 3: [0, 0]}


def test_edges_without_a_source_are_kept(table):
    edges = table([("a", "b", 2.0), (None, "b", 4.0), (None, "c", 4.0)], "src STRING, dst STRING, w DOUBLE")
    got = {(r["src"], r["dst"]): r["w"] for r in network.normalize_outbound(edges, 1.0).collect()}
    assert got == {("a", "b"): 1.0, (None, "b"): 0.5, (None, "c"): 0.5}
    assert {r["w"] for r in network.cap_rows(edges, 4.0).collect()} == {2.0}
