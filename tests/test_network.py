from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from regionflow.functions.geo import haversine_km
from regionflow.operators import network, quality
from regionflow.sources import tables

EDGES = "src STRING, dst STRING, w DOUBLE"


@pytest.fixture(scope="module")
def fixed(spark):
    return tables.world(spark), tables.world_links(spark), tables.pair_multipliers(spark)


def weights(df):
    return {(r["src"], r["dst"]): r["w"] for r in df.collect()}


def test_haversine(fixed):
    pairs = network.attach_ends(fixed[1], fixed[0], ["lat", "lon"])
    km = haversine_km(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))
    got = {(r["src"], r["dst"]): r["km"] for r in pairs.select("src", "dst", km.alias("km")).collect()}
    assert got["USA", "Japan"] == pytest.approx(10031.666, abs=1e-3)
    assert got["Germany", "Italy"] == pytest.approx(964.005, abs=1e-3)
    assert got["China", "India"] == pytest.approx(2743.475, abs=1e-3)


def test_gravity_before_the_cap(fixed):
    got = network.outbound_sums(network.gravity_edges(*fixed, cap=None))
    sums = {r["src"]: r["out_w"] for r in got.collect()}
    expected = {
        "USA": 2.053520, "Japan": 5.946337, "Italy": 3.733656,
        "India": 9.326928, "Germany": 3.802099, "China": 13.976146,
    }
    assert sums == pytest.approx(expected, abs=1e-6)


def test_gravity_rows_obey_the_cap(fixed):
    edges = network.gravity_edges(*fixed)
    w = weights(edges)
    assert len(w) == 30
    assert w["China", "India"] == pytest.approx(0.110978104, abs=1e-9)
    assert w["USA", "Japan"] == pytest.approx(0.009327546, abs=1e-9)
    assert w["Germany", "Italy"] == pytest.approx(0.024784085, abs=1e-9)
    assert quality.check_edges(edges).isEmpty()
    assert not quality.check_edges(edges, cap=0.1).isEmpty()


def test_fixed_tables_are_broadcast(fixed):
    plan = network.with_distance(network.attach_ends(fixed[1], fixed[0], ["lat", "lon"]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_normalize_outbound(table):
    row = [0.0, 0.003, 0.004, 0.001, 0.001, 0.002]
    df = table([("a", str(n), w) for n, w in enumerate(row)] + [("z", "a", 0.0)], EDGES)
    w = weights(network.normalize_outbound(df, 0.01))
    assert w["a", "0"] == 0.0 and w["z", "a"] == 0.0
    assert sum(v for (s, _), v in w.items() if s == "a") == pytest.approx(0.01, abs=1e-12)
    assert w["a", "2"] == pytest.approx(0.004 / 0.011 * 0.01)


def test_cap_only_shrinks(table):
    df = table([("a", "b", 0.01), ("b", "a", 0.3), ("b", "c", 0.1)], EDGES)
    w = weights(network.cap_rows(df, 0.12))
    assert w["a", "b"] == 0.01
    assert w["b", "a"] == pytest.approx(0.09) and w["b", "c"] == pytest.approx(0.03)


def test_scale_edge_and_row(table):
    df = table([("a", "b", 0.05), ("a", "c", 0.15), ("b", "a", 0.1)], EDGES)
    assert weights(network.scale_edge(df, "a", "b", 3.0))["a", "b"] == pytest.approx(0.15)
    w = weights(network.scale_row(df, "a", 2.0))
    assert w["a", "b"] == pytest.approx(0.05) and w["a", "c"] == pytest.approx(0.15) and w["b", "a"] == 0.1
    w = weights(network.scale_row(df, "a", 0.5))
    assert w["a", "b"] == pytest.approx(0.025) and w["a", "c"] == pytest.approx(0.075)
    w = weights(network.scale_row(df, "a", 2.0, cap=None))
    assert w["a", "b"] == pytest.approx(0.1) and w["a", "c"] == pytest.approx(0.3)


def test_one_hop(table):
    df = table([("a", "b", 0.05), ("b", "a", 0.1)], EDGES)
    assert weights(network.one_hop(df, "a", "b")) == {("a", "b"): 0.004, ("b", "a"): 0.0}
    assert weights(network.one_hop(df, "a", "c"))["a", "c"] == 0.004
    assert set(weights(network.one_hop(df, "a", "a")).values()) == {0.0}


def test_pairs_ne_and_attribute(table):
    links = table([("a", "b"), ("a", "b"), ("b", "b"), ("b", "a")], "src STRING, dst STRING")
    pairs = network.pairs_ne(links)
    mul = table([("a", "b", 1.8)], "src STRING, dst STRING, mul DOUBLE")
    got = {(r["src"], r["dst"]): r["mul"] for r in network.pair_attribute(pairs, mul).collect()}
    assert got == {("a", "b"): 1.8, ("b", "a"): 1.0}
