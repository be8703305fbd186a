"""Stored layouts, logs that grow, checked sources, digests, and pairs within a distance."""

from __future__ import annotations

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from regionflow.operators import digest, network, quality, series, summary
from regionflow.plans.catalog import catalog
from regionflow.plans.registry import rounded, rounded_small
from regionflow.sources import layout, metric_store, observations

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- layout ---


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")
def test_a_report_over_a_layout_has_no_exchange_by_entity(spark):
    on_layout = catalog()["report_on_layout"].run(spark, SF_DIR)
    assert "hashpartitioning(entity" not in plan(on_layout)
    plain = catalog()["region_report"].run(spark, SF_DIR)
    assert "hashpartitioning(entity" in plan(plain)
    assert sorted(map(tuple, on_layout.collect())) == sorted(map(tuple, plain.collect()))


def test_first_days_over_a_layout(spark, table):
    rows = [(e, d, float(d)) for e in ("a", "b", None) for d in range(5)]
    name = layout.write_layout(table(rows, "entity string, day int, value double"), 4)
    first = series.first_n_padded(layout.read_layout(spark, name), 3)
    assert "hashpartitioning(entity" not in plan(first) and first.count() == 9
    layout.drop_layout(spark, name)
    assert not spark.catalog.tableExists(name)


# --- metric store ---

LOG = "run string, step bigint, key string, value double, seq bigint"


def test_latest_values_over_appends(spark, table, tmp_path):
    path, draw, last = str(tmp_path / "log"), random.Random(1), {}
    for n in range(5):
        rows = [("r1", 7, "loss", float(n), 3), ("r1", 7, "loss", -1.0, 2)]
        rows += [(f"r{draw.randrange(3)}", n * 100 + draw.randrange(100), draw.choice("ab"), draw.random(), k + 10) for k in range(80)]
        assert metric_store.append(table(rows, LOG), path) == n
        for run, step, key, value, seq in sorted(rows, key=lambda r: r[4]):
            last[run, step, key] = value
        if n == 2:
            assert metric_store.compact(spark, path) == 3 and metric_store.compact(spark, path) == 0
    read = lambda *a: {(r.run, r.step, r.key): r.value for r in metric_store.read_latest(spark, path, *a).collect()}
    assert read() == last and last["r1", 7, "loss"] == 4.0
    assert read("r1", 310, 330) == {k: v for k, v in last.items() if k[0] == "r1" and 310 <= k[1] <= 330}
    assert read(None, 420, None) == {k: v for k, v in last.items() if k[1] >= 420}
    every, some = metric_store.files_for(spark, path), metric_store.files_for(spark, path, "r1", 310, 330)
    assert some and set(some) < set(every) and len(some) <= len(every) / 2
    opened = metric_store.read_latest(spark, path, "r1", 310, 330).inputFiles()
    assert {f.split("/")[-1] for f in opened} == {f.split("/")[-1] for f in some}
    # an append that broke off does not count and is written again
    broken = f"{path}/appends/5"
    table([("x", 1, "a", 1.0, 1)], LOG).withColumn("append", F.lit(5).cast("bigint")).write.parquet(f"{broken}/rows")
    assert read() == last
    assert metric_store.append(table([("y", 1, "a", 2.0, 1)], LOG), path) == 5
    assert read() == last | {("y", 1, "a"): 2.0}
    assert metric_store.compact(spark, path) == 4 and read() == last | {("y", 1, "a"): 2.0}


def test_an_empty_store(spark, table, tmp_path):
    path = str(tmp_path / "none")
    assert metric_store.read_latest(spark, path).collect() == [] and metric_store.compact(spark, path) == 0
    metric_store.append(table([], LOG), path)
    assert metric_store.read_latest(spark, path).collect() == []


# --- checked sources ---


def test_rejects_and_counts_in_one_pass(spark, tmp_path):
    lines = ["continent,new_cases,location,date", "x,1.5,a,2024-01-01", "x,,a,2024-01-02", "x,-4,b,2024-01-02", "x,n/a,a,2024-01-03", "x,2,,2024-01-04", "x,oops,  ,never", "x,3,a", "x,3,a,2024-01-05,more"]
    file = tmp_path / "in.csv"
    file.write_text("\n".join(lines) + "\n")
    found = observations.read_checked(spark, str(file))
    assert found.counts == {"rows": 8, "rejected": 5, "line of another length": 2, "no location": 2, "no date": 2, "no number": 2}
    assert [(r.location, str(r.date), r.new_cases) for r in found.rows.orderBy("date", "location").collect()] == [("a", "2024-01-01", 1.5), ("a", "2024-01-02", None), ("b", "2024-01-02", -4.0)]
    why = sorted((r.new_cases, r.date, r.reasons) for r in found.rejects.fillna("-").collect())
    assert why == [
        ("2", "2024-01-04", ["no location"]), ("3", "-", ["line of another length", "no date"]),
        ("3", "2024-01-05", ["line of another length"]), ("n/a", "2024-01-03", ["no number"]),
        ("oops", "never", ["no location", "no date", "no number"]),
    ]
    with pytest.raises(observations.MissingColumn):
        (tmp_path / "other.csv").write_text("a,b\n1,2\n")
        observations.read_checked(spark, str(tmp_path / "other.csv"))


def test_states_split_by_checks(spark, table):
    states = table([(1.0, 2.0, 3), (-1.0, 5.0, 4), (-2.0, float("nan"), 5)], "s double, i double, t int")
    found = quality.split_rows(states, {"negative": F.col("s") < 0, "not finite": F.isnan("i")}, {"s": F.col("s") * 10})
    assert found.counts == {"rows": 3, "rejected": 2, "negative": 2, "not finite": 1}
    assert [tuple(r) for r in found.rows.collect()] == [(10.0, 2.0, 3)]
    assert sorted((r.t, r.reasons) for r in found.rejects.collect()) == [(4, ["negative"]), (5, ["negative", "not finite"])]
    nothing = quality.split_rows(states.limit(0), {"negative": F.col("s") < 0})
    assert nothing.counts["rows"] == 0 and nothing.rows.count() == 0 == nothing.rejects.count()


# --- digests ---


def test_one_changed_row_among_a_million(spark):
    a = spark.range(1_000_000).select("id", (F.col("id") % 1000 / 7).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    b = a.withColumn("x", F.when(F.col("id") == 4711, -1.0).otherwise(F.col("x"))).orderBy(F.desc("id"))
    assert digest.differences(a, a.repartition(5)).collect() == []
    found = sorted((r.id, r.x, r.surplus) for r in digest.differences(a, b).collect())
    assert found == [(4711, -1.0, -1), (4711, 711 / 7, 1)]
    trees = digest.digest_tree(a), digest.digest_tree(b)
    assert digest.differing_leaves(trees[0], trees[0]).count() == 0
    assert 1 <= digest.differing_leaves(*trees).count() <= 2
    root = trees[0].filter("level = 0").collect()
    assert [(r.node, r.n) for r in root] == [(0, 1_000_000)]


def test_bags_nulls_and_nested_columns(spark):
    schema = "k int, `a.b` string, xs array<int>, m map<string,int>, s struct<u:int,v:int>"
    rows = [(1, None, [1, None], {"a": 1, "b": 2}, (1, None)), (None, "1", [None, 1], {"b": 2}, (None, 1)), (2, "x", None, None, None)]
    a = spark.createDataFrame(rows + rows[:1], schema).drop("m")
    b = spark.createDataFrame(rows, schema).drop("m")
    assert [(r.k, r.surplus) for r in digest.differences(a, b).collect()] == [(1, 1)]
    swapped = spark.createDataFrame([(1, None, [None, 1], None, (1, None)), *[(*r[:3], None, r[4]) for r in rows[1:]]], schema).drop("m")
    assert sorted(r.surplus for r in digest.differences(b, swapped).collect()) == [-1, 1]
    with_map = spark.createDataFrame(rows, schema)
    turned = spark.createDataFrame([(*r[:3], r[3] and dict(reversed(r[3].items())), r[4]) for r in rows], schema)
    assert digest.differing_leaves(digest.digest_tree(with_map), digest.digest_tree(turned)).count() == 0
    assert digest.differences(a.limit(0), b.limit(0)).count() == 0
    assert digest.differences(a.limit(0), b).count() == 3


# --- pairs within a distance ---


def km(a, b):
    (p, x), (q, y) = ([math.radians(v) for v in c] for c in (a, b))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("near", [1.0, 150.0, 2500.0, 9000.0])
def test_pairs_within_a_distance(spark, near):
    draw = random.Random(int(near))
    n = 5000 if near == 150.0 else 600
    places = [(k, math.degrees(math.asin(draw.uniform(-1, 1))), draw.uniform(-180, 180)) for k in range(n)]
    places += [(n, 90.0, 10.0), (n + 1, 90.0, -170.0), (n + 2, -90.0, 0.0), (n + 3, 10.0, 180.0), (n + 4, 10.0, -180.0), (n + 5, 10.0, 179.9995), (n + 6, 10.0, -179.9995)]
    places += [(n + 7, 89.9999, 0.0), (n + 8, 89.9999, 180.0), (n + 9, 0.0, 0.0), (n + 10, 0.0, 0.0), (n + 11, 45.0, 360.0), (n + 12, 45.0, 0.0)]
    places += [(None, 0.0, 0.0), (n + 13, None, 0.0), (n + 14, 0.0, float("nan"))]
    table = spark.createDataFrame(places, "id int, lat double, lon double")
    found = network.pairs_within(table, near)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    got = {(r.src, r.dst): r.km for r in found.collect()}
    real = [p for p in places if None not in p and not math.isnan(p[2])]
    close = lambda p, q: abs(p[1] - q[1]) * 111.1 <= near + 1
    want = {(p[0], q[0]): d for i, p in enumerate(real) for q in real[i + 1 :] if close(p, q) and (d := km(p[1:], q[1:])) <= near}
    assert got.keys() == want.keys() and len(got) == found.count()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_pairs_of_a_dense_cell_are_spread(spark, monkeypatch):
    """No task has most of the pairs, where a file is small and its places lie close; equal ids and equal places too."""
    monkeypatch.setattr(network, "CELL_ROWS", 40, raising=False)
    monkeypatch.setattr(network, "TASK_PAIRS", 20_000, raising=False)
    draw = random.Random(3)
    places = [(k, draw.uniform(87.5, 90), draw.uniform(-180, 180)) for k in range(300)]
    places += [(k, 12.0, 179.99) for k in range(300, 360)] + [(k, 12.0, -179.99) for k in range(360, 400)] + [(399, 12.0, -179.99), (5, 12.5, 179.0)]
    found = network.pairs_within(spark.createDataFrame(places, "id int, lat double, lon double").coalesce(1), 150.0)
    want = [(min(p[0], q[0]), max(p[0], q[0]), km(p[1:], q[1:])) for i, p in enumerate(places) for q in places[i + 1 :] if p[0] != q[0]]
    want = sorted(w for w in want if w[2] <= 150.0)
    got = sorted(tuple(r) for r in found.collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) > 10_000
    assert all(g[2] == pytest.approx(w[2], abs=1e-6) for g, w in zip(got, want, strict=True))
    shares = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(shares) < len(got) / 3


def test_small_numbers_are_rounded_to_the_same(spark):
    draw = random.Random(5)
    numbers = [draw.uniform(-200, 200) for _ in range(2000)] + [k / 2e6 for k in range(-999, 999)] + [draw.uniform(-2e4, 2e4) for _ in range(500)]
    numbers += [0.0, -0.0, 1e-9, -1e-9, 1e300, 999.9999995, float("inf"), float("nan"), None]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double")
    plain, quick = (f(rows, 6, "x").collect() for f in (rounded, rounded_small))
    assert [str(r.x) for r in plain] == [str(r.x) for r in quick]


def test_distances_that_are_refused(spark):
    for bad in (0.0, -1.0, 10_100.0):
        with pytest.raises(ValueError):
            network.pairs_within(spark.range(1).selectExpr("id", "0d lat", "0d lon"), bad)


def test_averages_need_no_exchange_beyond_the_scan(spark, table):
    """Series on a layout are averaged where they lie; only chunk ends travel."""
    rows = [("a", k, float(k)) for k in range(50)]
    name = layout.write_layout(table(rows, "entity string, step int, reward double"), 2, order=["step"])
    got = {r["step"]: r["ema"] for r in summary.ema(layout.read_layout(spark, name)).collect()}
    e = 0.0
    for k in range(50):
        e = 0.2 * k + 0.8 * e
        assert got[k] == pytest.approx(e)
