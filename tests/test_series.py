from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from regionflow.functions.scalar import clamp, clean_value
from regionflow.operators import series
from regionflow.operators.skew import first_per_key
from regionflow.sources import observations, tables

SERIES = "entity STRING, t INT, value DOUBLE"
DAYS = "entity STRING, day DATE, value DOUBLE"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_no_arrival_gives_length(table):
    df = table([("a", t, float(t + 1)) for t in range(5)], SERIES)
    assert rows(series.series_metrics(df), "entity", "arrival", "peak", "final") == [("a", 5, 5.0, 5.0)]


def test_arrival_is_first_hit_and_ignores_nan(table):
    df = table([("a", 0, float("nan")), ("a", 1, 3.0), ("a", 2, 12.0), ("a", 3, 11.0)], SERIES)
    got = series.series_metrics(df).select("arrival", "final").first()
    assert tuple(got) == (2, 11.0)


def test_metrics_of_no_rows(table):
    empty = table([], SERIES)
    v, t = F.col("value"), F.col("t")
    got = empty.agg(series.arrival_time(v, t), series.peak(v), series.final_value(v, t)).first()
    assert tuple(got) == (0, 0.0, 0.0)


def test_peak(table):
    df = table([("a", 0, 0.1), ("a", 1, 0.5), ("a", 2, 0.3)], SERIES)
    assert series.series_metrics(df).first()["peak"] == 0.5


def test_normalised_metrics(table):
    df = table([("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, 4.0), ("b", 0, 5.0)], SERIES)
    pop = table([("a", 10_000), ("b", 0)], "entity STRING, pop BIGINT")
    got = rows(series.normalised_metrics(df, pop), "entity", "arrival_n", "peak_n")
    assert got == [("a", 1, 4e-4), ("b", 0, 5.0)]


def test_clean_value(table):
    df = table([(-1.0,), (None,), (float("nan"),), (2.5,)], "v DOUBLE")
    assert [r[0] for r in df.select(clean_value(F.col("v"))).collect()] == [0.0, 0.0, 0.0, 2.5]


def test_clamp_keeps_null(table):
    df = table([(None,), (-9.0,), (9.0,), (0.5,)], "v DOUBLE")
    assert [r[0] for r in df.select(clamp(F.col("v"), -1, 1)).collect()] == [None, -1.0, 1.0, 0.5]


def test_first_n_padded(table):
    data = [("a", day(n), float(n)) for n in (3, 1, 2, 0)] + [("b", day(9), 7.0)]
    df = table(data, DAYS)
    ids = table([("a",), ("b",), ("c",)], "entity STRING")
    got = rows(series.first_n_padded(df, 3, ids), "entity", "t", "value")
    assert got == [
        ("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, 2.0),
        ("b", 0, 7.0), ("b", 1, 0.0), ("b", 2, 0.0),
        ("c", 0, 0.0), ("c", 1, 0.0), ("c", 2, 0.0),
    ]


@pytest.mark.parametrize("parts", [1, 7])
def test_first_per_key_with_a_hot_key(spark, parts):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50).alias("k"), "id"
    ).repartition(parts)
    got = first_per_key(df, ["k"], [F.desc("id")], 5)
    expected = {}
    for n in range(2999, -1, -1):
        key = 0 if n % 3 < 2 else n % 50
        expected.setdefault(key, [])
        if len(expected[key]) < 5:
            expected[key].append(n)
    found = {}
    for r in sorted(got.collect(), key=lambda r: r["rn"]):
        found.setdefault(r["k"], []).append(r["id"])
    assert found == expected


def test_observations_by_header_name(spark, tmp_path):
    path = tmp_path / "obs.csv"
    path.write_text(
        "iso,new_cases,date,location\nX,5,2020-01-02,China\nX,-3,2020-01-01,China\n"
        "X,,2020-01-03,China\nX,bad,2020-01-04,China\nX,12.5,2020-01-05,United States\nX,9,2020-01-05,Peru\n"
    )
    obs = observations.read_observations(spark, str(path))
    got = observations.observed_series(obs, tables.name_aliases(spark), 6)
    found = {}
    for r in got.orderBy("entity", "t").collect():
        found.setdefault(r["entity"], []).append(r["value"])
    assert found["China"] == [0.0, 5.0, 0.0, 0.0, 0.0, 0.0]
    assert found["USA"] == [12.5, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert found["Japan"] == [0.0] * 6 and set(found) == {"China", "Japan", "India", "Germany", "Italy", "USA"}
    targets = {r["entity"]: (r["t_arrive"], r["peak"]) for r in observations.observed_targets(got).collect()}
    assert targets["USA"] == (0.0, 12.5) and targets["China"] == (6.0, 5.0) and targets["Japan"] == (6.0, 0.0)


def test_targets_fall_back_only_as_a_whole(spark, tmp_path):
    defaults = tables.default_targets(spark)
    missing = observations.targets_or_default(
        lambda: observations.read_observations(spark, str(tmp_path / "none.csv")), defaults
    )
    assert missing is defaults
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    wrong = observations.targets_or_default(
        lambda: observations.read_observations(spark, str(tmp_path / "other.csv")), defaults
    )
    assert wrong is defaults
