"""Streams of many batches, restarts, and what their files and state hold together."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from regionflow.operators import sampling, summary
from regionflow.streaming import snapshots, stateful, versions

ROWS = "country string, ts timestamp, t int, step long, i double"


@pytest.fixture(scope="module")
def events():
    """(country, ts, t, step, value) over 20 days; some without a value, a country or a time."""
    draw = random.Random(2)
    rows = []
    for step in range(600):
        day, second = step // 30, step % 30
        country = draw.choice(["a", "b", "b", "c", None])
        ts = None if step % 97 == 5 else f"2024-01-{day + 1:02d} 10:00:{second:02d}"
        rows.append((country, ts, day, step, None if step % 53 == 7 else round(draw.uniform(-50, 400), 2)))
    return rows


@pytest.fixture(scope="module")
def files(spark, events, tmp_path_factory):
    """The events in 20 files, each holding a day's first half and the next day's second half, oldest first."""
    folder = str(tmp_path_factory.mktemp("files"))
    whole = spark.createDataFrame(events, "country string, ts string, t int, step long, i double").withColumn("ts", F.col("ts").cast("timestamp"))
    place = F.when(F.col("step") % 30 < 15, F.col("t")).otherwise(F.col("t") - 1)
    for k in range(-1, 20):
        whole.filter(place == k).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.startswith("part-") and not os.path.exists(f"{folder}/_{name}"):
                os.utime(f"{folder}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))
                open(f"{folder}/_{name}", "w").close()  # marks the files whose age is set
    return folder, whole


def in_two_runs(spark, folder, start):
    """Runs a stream over the folder file by file, stopped after some batches and started again."""
    stream = lambda: snapshots.read_snapshot_stream(spark, folder, ROWS, max_files=1)
    first = start(stream(), False)
    while len(first.recentProgress) < 6 and first.isActive:
        first.awaitTermination(0.1)
    first.stop()
    second = start(stream(), True)
    second.awaitTermination()
    assert second.exception() is None


def test_windows_over_many_batches(spark, files, tmp_path):
    folder, whole = files
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    kinds = []

    def start(stream, available_now):
        days = snapshots.series_partials(stream, "2 days", thresh=200.0)
        kinds.append(days.schema)
        return snapshots.sink_files(days, out, checkpoint, available_now=available_now)

    in_two_runs(spark, folder, start)
    closed, held = spark.read.schema(kinds[0]).parquet(out), snapshots.open_partials(spark, checkpoint)
    assert closed.filter("start IS NOT NULL").count() > 20 and held.count() > 0
    every = closed.unionByName(held)
    assert every.agg(F.sum("n")).first()[0] == 600
    got = {(r["country"], r["start"]): r for r in snapshots.rolling_from_days(every, 7).collect()}
    seven = whole.select("country", "i", F.to_date("ts").alias("day"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    want = seven.groupBy("country", F.date_sub("day", F.col("k")).alias("start")).agg(
        F.count("*").alias("n"), F.avg("i").alias("mean"), F.max("i").alias("peak"), F.sum("i").alias("total")
    ).collect()
    assert len(want) == len(got)
    for r in want:
        g = got[r["country"], r["start"]]
        assert (g["n"], g["peak"]) == (r["n"], r["peak"])
        assert g["total"] == pytest.approx(r["total"]) and g["mean_value"] == pytest.approx(r["mean"])
    merged = {tuple(r) for r in snapshots.merge_partials(every).collect()}
    assert merged == {tuple(r) for r in snapshots.stream_series_metrics(whole, thresh=200.0).collect()}


@pytest.mark.parametrize("seed_first", [False, True])
def test_ema_over_many_batches(spark, files, tmp_path, seed_first):
    folder, whole = files
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    kinds = []

    def start(stream, available_now):
        rows = stateful.stream_ema(stream, "2 days", key="country", value="i", seed_first=seed_first)
        kinds.append(rows.schema)
        return snapshots.sink_files(rows, out, checkpoint, available_now=available_now)

    in_two_runs(spark, folder, start)
    sent = spark.read.schema(kinds[0]).parquet(out)
    waiting = stateful.waiting_ema(spark, checkpoint, kinds[0], seed_first=seed_first)
    assert sent.count() > 300 and waiting.count() > 0
    got = {r["step"]: r["ema"] for r in sent.unionByName(waiting).collect()}
    # by time: steps grow with it
    rows = whole.filter("ts IS NOT NULL").fillna(0.0, ["i"])
    want = {r["step"]: r["ema"] for r in summary.ema(rows, key="country", value="i", seed_first=seed_first).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


@pytest.mark.parametrize("seed_first,chunk_s", [(False, 7200), (True, 7200), (True, 40 * 86400), (False, 1)])
def test_ema_in_chunks_over_many_batches(spark, files, tmp_path, seed_first, chunk_s):
    """No state row holds a whole key, and the averages are those of whole keys."""
    folder, whole = files
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    kinds = []
    late = F.when(F.col("ts") > "2024-01-02 06:00:00", F.col("i")).otherwise(F.col("i") * 0)  # a start of zeros

    def start(stream, available_now):
        rows = stateful.stream_ema(stream.withColumn("i", late), "2 days", key="country", value="i", seed_first=seed_first, chunk_s=chunk_s)
        kinds.append(rows.schema)
        return snapshots.sink_files(rows, out, checkpoint, available_now=available_now)

    in_two_runs(spark, folder, start)
    sent = spark.read.schema(kinds[0]).parquet(out)
    waiting = stateful.waiting_ema(spark, checkpoint, kinds[0], seed_first=seed_first)
    most = stateful.open_state(spark, checkpoint).agg(F.max(F.length("value.groupState.xs"))).first()[0]
    assert waiting.count() > 0
    if chunk_s <= 7200:
        assert sent.count() > 300 and most <= 8 * 20
    got = {r["step"]: r["ema"] for r in stateful.carried_ema(sent.unionByName(waiting), seed_first=seed_first).collect()}
    rows = whole.filter("ts IS NOT NULL").withColumn("i", late).fillna(0.0, ["i"])
    want = {r["step"]: r["ema"] for r in summary.ema(rows, key="country", value="i", seed_first=seed_first).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


@pytest.mark.parametrize("keys,salts", [(["country"], 1), (["country"], 3), ([], 2)])
def test_newest_rows_after_every_batch(spark, files, tmp_path, keys, salts):
    folder, whole = files
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    stream = snapshots.read_snapshot_stream(spark, folder, ROWS, max_files=1)
    snapshots.sink_files(stateful.stream_last_n(stream, 4, "step", keys, salts), out, checkpoint).awaitTermination()
    names = sorted((f for f in os.listdir(folder) if f.startswith("part-")), key=lambda f: os.path.getmtime(f"{folder}/{f}"))
    shape = whole.schema
    for batch in (0, 1, 7, len(names) - 1):
        so_far = spark.read.schema(ROWS).parquet(*[f"{folder}/{f}" for f in names[: batch + 1]])
        want = sampling.keep_last_n(so_far, 4, "step", keys, chunk=50)
        got = stateful.last_n(spark, checkpoint, shape, 4, "step", keys, batch=batch)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        sizes = stateful.open_state(spark, checkpoint, batch).select(F.size("value.groupState.rows").alias("n"))
        assert sizes.agg(F.max("n")).first()[0] <= 4
    gone = stateful.from_rows(spark.read.schema("row string").parquet(out), shape)
    held = stateful.from_rows(stateful.open_state(spark, checkpoint).select(F.explode("value.groupState.rows").alias("row")), shape)
    assert sorted(map(tuple, gone.unionByName(held).collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_versions_replay_and_compaction(spark, table, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    batches = [[("a", 1, 5.0), ("b", 1, 1.0)], [("a", 2, 50.0), ("a", 3, 60.0)], [("b", 4, 70.0), (None, 5, 2.0)]]
    rows = "country string, t int, i double"
    kinds = []

    def run():
        stream = stateful.stream_series_versions(snapshots.read_snapshot_stream(spark, path, rows, max_files=1), thresh=10.0)
        kinds.append(stream.schema)
        snapshots.sink_files(stream, out, checkpoint).awaitTermination()

    def result():
        newest = versions.newest(spark, out, kinds[0], ["country", "part"])
        return sorted(map(tuple, snapshots.merge_partials(stateful.series_partials_of(newest)).collect()), key=repr)

    table(batches[0], rows).coalesce(1).write.mode("append").parquet(path)
    run()
    assert result() == [("a", 1, 5.0), ("b", 1, 1.0)]
    assert versions.compact(spark, out, kinds[0], ["country", "part"]) > 0
    assert versions.compact(spark, out, kinds[0], ["country", "part"]) == 0
    for batch in batches[1:]:
        table(batch, rows).coalesce(1).write.mode("append").parquet(path)
        run()
    want = sorted([("a", 2, 60.0), ("b", 4, 70.0), (None, 1, 2.0)], key=repr)
    assert result() == want
    committed = spark.read.schema(kinds[0]).parquet(out)
    assert committed.count() == 5  # versions: a, b; a; b, null

    last = max(int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")  # as if the program had died before it could note the batch as done
    n_files = len(committed.inputFiles())
    run()
    again = spark.read.schema(kinds[0]).parquet(out)
    assert len(again.inputFiles()) == n_files and again.count() == 5 and result() == want
    fresh = versions.compact(spark, out, kinds[0], ["country", "part"])
    assert 0 < fresh < n_files and result() == want
    folder = f"{out}-generations/1"
    assert spark.read.parquet(f"{folder}/rows").count() == 3
    os.remove(f"{folder}/files/_SUCCESS")  # a compaction that broke off is done again
    assert result() == want and versions.compact(spark, out, kinds[0], ["country", "part"]) == fresh and result() == want
