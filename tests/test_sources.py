from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from regionflow.session import fresh_path, shared_dir
from regionflow.sources import metric_log, tables

LOG = """\
1.76E12,0.9,0.0,0.0
1.761E12,0.8,0.1,100.0
1.762E12,2.18,1.0,0.99,-1027.5
1.763E12,0.7,0.2,200.0
1.764E12,3.0,-0.47
1.765E12,1.0,-1.52
1.766E12,0.9,0.0,0.0
1.767E12,0.8,0.3,100.0
"""


def test_shared_dir_is_read_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x").startswith(shared_dir(spark)) and fresh_path(spark, "x") != fresh_path(spark, "x")


def test_ragged_log(spark, tmp_path):
    (tmp_path / "metrics.csv").write_text(LOG)
    got = metric_log.read_ragged_metrics(spark, str(tmp_path))
    assert got["steps"].count() == 5
    assert tuple(got["epochs"].drop("file", "block", "line").first()) == (1762000000000, 2.18, 1.0, 0.99, -1027.5)
    assert [tuple(r) for r in got["evals"].select("action", "qmax").collect()] == [(3.0, -0.47), (1.0, -1.52)]


@pytest.mark.parametrize("block", ["64", "134217728"])
def test_run_ids_across_blocks(spark, tmp_path, block):
    """A file cut into many blocks numbers its runs as a whole one does."""
    lines = LOG.splitlines() * 40
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(lines[1:9]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        read = metric_log.read_ragged_lines(spark, str(tmp_path))
        rows = metric_log.run_ids(read).orderBy("file", "block", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    runs, expected = 0, []
    for line in lines:
        f = line.split(",")
        runs += len(f) == 4 and float(f[3]) == 0
        expected.append((line, runs))
    got = [(",".join(r["fields"]), r["run"]) for r in rows if r["file"].endswith("a.csv")]
    assert got == expected
    assert [r["run"] for r in rows if r["file"].endswith("b.csv")] == [0, 0, 0, 0, 0, 1, 1, 2]


def test_metric_log_appends(spark, table, tmp_path):
    schema = "run STRING, step BIGINT, key STRING, value DOUBLE, seq BIGINT"
    path = str(tmp_path / "log")
    metric_log.append_metric_log(table([("r1", 0, "loss", 1.0, 0)], schema), path)
    metric_log.append_metric_log(table([("r1", 50, "loss", 0.5, 1), ("r2", 0, "eps", 1.0, 0)], schema), path)
    assert metric_log.read_metric_log(spark, path).count() == 3
    assert sorted(d for d in os.listdir(path) if d.startswith("run=")) == ["run=r1", "run=r2"]


def test_sinks(spark, table, tmp_path):
    df = table([(1, "a", 0.5), (2, "b", 1.5)], "epoch INT, entity STRING, x DOUBLE").repartition(2)
    pq, csv = str(tmp_path / "p"), str(tmp_path / "c")
    for _ in range(2):
        tables.write_both(df, pq, csv)
    assert sorted(map(tuple, spark.read.parquet(pq).collect())) == [(1, "a", 0.5), (2, "b", 1.5)]
    files = [f for f in os.listdir(csv) if f.endswith(".csv")]
    assert len(files) == 1 and (tmp_path / "c" / files[0]).read_text().splitlines()[0] == "epoch,entity,x"


def test_a_failing_write_raises(spark, table, tmp_path):
    bad = table([(1,)], "x INT").withColumn("y", F.raise_error(F.lit("broken row")).cast("int"))
    with pytest.raises(Exception, match="broken row"):
        tables.write_both(bad, str(tmp_path / "p"), str(tmp_path / "c"))


def test_surface_file(spark, table, tmp_path):
    path = str(tmp_path / "surface")
    tables.write_surface(table([(0.24, 0.5, 12.25)], "beta DOUBLE, travel DOUBLE, loss DOUBLE"), path)
    assert tuple(tables.read_surface(spark, path).first()) == (0.24, 0.5, 12.25)
