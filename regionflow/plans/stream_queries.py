"""Streams over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.plans import views as V
from regionflow.plans.registry import query, rounded, table
from regionflow.session import fresh_path
from regionflow.streaming import snapshots, stateful, versions


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshot rows (country, ts, t, i)."""
    events = table(spark, sf_dir, "events")
    # a pattern of just this name: one file or a folder of parts
    source = snapshots.read_snapshot_stream(spark, f"{sf_dir}/events.parque[t]", events.schema)
    return source.select(
        F.col("event_type").alias("country"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("t"),
        F.col("value").alias("i"),
    )


def _finish(streaming_query) -> None:
    streaming_query.awaitTermination()
    if streaming_query.exception() is not None:
        raise streaming_query.exception()


def _partials(spark: SparkSession, stream: DataFrame, thresh: float = 10.0) -> DataFrame:
    """The partials per country and day of all that a stream reads: closed days from its files, open ones from its state."""
    path, checkpoint = fresh_path(spark, "days"), fresh_path(spark, "checkpoint")
    days = snapshots.series_partials(stream, "1 day", thresh=thresh)
    _finish(snapshots.sink_files(days, path, checkpoint))
    return spark.read.schema(days.schema).parquet(path).unionByName(snapshots.open_partials(spark, checkpoint))


#: Rounds that a stream is run in, and files of each; a batch takes one file.
ROUNDS, FILES = 3, 3


def _rounds(spark: SparkSession, sf_dir: str, start) -> None:
    """Events by time in some rounds: a round's files are added, then `start(stream, watermark)` runs until all are read.

    Each run goes on from the checkpoint of the one before, a file a batch. Files of
    a round may be read in any order, so the watermark waits as long as a round
    lasts. Events without a time come first.
    """
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("country"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("i")
    )
    path = fresh_path(spark, "rounds")
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    first, last = events.agg(F.min(day), F.max(day)).first()
    days = 1 if first is None else (last - first) // ROUNDS + 1
    dated = events.withColumn("t", day)
    for k in range(ROUNDS):
        part = F.coalesce(F.floor((F.col("t") - F.lit(first or 0)) / F.lit(days)), F.lit(0)) == k
        dated.filter(part).repartitionByRange(FILES, "ts").write.mode("append").parquet(path)
        stream = snapshots.read_snapshot_stream(spark, path, dated.schema, max_files=1)
        _finish(start(stream, f"{days} days"))


_T = "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))"


@query(
    "write_snapshot",
    f"SELECT epoch, entity, step, i FROM ({V.STEP_SQL}) WHERE step % 50 = 0 UNION ALL "
    f"SELECT epoch, entity, step, i FROM ({V.STEP_SQL}) WHERE step % 50 <> 0 AND step % 499 = 0",
)
def write_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots every 50 steps and at given last steps, read back as a stream's files."""
    path = fresh_path(spark, "snapshots")
    rows = V.steps(spark, sf_dir).withColumn("last", F.col("step") % 499 == 0)
    due = snapshots.snapshot_rows(rows, 50, "last").select("epoch", "entity", "step", "i")
    snapshots.write_snapshot(due, path)
    stream = snapshots.read_snapshot_stream(spark, path, due.schema)
    out = fresh_path(spark, "archive")
    _finish(snapshots.sink_files(stream, out, fresh_path(spark, "checkpoint")))
    return spark.read.schema(due.schema).parquet(out)


@query(
    "stream_archive",
    f"SELECT event_type AS country, CAST({_T} AS INTEGER) AS t, count(*) AS n, round(sum(value), 4) AS total "
    "FROM events GROUP BY 1, 2",
)
def stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream archived as Parquet files, then summarised."""
    path = fresh_path(spark, "archive")
    stream = _stream(spark, sf_dir)
    _finish(snapshots.sink_files(stream, path, fresh_path(spark, "checkpoint")))
    kept = spark.read.schema(stream.schema).parquet(path)
    out = kept.groupBy("country", "t").agg(F.count("*").alias("n"), F.sum("i").alias("total"))
    return rounded(out, 4, "total")


@query(
    "stream_archive_csv",
    "SELECT event_type AS country, count(*) AS n, round(max(value), 4) AS peak FROM events GROUP BY 1",
)
def stream_archive_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archive")
    stream = _stream(spark, sf_dir)
    _finish(snapshots.sink_files(stream, path, fresh_path(spark, "checkpoint"), fmt="csv"))
    kept = spark.read.schema(stream.schema).option("header", True).csv(path)
    return rounded(kept.groupBy("country").agg(F.count("*").alias("n"), F.max("i").alias("peak")), 4, "peak")


@query(
    "rolling_snapshot_agg",
    """
    WITH w AS (SELECT event_type AS country, value, unnest(range(7)) AS back, CAST(ts AS DATE) AS day FROM events)
    SELECT country, CAST(day - CAST(back AS INTEGER) AS VARCHAR) AS start, count(*) AS n, round(avg(value), 9) AS mean_value,
    round(max(value), 4) AS peak, round(sum(value), 4) AS total FROM w GROUP BY 1, 2
    """,
)
def rolling_snapshot_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-day windows sliding by a day, over the stream, from its days.

    An event without a time counts, as any other, in seven windows; their start is null.
    """
    out = snapshots.rolling_from_days(_partials(spark, _stream(spark, sf_dir)), 7)
    return rounded(rounded(out.withColumn("start", F.col("start").cast("string")), 4, "peak", "total"), 9, "mean_value")


@query(
    "stream_series_metrics",
    f"SELECT event_type AS country, CAST(min(CASE WHEN value >= 200 THEN {_T} END) AS INTEGER) AS arrival, "
    "round(max(value), 4) AS peak FROM events GROUP BY 1",
)
def stream_series_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partials per country and day from the stream, in append mode to files, then put together."""
    return rounded(snapshots.merge_partials(_partials(spark, _stream(spark, sf_dir), 200.0)), 4, "peak")


@query(
    "rolling_restarts",
    """
    WITH w AS (SELECT event_type AS country, value, unnest(range(3)) AS back, CAST(ts AS DATE) AS day FROM events)
    SELECT country, CAST(day - CAST(back AS INTEGER) AS VARCHAR) AS start, count(*) AS n, round(avg(value), 9) AS mean_value,
    round(max(value), 4) AS peak, round(sum(value), 4) AS total FROM w GROUP BY 1, 2
    """,
)
def rolling_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-day windows over a stream of many batches that is stopped and started again."""
    path, checkpoint = fresh_path(spark, "days"), fresh_path(spark, "checkpoint")
    kinds = []

    def start(stream: DataFrame, watermark: str):
        days = snapshots.series_partials(stream, watermark)
        kinds.append(days.schema)
        return snapshots.sink_files(days, path, checkpoint)

    _rounds(spark, sf_dir, start)
    closed = spark.read.schema(kinds[0]).parquet(path)
    out = snapshots.rolling_from_days(closed.unionByName(snapshots.open_partials(spark, checkpoint)), 3)
    return rounded(rounded(out.withColumn("start", F.col("start").cast("string")), 4, "peak", "total"), 9, "mean_value")


@query(
    "stream_ema",
    """
    WITH RECURSIVE x AS (SELECT event_type AS country, event_id, value,
        row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL),
    e AS (SELECT country, event_id, k, 0.2 * coalesce(value, 0) AS ema FROM x WHERE k = 1
          UNION ALL SELECT x.country, x.event_id, x.k, 0.2 * coalesce(x.value, 0) + 0.8 * e.ema
          FROM e JOIN x ON x.country IS NOT DISTINCT FROM e.country AND x.k = e.k + 1)
    SELECT country, event_id, round(ema, 6) AS ema FROM e
    """,
)
def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving averages by time over a stream of many batches that is stopped and started again."""
    path, checkpoint = fresh_path(spark, "averages"), fresh_path(spark, "checkpoint")
    kinds = []

    def start(stream: DataFrame, watermark: str):
        averages = stateful.stream_ema(stream, watermark, key="country", step="event_id", value="i", chunk_s=3600)
        kinds.append(averages.schema)
        return snapshots.sink_files(averages, path, checkpoint)

    _rounds(spark, sf_dir, start)
    done = spark.read.schema(kinds[0]).parquet(path)
    out = stateful.carried_ema(done.unionByName(stateful.waiting_ema(spark, checkpoint, kinds[0])))
    return rounded(out.select("country", "event_id", "ema"), 6, "ema")


@query(
    "stream_last_n",
    "SELECT country, event_id, i FROM (SELECT event_type AS country, event_id, value AS i, "
    "row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 40",
)
def stream_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffer of 40 slots per country, kept in the state of a stream that is stopped and started again."""
    path, checkpoint = fresh_path(spark, "given-up"), fresh_path(spark, "checkpoint")
    kinds = []

    def start(stream: DataFrame, watermark: str):
        kinds.append(stream.schema)
        return snapshots.sink_files(stateful.stream_last_n(stream, 40, "event_id", ["country"], salts=4), path, checkpoint)

    _rounds(spark, sf_dir, start)
    return stateful.last_n(spark, checkpoint, kinds[0], 40, "event_id", ["country"]).select("country", "event_id", "i")


@query(
    "stream_versions",
    f"SELECT event_type AS country, CAST(coalesce(min(CASE WHEN value >= 200 THEN {_T} END), count(*)) AS INTEGER) AS arrival, "
    "round(max(value), 4) AS peak FROM events GROUP BY 1",
)
def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival and peak as versions in append-only files, compacted after every run of the stream."""
    path, checkpoint = fresh_path(spark, "versions"), fresh_path(spark, "checkpoint")
    kinds, keys = [], ["country", "part"]

    def start(stream: DataFrame, watermark: str):
        if kinds:
            versions.compact(spark, path, kinds[0], keys)
        rows = stateful.stream_series_versions(stream, thresh=200.0, rows_per_part=["event_id"], parts=4)
        kinds.append(rows.schema)
        return snapshots.sink_files(rows, path, checkpoint)

    _rounds(spark, sf_dir, start)
    newest = versions.newest(spark, path, kinds[0], keys)
    return rounded(snapshots.merge_partials(stateful.series_partials_of(newest)), 4, "peak")
