"""Streams that keep state by key between micro-batches, and that state read as a table.

What a stream has sent to its files and what its last finished batch holds in state
are complementary, so a batch pass over both is complete at any time: nothing has
to be sent through the stream to close it, and rate limits and restarts lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from regionflow.operators.scan import entering
from regionflow.operators.skew import first_per_key, key_of

_NEVER, _NONE = (1 << 63) - 1, -(1 << 63)
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def open_state(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(key, value, partition_id): a stream's state after its last finished batch, or after a given one."""
    reader = spark.read.format("statestore")
    return (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)


# --- moving averages -------------------------------------------------------------

#: What waits lies in a state row as bytes: times, steps and values, in order.
_EMA_STATE = "e double, started boolean, at binary, steps binary, xs binary"
_HELD = ("<i8", "<i8", "<f8")


def _fold(e: float, started: bool, xs: Sequence[float], alpha: float, seed_first: bool) -> tuple[float, bool, list[float]]:
    """The average after each value, from e on."""
    out = []
    for x in xs:
        if seed_first and not started:
            e, started = x, x != 0.0
        else:
            e, started = alpha * x + (1.0 - alpha) * e, True
        out.append(e)
    return e, started, out


def _ema_type(stream: DataFrame, key: str, step: str, out: str, chunked: bool) -> T.StructType:
    kinds = stream.schema
    kept = T.StructType([kinds[key], T.StructField("_at", T.LongType()), kinds[step]]).add(out, T.DoubleType())
    return kept.add("_chunk", T.LongType()).add("_pos", T.LongType()).add("_seeded", T.DoubleType()) if chunked else kept


def _averaged(
    schema: T.StructType, keys: Sequence, at: Sequence[int], steps: Sequence[int], xs: Sequence[float],
    e: float, started: bool, alpha: float, seed_first: bool,
) -> tuple[float, bool, pd.DataFrame]:
    """The rows of a key, or of one of its chunks, with their averages from e on."""
    key, _, step, out, *more = schema.names
    n = len(xs)
    e, started, done = _fold(e, started, xs, alpha, seed_first and not more)
    rows = {key: [keys[0]] * n, "_at": at, step: steps, out: done}
    if more:
        first = seed_first and any(x != 0.0 for x in xs)
        seeded = _fold(0.0, False, xs, alpha, True)[2] if first else [None] * n
        rows |= {"_chunk": [keys[1]] * n, "_pos": range(1, n + 1), "_seeded": pd.Series(seeded, dtype="float64" if first else "object")}
    return e, started, pd.DataFrame(rows)


def stream_ema(
    stream: DataFrame, watermark: str, key: str = "entity", ts: str = "ts", step: str = "step",
    value: str = "reward", alpha: float = 0.2, seed_first: bool = False, out: str = "ema", chunk_s: int | None = None,
) -> DataFrame:
    """(key, _at, step, out): moving averages in the order of (time, step), `_at` being the time in microseconds.

    Files may be out of order by up to `watermark`: a row waits in its key's state
    until the watermark has passed it, then it and all before it are averaged, so the
    result is that of `summary.ema` over the whole stream. Rows that still wait
    come from `waiting_ema`. A null value counts as 0; rows without a time have no
    place and are left out; null keys are a key of their own.

    With `chunk_s` a key's time is cut into chunks of so many seconds, so that no
    task holds a whole key: each is a state row of its own, which is averaged, from 0,
    when the watermark has passed its end. `carried_ema` makes the averages of these
    rows and of those that wait.
    """
    kind = _ema_type(stream, key, step, out, chunk_s is not None)
    size = (chunk_s or 0) * 1_000_000

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        e, started, *held = state.get if state.exists else (0.0, False, b"", b"", b"")
        parts = [[np.frombuffer(bytes(h), t) for h, t in zip(held, _HELD, strict=True)]]
        parts += [[f[c].to_numpy(t) for c, t in zip(("_at", "_step", "_x"), _HELD, strict=True)] for f in frames]
        at, steps, xs = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((xs, steps, at))
        at, steps, xs = at[order], steps[order], xs[order]
        passed = state.getCurrentWatermarkMs() * 1000
        if size:
            end = (int(keys[1]) + 1) * size
            due, wake = (len(at), 0) if end <= passed else (0, -(-end // 1000))
        else:
            due = int(np.searchsorted(at, passed, side="right"))
            wake = int(at[due]) // 1000 + 1 if due < len(at) else 0
        if due:
            e, started, done = _averaged(kind, keys, at[:due].tolist(), steps[:due].tolist(), xs[:due].tolist(), e, started, alpha, seed_first)
        if size and due:
            state.remove()
        else:
            state.update((e, started, *(c[due:].tobytes() for c in (at, steps, xs))))
            if wake:
                state.setTimeoutTimestamp(wake)
        if due:
            yield done

    placed = stream.filter(F.col(ts).isNotNull() & F.col(step).isNotNull()).select(
        key,
        ts,
        F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"),
        F.col(step).cast("bigint").alias("_step"),
        F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_x"),
        *([F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(chunk_s)).alias("_chunk")] if size else []),
    )
    grouped = placed.withWatermark(ts, watermark).groupBy(key, *(["_chunk"] if size else []))
    return grouped.applyInPandasWithState(run, kind, _EMA_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def waiting_ema(
    spark: SparkSession, checkpoint: str, schema: T.StructType, alpha: float = 0.2, seed_first: bool = False
) -> DataFrame:
    """The rows of `stream_ema` (of the given schema, parameters as there) that the watermark has not passed."""
    names = [schema.names[0], *(["_chunk"] if "_chunk" in schema.names else [])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False, name=None):
                keys, (e, started, *held) = row[: len(names)], row[len(names) :]
                lists = [np.frombuffer(bytes(h), t).tolist() for h, t in zip(held, _HELD, strict=True)]
                yield _averaged(schema, keys, *lists, e, started, alpha, seed_first)[2]

    held = open_state(spark, checkpoint).select(*[F.col("key")[n].alias(n) for n in names], "value.groupState.*")
    return held.filter(F.length("xs") > 0).mapInPandas(run, schema)


def carried_ema(rows: DataFrame, alpha: float = 0.2, seed_first: bool = False) -> DataFrame:
    """(key, _at, step, out): the averages of `stream_ema` in chunks, sent and waiting, parameters as there.

    What a chunk ends with follows from what it begins with by one map, so the chunks
    are put together by `scan.entering`. With `seed_first` a key starts in its
    first chunk with a value other than 0.
    """
    key, _, step, out = rows.columns[:4]
    keep = lambda n: F.pow(F.lit(1.0 - alpha), n.cast("double"))
    rows = rows.withColumnRenamed("_at", "_time").withColumn("_key", key_of([key]))
    if seed_first:
        first = rows.filter("_seeded IS NOT NULL").groupBy("_key").agg(F.min("_chunk").alias("_first"))
        rows = rows.join(first, "_key", "left").withColumn(out, F.when(F.col("_chunk") == F.col("_first"), F.col("_seeded")).otherwise(F.col(out)))
    rows = rows.withColumn("_at", F.struct(F.col("_key").alias("key"), F.col("_chunk").alias("chunk")))
    ends = rows.groupBy("_at").agg(keep(F.max("_pos")).alias("a"), F.max_by(out, "_pos").alias("b"))
    return rows.join(entering(ends), "_at").select(
        key, F.col("_time").alias("_at"), step, (F.col(out) + F.col("_in") * keep(F.col("_pos"))).alias(out)
    )


# --- the newest rows ----------------------------------------------------------------

_RING_STATE = "seqs array<bigint>, rows array<string>"


def stream_last_n(stream: DataFrame, n: int, seq: str = "seq", keys: Sequence[str] = (), salts: int = 1) -> DataFrame:
    """(row): the rows that a bounded buffer of the n newest per key, or overall, gives up, each batch.

    The buffer itself is the stream's state, read by `last_n`; rows are held and given
    up as JSON. `seq` is whole and unique; rows without it are the oldest. A buffer
    that many rows go through is kept in `salts` parts of n rows each, of which
    `last_n` takes the newest n. Null keys share a buffer.
    """
    names = [*keys, "_salt"]

    def run(at: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            held += zip(f["_seq"].tolist(), f["_row"].tolist(), strict=True)
            held.sort(key=lambda r: -r[0])
            held, gone = held[:n], held[n:]
            if gone:
                yield pd.DataFrame({"row": [r for _, r in gone]})
        state.update(([s for s, _ in held], [r for _, r in held]))

    whole = F.struct(*[F.col(c) for c in stream.columns])
    rows = stream.select(
        *keys,
        F.pmod(F.xxhash64(F.col(seq)), F.lit(salts)).cast("int").alias("_salt"),
        F.coalesce(F.col(seq).cast("bigint"), F.lit(_NONE)).alias("_seq"),
        F.to_json(whole, _JSON).alias("_row"),
    )
    return rows.groupBy(*names).applyInPandasWithState(run, "row string", _RING_STATE, "append", GroupStateTimeout.NoTimeout)


def from_rows(rows: DataFrame, schema: T.StructType, column: str = "row") -> DataFrame:
    """The rows that `stream_last_n` gave up, as they were."""
    return rows.select(F.from_json(column, schema, _JSON).alias("_row")).select("_row.*")


def last_n(
    spark: SparkSession, checkpoint: str, schema: T.StructType, n: int, seq: str = "seq",
    keys: Sequence[str] = (), batch: int | None = None,
) -> DataFrame:
    """The buffer of `stream_last_n` after its last finished batch, or after a given one: rows of `schema`."""
    held = open_state(spark, checkpoint, batch).select(F.explode("value.groupState.rows").alias("row"))
    rows = from_rows(held, schema)
    if not keys:
        return rows.orderBy(F.desc_nulls_last(seq)).limit(n)
    return first_per_key(rows, keys, [F.desc_nulls_last(seq)], n, "_rank").drop("_rank")


# --- results that change -------------------------------------------------------------

_SERIES_STATE = "version bigint, first_hit bigint, n bigint, peak double"


def stream_series_versions(
    stream: DataFrame, key: str = "country", t: str = "t", value: str = "i", thresh: float = 10.0,
    rows_per_part: Sequence[str] = (), parts: int = 1,
) -> DataFrame:
    """(key, part, version, first_hit, n, peak): a new version of each key that a batch touches, for append mode.

    The newest versions are what `stream_series_metrics` holds in update mode:
    `versions.newest` finds them and `snapshots.merge_partials` makes arrival and peak of
    them. A key that holds much of the stream is kept in `parts` parts by a hash of
    the columns `rows_per_part`.
    """

    def run(at: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, first, n, most = state.get if state.exists else (0, _NEVER, 0, float("-inf"))
        for f in frames:
            first, n = min(first, int(f["_hit"].min())), n + len(f)
            most = max(most, float(f["_x"].max()))
        state.update((version + 1, first, n, most))
        yield pd.DataFrame({key: [at[0]], "part": [at[1]], "version": [version + 1], "first_hit": [first], "n": [n], "peak": [most]})

    hit = (F.col(value) >= F.lit(thresh)) & ~F.isnan(value)
    part = F.pmod(F.xxhash64(*rows_per_part), F.lit(parts)) if rows_per_part else F.lit(0)
    rows = stream.select(
        key,
        part.cast("int").alias("part"),
        F.coalesce(F.when(hit, F.col(t).cast("bigint")), F.lit(_NEVER)).alias("_hit"),
        F.coalesce(F.col(value).cast("double"), F.lit(float("-inf"))).alias("_x"),
    )
    kind = T.StructType([stream.schema[key]]).add("part", T.IntegerType())
    for name in ("version", "first_hit", "n"):
        kind = kind.add(name, T.LongType())
    kind = kind.add("peak", T.DoubleType())
    return rows.groupBy(key, "part").applyInPandasWithState(run, kind, _SERIES_STATE, "append", GroupStateTimeout.NoTimeout)


def series_partials_of(newest: DataFrame) -> DataFrame:
    """Versions of `stream_series_versions` as partials for `snapshots.merge_partials`."""
    return newest.withColumns(
        {
            "first_hit": F.when(F.col("first_hit") != _NEVER, F.col("first_hit")),
            "peak": F.when(F.col("peak") != float("-inf"), F.col("peak")),
        }
    )
