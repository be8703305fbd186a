"""Training-log summaries and moving averages."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionflow.operators.scan import entering, running_total
from regionflow.operators.skew import key_of

MAX_CHUNK = 100_000


def downsample_every(df: DataFrame, k: int, step: str = "step") -> DataFrame:
    return df.filter(F.col(step) % k == 0)


def epoch_summary(rows: DataFrame, order: str = "step") -> DataFrame:
    """Per epoch: mean reward and loss; epsilon, final_i, final_d of the last row."""
    last = lambda c: F.max_by(c, order).alias(c)
    return rows.groupBy("epoch").agg(
        F.avg("total_reward").alias("avg_reward"),
        F.avg("avg_loss").alias("avg_loss"),
        last("epsilon"),
        last("final_i"),
        last("final_d"),
    )


def epoch_entity_summary(rows: DataFrame, key: str = "entity", order: str = "step") -> DataFrame:
    """Per epoch and entity: mean reward; s, i, d and eps at the last step."""
    last = lambda c, name: F.max_by(c, order).alias(name)
    return rows.groupBy("epoch", key).agg(
        F.avg("reward").alias("avg_reward"),
        last("s", "final_s"),
        last("i", "final_i"),
        last("d", "final_d"),
        last("eps", "epsilon"),
    )


def reward_spread(rows: DataFrame, by: Sequence[str] = ("step",), value: str = "reward") -> DataFrame:
    """Mean, population variance and deviation, variation and range over entities.

    Decimal values are summed exactly, so that a mean of 0 gives a variation of 0.
    """
    return (
        rows.groupBy(*by)
        .agg(
            (F.sum(value).cast("double") / F.count(value)).alias("mean"),
            F.var_pop(value).alias("variance"),
            F.stddev_pop(value).alias("std"),
            (F.max(value) - F.min(value)).alias("range"),
        )
        .withColumn(
            "cv", F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")).otherwise(F.lit(0.0))
        )
    )


def cross_entity_mean(
    rows: DataFrame, by: Sequence[str] = ("step",), values: Sequence[str] = ("eps", "loss")
) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.avg(v).alias(f"{v}_mean") for v in values])


def epoch_totals(rows: DataFrame, steps_per_epoch: int) -> DataFrame:
    """Reward summed; loss summed over the configured steps, not the rows seen."""
    return rows.groupBy("epoch").agg(
        F.sum("reward").alias("total_reward"),
        (F.sum("loss") / F.lit(float(max(1, steps_per_epoch)))).alias("avg_loss"),
    )


def world_total(states: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Whole-world sums as BIGINT, per scenario when `by` is given."""
    return states.groupBy(*by).agg(*[F.sum(F.col(c).cast("bigint")).alias(f"{c}_total") for c in columns])


def running_mean(
    rows: DataFrame, keys: Sequence[str] = ("epoch",), t: str = "t", value: str = "loss",
    out: str = "running_mean", chunk: int = MAX_CHUNK,
) -> DataFrame:
    """Sum of the values so far over max(1, t + 1), within each key."""
    cut = rows.withColumn("_chunk", F.floor(F.col(t) / F.lit(chunk)))
    total = running_total(cut, keys, "_chunk", [t], value, "_so_far")
    steps = F.greatest(F.lit(1), F.col(t) + 1).cast("double")
    return total.withColumn(out, F.col("_so_far") / steps).drop("_chunk", "_so_far")


def ema(
    rows: DataFrame,
    key: str = "entity",
    step: str = "step",
    value: str = "reward",
    alpha: float = 0.2,
    every: int = 1,
    seed_first: bool = False,
    out: str = "ema",
    chunk: int | None = None,
) -> DataFrame:
    """e = alpha * x + (1 - alpha) * e over every `every`-th step, from e = 0.

    With `seed_first` the first non-zero value becomes e as it is.

    e is a weighted running sum, so each chunk of steps is summed on its own and
    then receives the e that the chunks before it come to (`scan.entering`). A chunk is short enough
    that the growing weights stay far from overflow. Null keys are an entity of
    their own; rows without a step come before all others.
    """
    kept = (downsample_every(rows, every, step) if every > 1 else rows).withColumn("_at", key_of([key]))
    if seed_first:
        first = kept.filter(F.col(value) != 0).groupBy("_at").agg(F.min(step).alias("_first"))
        kept = kept.join(first, "_at", "left")
    else:
        kept = kept.withColumn("_first", F.lit(None).cast("bigint"))
    is_seed = F.col("_first").isNotNull() & (F.col(step) == F.col("_first"))
    if alpha >= 1.0:
        return kept.withColumn(out, F.col(value).cast("double")).drop("_first", "_at")
    if alpha <= 0.0:
        seeds = kept.filter(is_seed).select("_at", F.col(value).cast("double").alias("_seed"))
        started = F.col("_first").isNotNull() & (F.col(step) >= F.col("_first"))
        return (
            kept.join(seeds, "_at", "left")
            .withColumn(out, F.when(started, F.col("_seed")).otherwise(F.lit(0.0)))
            .drop("_first", "_seed", "_at")
        )

    keep = 1.0 - alpha
    rate = -math.log(keep)
    chunk = min(MAX_CHUNK, max(1, int(230 / rate))) if chunk is None else chunk
    weight = F.when(is_seed, F.lit(1.0)).otherwise(F.lit(alpha))
    power = lambda n: F.pow(F.lit(keep), n.cast("double"))

    near = Window.partitionBy("_at").orderBy(step)
    so_far = near.rowsBetween(Window.unboundedPreceding, 0)
    piece = F.floor(F.col(step) / F.lit(every * chunk))
    local = (
        kept.withColumn("_at", F.struct(F.col("_at").alias("key"), piece.alias("chunk")))
        .withColumn("_pos", F.row_number().over(near))
        .withColumn("_x", weight * F.col(value) / power(F.col("_pos")))
        .withColumn("_local", F.sum("_x").over(so_far) * power(F.col("_pos")))
        .drop("_x", "_first")
    )
    ends = local.groupBy("_at").agg(
        power(F.max("_pos")).alias("a"), F.coalesce(F.max_by("_local", "_pos"), F.lit(0.0)).alias("b")
    )
    low, high = kept.agg(F.min(step), F.max(step)).first()
    most = 2 if low is None else int((high - low) // (every * chunk)) + 3  # steps on a chunk's edge, and those without one
    return (
        local.join(entering(ends, most=most), "_at")
        .withColumn(out, F.col("_local") + F.col("_in") * power(F.col("_pos")))
        .drop("_at", "_pos", "_local", "_in")
    )
