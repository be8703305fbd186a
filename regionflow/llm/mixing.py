"""Mixes sources to target weights: whole epochs first, then a weighted draw of the rest.

The draw is Efraimidis and Spirakis' sampling: each document gets an exponential
key, -ln(u) / quality weight, and a source's documents are taken in key order
until its token budget is used up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.operators.skew import stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3.0
SLICES = 2048


def uniform(seed: int, *parts: Column) -> Column:
    """A fixed number in (0, 1) for a seed and a row's values; null parts count as a text of their own."""
    named = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *named)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_epochs: float = MOST_EPOCHS, share: float = 1.0
) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The sources, by code point with null last, get `weights` in turn and share
    `share` of all sizes by them. A target stops at `most_epochs` times its
    source's size; the excess goes to the others by weight until none is above.
    That is one level for all: the target is min(limit, level * weight), and the
    level follows from the sources in the order of limit / weight. The table has
    one row per source, so its windows are small.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")).alias("w"),
        (F.col("source_size") * F.lit(float(most_epochs))).alias("limit"),
    )
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    levels = weighed.withColumns(
        {
            "level": (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(onward),
            "at": F.row_number().over(by_ratio),
        }
    )
    fits = F.when(F.col("level") <= F.col("limit") / F.col("w"), F.struct("at", "level"))
    level = F.min(fits).over(Window.partitionBy())["level"]
    return levels.withColumn("settled", level).select(
        "source",
        "source_size",
        F.when(F.col("settled").isNull(), F.col("limit"))
        .otherwise(F.least("limit", F.col("settled") * F.col("w")))
        .alias("target"),
    )


def mix(
    rows: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most_epochs: float = MOST_EPOCHS,
    share: float = 1.0,
    slices: int = SLICES,
) -> DataFrame:
    """`rows` with `source_size`, `target`, `copies` and `taken` (size times copies).

    `rows` holds `source`, `size` (not null), `rid` (sets ties in order) and `key` in [0, inf), the
    exponential key; other columns are carried on. All documents of a source are taken
    floor(target / source_size) times; of the rest of the target, those first in
    key order once more, up to the one whose middle passes it, so the source
    ends within half a document of its target.

    Keys are cut into `slices` even parts, whose pre-summed sizes give each slice
    its start; only within a slice are documents sorted, so a large source is
    spread out.
    """
    sliced = stored(
        rows.withColumn("_slice", F.floor((1.0 - F.exp(-F.col("key"))) * slices).cast("int")), "mix-rows"
    )
    sums = stored(sliced.groupBy("source", "_slice").agg(F.sum("size").alias("size")), "mix-slices")
    targets = source_targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_epochs, share)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    along = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        sums.withColumn("_start", F.coalesce(F.sum("size").over(along), F.lit(0)))
        .drop("size")
        .alias("s")
        .join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select("s.*", "source_size", "target", epochs.cast("long").alias("_epochs")),
        "mix-starts",
    )
    near = Window.partitionBy("r.source", "r._slice").orderBy("key", "rid").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    before = F.col("_start") + F.coalesce(F.col("_near"), F.lit(0))
    again = (F.col("size") > 0) & (before + F.col("size") / 2 <= rest)
    copies = F.col("_epochs") + F.when(again, 1).otherwise(0)
    return (
        sliced.alias("r")
        .withColumn("_near", F.sum("size").over(near))
        .alias("r")
        .join(
            starts.alias("s"),
            F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r._slice") == F.col("s._slice")),
        )
        .select(
            "r.*",
            "source_size",
            "target",
            copies.cast("long").alias("copies"),
            (copies * F.col("size")).cast("long").alias("taken"),
        )
        .drop("_slice", "_near")
    )
