"""Largest-remainder allocation of whole totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.operators.skew import find_hot, key_of, stored

HOT_ROWS = 20_000_000
#: Even parts that fractions and idx ranges of hot groups are counted by.
PARTS = 1024
EXACT = "decimal(28,18)"


def apportion_columns(df: DataFrame, splits: Mapping[str, Sequence[tuple[str, Column]]]) -> DataFrame:
    """Split a row's own totals over a few weights each, largest remainder first.

    `splits` maps a total column to (column to add, weight) pairs, the earlier
    pair winning a tie. Each stage is its own projection, so that no expression
    holds copies of another.
    """
    def plus(names: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [F.col(n) for n in names])

    parts = {total: [name for name, _ in pairs] for total, pairs in splits.items()}
    of = lambda kind, names: [f"_{kind}_{n}" for n in names]
    each = [(total, n) for total, names in parts.items() for n in names]
    out = df.withColumns({f"_w_{n}": w for pairs in splits.values() for n, w in pairs})
    out = out.withColumns({f"_sum_{t}": plus(of("w", names)) for t, names in parts.items()})
    raw = {
        f"_raw_{n}": F.when(
            (F.col(t) > 0) & (F.col(f"_sum_{t}") > 0), (F.col(f"_w_{n}") / F.col(f"_sum_{t}")) * F.col(t)
        ).otherwise(F.lit(0.0))
        for t, n in each
    }
    out = out.withColumns(raw)
    out = out.withColumns({f"_base_{n}": F.floor(f"_raw_{n}").cast("bigint") for _, n in each})
    left = {
        f"_left_{t}": F.when(
            (F.col(t) > 0) & (F.col(f"_sum_{t}") > 0), F.col(t).cast("bigint") - plus(of("base", names))
        ).otherwise(F.lit(0))
        for t, names in parts.items()
    }
    fractions = {f"_frac_{n}": F.col(f"_raw_{n}") - F.col(f"_base_{n}") for _, n in each}
    out = out.withColumns(left | fractions)
    ranks = {}
    for names in parts.values():
        for k, n in enumerate(names):
            mine = F.col(f"_frac_{n}")
            ahead = [
                ((F.col(f"_frac_{m}") >= mine) if j < k else (F.col(f"_frac_{m}") > mine)).cast("int")
                for j, m in enumerate(names)
                if j != k
            ]
            ranks[f"_rank_{n}"] = reduce(lambda a, b: a + b, ahead, F.lit(0))
    out = out.withColumns(ranks)
    gets = {
        n: F.col(f"_base_{n}") + F.when(F.col(f"_rank_{n}") < F.col(f"_left_{t}"), 1).otherwise(0)
        for t, n in each
    }
    return out.select(*df.columns, *[x.alias(n) for n, x in gets.items()])


def apportion(
    df: DataFrame,
    group: Sequence[str],
    totals: Mapping[str, str],
    weight: str = "w",
    idx: str = "idx",
    hot_rows: int | None = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Split whole totals over the rows of each group in proportion to `weight`.

    `totals` maps a column holding the group's total to the column to add. The
    floor of each share is given out first; what is left goes to the largest
    fractions, the lower `idx` first. A total or a weight sum of 0 or less gives
    zeros. `idx` is numeric and unique within its group.

    Weights are taken relative to the largest of their group and summed as
    decimals: the same shares in any order and for tiny and huge weights alike,
    so a group's size decides nothing but how its rows are ranked. A missing
    weight counts as 0.

    Ordinary groups are ranked in one window. Groups above `hot_rows` rows are
    never gathered: they are written out, the fraction at which the left-over
    units run out is found by counting, and each row is compared with it.
    Looking for such groups takes a counting job over `df`, unless the caller
    knows their keys (`hot`, on columns of `group`) or that there are none
    (`hot_rows=None`).
    """
    group = list(group)
    if hot is None and hot_rows is not None:
        hot = find_hot(df, group, hot_rows)
    if hot is None:
        return _by_window(df, group, totals, weight, idx)
    keys = hot.select(key_of(hot.columns).alias("_hot"))
    placed = df.withColumn("_hot", key_of(hot.columns))
    usual = placed.join(keys, "_hot", "left_anti").drop("_hot")
    big = stored(placed.join(keys, "_hot", "left_semi").drop("_hot"), "hot-rows")
    return _by_window(usual, group, totals, weight, idx).unionByName(
        _by_counting(big, group, totals, weight, idx)
    )


def _relative(weight: str, largest: Column) -> Column:
    """A weight as a part of its group's largest one."""
    return F.when(largest > 0, F.coalesce(F.col(weight), F.lit(0.0)).cast("double") / largest).otherwise(F.lit(0.0))


def _shares(df: DataFrame, total: str) -> DataFrame:
    """Adds _valid, _base and _frac for one total, given the relative weight _rel and its sum _sum."""
    valid = (F.col(total) > 0) & (F.col("_sum") > 0)
    raw = F.when(valid, F.try_divide("_rel", "_sum") * F.col(total)).otherwise(F.lit(0.0))
    base = F.floor(raw)
    return df.withColumns({"_valid": valid, "_base": base.cast("bigint"), "_frac": raw - base})


def _by_window(
    df: DataFrame, group: list[str], totals: Mapping[str, str], weight: str, idx: str
) -> DataFrame:
    every = Window.partitionBy(*group)
    out = df.withColumn("_rel", _relative(weight, F.max(F.abs(weight)).over(every).cast("double")))
    out = out.withColumn("_sum", F.sum(F.col("_rel").cast(EXACT)).over(every).cast("double"))
    for total, name in totals.items():
        best_first = Window.partitionBy(*group).orderBy(F.desc("_frac"), idx)
        left = F.col(total).cast("bigint") - F.sum("_base").over(every)
        out = (
            _shares(out, total)
            .withColumn("_left", F.when(F.col("_valid"), left).otherwise(F.lit(0)))
            .withColumn("_rank", F.row_number().over(best_first))
            .withColumn(
                name, F.col("_base") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)
            )
            .drop("_valid", "_base", "_frac", "_left", "_rank")
        )
    return out.drop("_sum", "_rel")


def _crossing(counts: DataFrame, order: Column) -> DataFrame:
    """The step of each group `_at` at which the running count reaches `_need`.

    `_need` becomes what is still needed within that step.
    """
    upto = Window.partitionBy("_at").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_upto") - F.col("_n")
    return (
        counts.withColumn("_upto", F.sum("_n").over(upto))
        .filter((before < F.col("_need")) & (F.col("_need") <= F.col("_upto")))
        .withColumn("_need", F.col("_need") - before)
        .drop("_upto", "_n")
    )


def _step(rows: DataFrame, step: Column, order: Column) -> DataFrame:
    """The rows of the step (`_step`) in which the `_need`-th row of their group lies; `_need` then counts within it."""
    stepped = rows.withColumn("_step", step)
    counts = stepped.groupBy("_at", "_need", "_step").agg(F.count("*").alias("_n"))
    found = _crossing(counts, order)
    return stepped.drop("_need").join(found, ["_at", "_step"])


def _by_counting(
    df: DataFrame, group: list[str], totals: Mapping[str, str], weight: str, idx: str
) -> DataFrame:
    """Only counts per part of a group are shuffled by group; rows are joined with one row of their group."""
    placed = df.withColumn("_at", key_of(group))
    largest = placed.groupBy("_at").agg(F.max(F.abs(weight)).cast("double").alias("_largest"))
    scaled = placed.join(largest, "_at").withColumn("_rel", _relative(weight, F.col("_largest"))).drop("_largest")
    sums = scaled.groupBy("_at").agg(F.sum(F.col("_rel").cast(EXACT)).cast("double").alias("_sum"))
    start = stored(scaled.join(sums, "_at"), "hot-shares")
    out = start
    for total, name in totals.items():
        rows = _shares(start, total)
        need = F.max(F.col(total).cast("bigint")) - F.sum("_base")
        needs = rows.filter("_valid").groupBy("_at").agg(need.alias("_need"))
        needy = rows.select("_at", idx, "_frac").join(needs, "_at")
        # the fraction at which the left-over units run out: first its part, then itself
        part = _step(needy, F.floor(F.col("_frac") * PARTS), F.desc("_step")).drop("_step")
        tied = _step(part, F.col("_frac"), F.desc("_step")).withColumnRenamed("_step", "_edge")
        # among rows tied at that fraction, the last idx that still gets a unit: its part of the idx range, then itself
        ends = tied.groupBy("_at").agg(
            F.min(idx).cast("double").alias("_low"), F.max(idx).cast("double").alias("_high")
        )
        place = (F.col(idx) - F.col("_low")) / (F.col("_high") - F.col("_low") + 1.0)
        near = _step(tied.join(ends, "_at"), F.floor(place * PARTS), F.asc("_step"))
        last = (
            near.withColumn("_rank", F.row_number().over(Window.partitionBy("_at").orderBy(idx)))
            .filter(F.col("_rank") == F.col("_need"))
            .select("_at", "_edge", F.col(idx).alias("_last"))
        )
        gets = (F.col("_frac") > F.col("_edge")) | (
            (F.col("_frac") == F.col("_edge")) & (F.col(idx) <= F.col("_last"))
        )
        out = (
            _shares(out, total)
            .join(last, "_at", "left")
            .withColumn(name, F.col("_base") + F.when(gets, 1).otherwise(0))
            .drop("_valid", "_base", "_frac", "_edge", "_last")
        )
    return out.drop("_sum", "_rel", "_at")
