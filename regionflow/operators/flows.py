"""Whole-number flows along edges, per scenario."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow.functions.scalar import whole
from regionflow.operators.apportion import HOT_ROWS, apportion
from regionflow.operators.network import outbound_sums
from regionflow.operators.skew import find_hot


def _leaving(stock: str) -> Column:
    x = whole(F.col(stock))
    return F.least(x, F.floor(x * F.col("out_w") + F.lit(1e-9)).cast("bigint"))


def exports(states: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds export_s and export_i: what leaves each entity, in whole units."""
    sums = outbound_sums(edges).withColumnRenamed("src", "entity")
    return (
        states.join(sums, "entity", "left")
        .withColumn("out_w", F.coalesce("out_w", F.lit(0.0)))
        .withColumn("export_s", _leaving("s"))
        .withColumn("export_i", _leaving("i"))
        .drop("out_w")
    )


def allocate_exports(
    exported: DataFrame,
    edges: DataFrame,
    scenario: Sequence[str] = (),
    idx: str = "idx",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Exports split over the destinations: (scenario, src, dst, move_s, move_i).

    `edges` carries a numeric `idx` per destination that settles ties. Sources
    with more than `hot_rows` edges are found on the edge list alone.
    """
    out = exported.select(*scenario, F.col("entity").alias("src"), "export_s", "export_i")
    routes = edges.filter(F.col("src") != F.col("dst")).select("src", "dst", "w", idx)
    totals = {"export_s": "move_s", "export_i": "move_i"}
    hot = None if hot_rows is None else find_hot(routes, ["src"], hot_rows)
    shares = apportion(out.join(routes, "src"), [*scenario, "src"], totals, "w", idx, None, hot)
    return shares.select(*scenario, "src", "dst", "move_s", "move_i")


def net_flow(moves: DataFrame, scenario: Sequence[str] = ()) -> DataFrame:
    """Imports minus exports per entity.

    Every export is split completely, so the moves hold both sides: each row is
    counted once where it arrives and once, negative, where it leaves.
    """
    sides = F.inline(
        F.array(
            F.struct(F.col("dst").alias("entity"), F.col("move_s").alias("s"), F.col("move_i").alias("i")),
            F.struct(F.col("src").alias("entity"), (-F.col("move_s")).alias("s"), (-F.col("move_i")).alias("i")),
        )
    )
    return (
        moves.select(*scenario, sides)
        .groupBy(*scenario, "entity")
        .agg(F.sum("s").alias("net_s"), F.sum("i").alias("net_i"))
    )


def apply_flows(
    states: DataFrame, net: DataFrame, t_max: Column | int, scenario: Sequence[str] = ()
) -> DataFrame:
    """States after the flows, never below 0, one step later (at most t_max)."""
    limit = t_max if isinstance(t_max, Column) else F.lit(t_max)
    moved = lambda c: F.greatest(
        F.lit(0.0), F.col(c) + F.coalesce(f"net_{c}", F.lit(0)).cast("double")
    )
    return (
        states.join(net, [*scenario, "entity"], "left")
        .withColumn("s", moved("s"))
        .withColumn("i", moved("i"))
        .withColumn("t", F.least(F.col("t") + 1, limit).cast("int"))
        .drop("net_s", "net_i")
    )


def flow_step(
    states: DataFrame,
    edges: DataFrame,
    t_max: Column | int,
    scenario: Sequence[str] = (),
    idx: str = "idx",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One exchange between the entities of each scenario."""
    moves = allocate_exports(exports(states, edges), edges, scenario, idx, hot_rows)
    return apply_flows(states, net_flow(moves, scenario), t_max, scenario)
