"""Targets, loss surface over a parameter grid, and its best cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow import constants as K
from regionflow.operators.series import series_metrics
from regionflow.sources.tables import rows_to_df


def param_grid(
    spark: SparkSession,
    betas: Sequence[float] = tuple(K.BETA_GRID),
    travels: Sequence[float] = tuple(K.TRAVEL_GRID),
) -> DataFrame:
    """The cells of two parameter lists, beta-major, with their grid position."""
    cells = [(beta, travel) for beta in betas for travel in travels]
    rows = [(pos, beta, travel) for pos, (beta, travel) in enumerate(cells)]
    return rows_to_df(spark, rows, "grid_pos INT, beta DOUBLE, travel DOUBLE")


def join_targets(metrics: DataFrame, targets: DataFrame, key: str = "entity") -> DataFrame:
    """Residuals against `targets (entity, t_arrive, peak)`; no target, no residual."""
    goal = targets.select(
        key, F.col("t_arrive").alias("_goal_arrive"), F.col("peak").alias("_goal_peak")
    )
    arrival = F.col("arrival").cast("double")
    return (
        metrics.join(goal, key, "left")
        .withColumn("arrival_resid", arrival - F.coalesce("_goal_arrive", arrival))
        .withColumn("peak_resid", F.col("peak") - F.coalesce("_goal_peak", "peak"))
        .drop("_goal_arrive", "_goal_peak")
    )


def rmse(x: Column) -> Column:
    """Aggregate: root of the mean square, 0 without rows."""
    mean = F.sum(x * x) / F.greatest(F.lit(1.0), F.count(x).cast("double"))
    return F.coalesce(F.sqrt(mean), F.lit(0.0))


def loss_surface(
    series: DataFrame,
    targets: DataFrame,
    cell: Sequence[str] = ("beta", "travel"),
    key: str = "entity",
    thresh: float = 10.0,
) -> DataFrame:
    """Loss of every grid cell: half arrival error, half peak error."""
    residuals = join_targets(series_metrics(series, [*cell, key], thresh), targets, key)
    loss = F.lit(0.5) * rmse(F.col("arrival_resid")) + F.lit(0.5) * rmse(F.col("peak_resid"))
    return residuals.groupBy(*cell).agg(loss.alias("loss"))


def best_cell(surface: DataFrame, grid: DataFrame) -> DataFrame:
    """The cell with the least loss; the first in grid order wins a tie.

    A NaN or infinite loss never wins. Without a winner the first grid cell is
    returned, and without a grid the fixed one, both with the largest double.
    """
    cells = grid.join(surface, ["beta", "travel"], "left")
    wins = ~F.isnan("loss") & (F.col("loss") < F.lit(K.NO_CELL_LOSS))
    cell = F.struct("beta", "travel", "loss")
    order = F.when(wins, F.struct("loss", "grid_pos"))
    picked = cells.agg(
        F.min_by(cell, order).alias("best"), F.min_by(cell, F.col("grid_pos")).alias("head")
    )
    return picked.select(
        F.coalesce("best.beta", "head.beta", F.lit(K.NO_CELL_BETA)).alias("beta"),
        F.coalesce("best.travel", "head.travel", F.lit(K.NO_CELL_TRAVEL)).alias("travel"),
        F.coalesce("best.loss", F.lit(K.NO_CELL_LOSS)).alias("loss"),
    )
