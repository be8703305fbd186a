"""Long and wide forms of surfaces and metric logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def surface_pivot(surface: DataFrame, travels: Sequence[float]) -> DataFrame:
    """Beta rows by travel columns, sorted by beta; a cell given twice or of an unlisted travel is an error."""
    listed = F.col("travel").isin(*[float(t) for t in travels])
    unlisted = F.raise_error(F.concat(F.lit("unlisted travel "), F.coalesce(F.col("travel").cast("string"), F.lit("null"))))
    surface = surface.withColumn("travel", F.when(listed, F.col("travel")).otherwise(unlisted.cast("double")))
    cells = []
    for travel in travels:
        mine = F.col("travel") == F.lit(float(travel))
        twice = F.raise_error(F.lit(f"more than one loss for travel {travel}")).cast("double")
        loss = F.first(F.when(mine, F.col("loss")), ignorenulls=True)
        cells.append(F.when(F.count_if(mine) > 1, twice).otherwise(loss).alias(str(travel)))
    return surface.groupBy("beta").agg(*cells).orderBy("beta")


#: A log with more keys is no table of a few metrics.
MOST_KEYS = 1000


def log_keys(log: DataFrame) -> list[str]:
    """The keys of a log, in order: one pass, combined before its shuffle, of at most MOST_KEYS rows."""
    keys = [r["key"] for r in log.select("key").filter("key IS NOT NULL").distinct().limit(MOST_KEYS + 1).collect()]
    if len(keys) > MOST_KEYS:
        raise ValueError(f"the log has more than {MOST_KEYS} keys")
    return sorted(keys)


def metrics_wide(
    log: DataFrame, keys: Sequence[str], by: Sequence[str] = ("step",), seq: str = "seq"
) -> DataFrame:
    """One row per flush, one column per key; the last write of a key wins.

    One grouping over all keys. A key that is not listed fails the job.
    """
    listed = F.col("key").isin(*keys)
    unlisted = F.raise_error(F.concat(F.lit("unlisted key "), F.coalesce("key", F.lit("null")))).cast("string")
    checked = log.withColumn("key", F.when(listed, F.col("key")).otherwise(unlisted))
    cells = []
    for key in keys:
        mine = F.col("key") == key
        cells.append(
            F.max_by(F.when(mine, F.col("value")), F.when(mine, F.col(seq))).alias(key)
        )
    return checked.groupBy(*by).agg(*cells)


def entity_keys(
    rows: DataFrame, names: Mapping[str, str], by: Sequence[str] = ("step",), entity: str = "entity"
) -> DataFrame:
    """Long form of per-entity metrics: a column's key is its pattern in `names` with the entity for `{}`."""
    parts = [
        F.struct(F.concat(F.lit(before), F.col(entity), F.lit(after)).alias("key"), F.col(c).cast("double").alias("value"))
        for c, pattern in names.items()
        for before, after in [pattern.split("{}")]
    ]
    return rows.select(*by, F.inline(F.array(*parts))).filter(F.col("value").isNotNull())


def metrics_long(wide: DataFrame, ids: Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """Key and value rows of a wide table; a key without a value gives no row."""
    values = list(keys) if keys is not None else [c for c in wide.columns if c not in ids]
    return wide.unpivot(list(ids), values, "key", "value").filter(F.col("value").isNotNull())
