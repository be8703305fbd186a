"""Running values of long keys by a tree of chunks.

Every chunk of a key maps the value it begins with to the one it ends with, as
x -> a * x + b; plain sums have a = 1. Such maps compose associatively, so a key
with many chunks is cut into blocks of up to FAN neighbours, blocks into blocks of
blocks, until no key has more than FAN of them; each level is one grouping. On the
way down a block passes on the value it begins with. No task holds a whole key that is
longer, and no list is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionflow.operators.skew import key_of, stored

#: Neighbours that are put together in one block.
FAN = 1024
#: Rows that a task takes of a level.
TASK_ROWS = 8192


def _composed(level: DataFrame, affine: bool, most: int) -> DataFrame:
    """Adds `_a`, `_b`, the maps up to and with each row of a block, and `_a0`, `_b0`, those before it."""
    along = Window.partitionBy("_block").orderBy("_c")
    if not affine:
        before = F.sum("b").over(along.rowsBetween(Window.unboundedPreceding, -1))
        return level.withColumns({"_b": F.sum("b").over(along.rowsBetween(Window.unboundedPreceding, 0)), "_b0": before})
    done = level.withColumns({"_a": F.col("a"), "_b": F.col("b")})
    step = 1
    while step < min(FAN, most):  # after each turn a row holds the maps of twice as many rows
        back = lambda c, n=step: F.lag(c, n).over(along)
        done = done.withColumns({"_a9": back("_a"), "_b9": back("_b")}).withColumns(
            {"_a": F.coalesce(F.col("_a") * F.col("_a9"), "_a"), "_b": F.coalesce(F.col("_a") * F.col("_b9") + F.col("_b"), "_b")}
        )
        step *= 2
    return done.withColumns({"_a0": F.lag("_a", 1).over(along), "_b0": F.lag("_b", 1).over(along)}).drop("_a9", "_b9")


def entering(ends: DataFrame, affine: bool = True, most: int | None = None) -> DataFrame:
    """(_at, _in): the value that each chunk begins with, 0 for a key's first.

    `ends` has a row for each chunk: `_at`, a struct of `key` (a struct, so that null
    keys are keys) and `chunk` (a whole number, null first), `b` and, if
    `affine`, `a`. Chunks of a key need not follow each other without gaps. If it is
    known that no key has more than `most` chunks and these make one block, nothing
    is counted or written.
    """
    names = ["a", "b"] if affine else ["b"]
    level = ends.select(F.col("_at.key").alias("_key"), F.col("_at.chunk").cast("bigint").alias("_c"), *names)
    rows, known = 0, most is not None and most <= FAN
    level = level if known else stored(level, "chunk-ends")
    levels = []
    while True:
        if not known:
            sizes = level.groupBy("_key").agg(F.count("*").alias("n"))
            rows, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        top = most <= FAN
        block = F.lit(0).cast("bigint") if top else F.floor(F.col("_c") / F.lit(FAN))
        cut = level.withColumn("_block", F.struct(F.col("_key").alias("key"), block.alias("chunk")))
        if rows > TASK_ROWS:
            cut = cut.repartition(-(-rows // TASK_ROWS) * 2, "_block")
        done = _composed(cut, affine, most)
        if top:
            levels.append(done)
            break
        done = stored(done, "level")
        levels.append(done)
        last = F.max_by(F.struct(*[F.col(f"_{n}").alias(n) for n in names]), F.struct("_c")).alias("last")
        above = done.groupBy("_block").agg(last)
        level = stored(above.select(F.col("_block.key").alias("_key"), F.col("_block.chunk").alias("_c"), "last.*"), "level-ends")
    at = F.struct(F.col("_key").alias("key"), F.col("_c").alias("chunk")).alias("_at")
    found = levels.pop().select(at, F.coalesce("_b0", F.lit(0)).alias("_in"))
    while levels:
        come = found.select(F.col("_at").alias("_block"), F.col("_in").alias("_come"))
        carried = F.coalesce(F.col("_a0") * F.col("_come"), "_come") if affine else F.col("_come")
        found = levels.pop().join(come, "_block").select(at, (carried + F.coalesce("_b0", F.lit(0))).alias("_in"))
    return found


def running_total(rows: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Running sum of `value` per key, `order` ascending, current row included.

    `chunk`, a whole number, cuts each key's order into consecutive pieces. Rows are
    only sorted within their piece; the pieces' totals, summed before the shuffle,
    give each piece its start. Null keys form a group of their own, and nulls in
    the order come first.
    """
    near = Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_at", F.struct(key_of(keys).alias("key"), F.col(chunk).cast("bigint").alias("chunk")))
    low, high = rows.agg(F.min(chunk), F.max(chunk)).first()
    most = 1 if low is None else int(high - low) + 2  # and rows without a chunk
    starts = entering(placed.groupBy("_at").agg(F.coalesce(F.sum(value), F.lit(0)).alias("b")), affine=False, most=most)
    return (
        placed.withColumn(out, F.sum(value).over(near))
        .join(starts, "_at")
        .withColumn(out, F.col(out) + F.col("_in"))
        .drop("_in", "_at")
    )
