"""Replay tables: newest rows, uniform and weighted samples, priorities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.functions.scalar import priority
from regionflow.operators.skew import stored

TINY = 1e-12
#: Chunks of one block when chunks of a whole table are cut.
COUNT_BLOCK = 10_000


def keep_last_n(
    df: DataFrame, n: int, seq: str = "seq", keys: Sequence[str] = (), chunk: int = 100_000
) -> DataFrame:
    """The n rows with the largest `seq` (whole and unique) per key, or overall.

    Rows are first counted per chunk of `seq` before any shuffle. Only chunks
    down to the one where the n-th row lies are read on, and each is ranked on
    its own. Null keys form a group of their own; rows without `seq` come last.
    """
    rows = df.withColumn("_at", F.struct(*[F.col(k) for k in keys], F.floor(F.col(seq) / F.lit(chunk)).alias("_chunk")))
    counts = rows.groupBy("_at").agg(F.count("*").alias("_n"))
    by = [F.col("_at")[k] for k in keys] or [F.lit(0)]
    newest = lambda c: Window.partitionBy(*by).orderBy(c.desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    if not keys:
        # without keys chunks are first cut by their blocks' counts, so that one task orders only a few of them
        counts = stored(counts, "chunk-counts")
        block = F.floor(F.col("_at._chunk") / F.lit(COUNT_BLOCK))
        totals = counts.groupBy(block.alias("_block")).agg(F.sum("_n").alias("_m"))
        above = Window.orderBy(F.desc_nulls_last("_block")).rowsBetween(Window.unboundedPreceding, -1)
        reached = totals.withColumn("_over", F.coalesce(F.sum("_m").over(above), F.lit(0))).filter(F.col("_over") < n)
        counts = counts.filter(block.isNull() | (block >= reached.agg(F.min("_block")).scalar()))
    before = F.col("_upto") - F.col("_n")
    needs = (
        counts.withColumn("_upto", F.sum("_n").over(newest(F.col("_at._chunk"))))
        .filter(before < n)
        .select("_at", (F.lit(n) - before).alias("_need"))
    )
    ranked = Window.partitionBy("_at").orderBy(F.desc_nulls_last(seq))
    return (
        rows.join(needs, "_at")
        .withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= F.col("_need"))
        .select(*df.columns)
    )


def sample_n(df: DataFrame, n: int, seed: int, id: str = "id") -> DataFrame:
    """n rows without replacement: those whose md5 of (seed, id) is least.

    The same rows for the same seed, however the data are partitioned. Rows are
    counted by the first four digits of the hash (65,536 buckets, so that table
    may be broadcast); only buckets up to the one the n-th row lies in are read
    on, and each is ranked on its own.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id).cast("string"))))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, 4))
    upto = Window.partitionBy("_one").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_upto") - F.col("_n")
    buckets = (
        hashed.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_one", F.lit(1))
        .withColumn("_upto", F.sum("_n").over(upto))
        .filter(before < n)
        .select("_bucket", (F.lit(n) - before).alias("_need"))
    )
    in_order = Window.partitionBy("_bucket").orderBy("_hash", id)
    return (
        hashed.join(F.broadcast(buckets), "_bucket")
        .withColumn("_rank", F.row_number().over(in_order))
        .filter(F.col("_rank") <= F.col("_need"))
        .select(*df.columns)
    )


def _children(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes with their parent and their range (low, high] of its weight.

    A parent has at most `fanout` children, whatever the data. The ranges of the
    first and the last child are open, so that rounding loses no draw.
    """
    siblings = Window.partitionBy("parent").orderBy("node")
    upto = F.sum("p").over(siblings.rowsBetween(Window.unboundedPreceding, 0))
    above = F.floor(F.col("node") / F.lit(fanout)).cast("bigint")
    summed = nodes.withColumn("parent", above).withColumn("upto", upto)
    before, after = F.lag("upto").over(siblings), F.lead("upto").over(siblings)
    return summed.select(
        "parent",
        "node",
        "p",
        F.coalesce(before, F.lit(0.0)).alias("base"),
        F.coalesce(before, F.lit(float("-inf"))).alias("low"),
        F.when(after.isNull(), F.lit(float("inf"))).otherwise(F.col("upto")).alias("high"),
    )


def _cell(at: Column, scale: Column, cells: int, more: float = 0.0) -> Column:
    """The one of so many equal cells, from 0 to the scale, that a number lies in; those beyond lie in the outer ones."""
    place = at / F.greatest(F.coalesce(scale, F.lit(0.0)), F.lit(1e-300)) * F.lit(float(cells)) + F.lit(more)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(cells - 1.0), place))).cast("int")


def _in_cells(children: DataFrame, fanout: int) -> DataFrame:
    """`_children` in each cell of their parent's weight that their range touches, about two rows a child.

    A draw meets the children in its own cell only. Sums of a parent's weight may
    differ by rounding, so ranges reach a little further here.
    """
    scale = F.sum("p").over(Window.partitionBy("parent"))
    first, last = (_cell(F.col(c), F.col("_scale"), fanout, more) for c, more in (("low", -1e-3), ("high", 1e-3)))
    return children.withColumn("_scale", scale).withColumn("cell", F.explode(F.sequence(first, last))).drop("_scale")


def _first_draws(draws: DataFrame, n: int) -> DataFrame:
    """The n draws of the smallest ids."""
    if draws.count() <= n:
        return draws
    backwards = draws.withColumn("_back", -F.col("draw_id").cast("bigint"))
    return keep_last_n(backwards, n, "_back").drop("_back")


def weighted_sample(
    rows: DataFrame,
    draws: DataFrame,
    id: str = "id",
    td: str = "td",
    alpha: float = 0.6,
    beta: float = 0.4,
    fanout: int = 256,
) -> DataFrame:
    """One row per draw (draw_id, u): (draw_id, id, p, weight), with replacement.

    A draw takes the first row, by id, at which the running sum of priorities
    reaches u times their total; its weight is (N * p / total)^-beta. At most as
    many draws as rows are served, those of the smallest draw ids. `id` is a
    slot number: whole, unique and not negative.

    The running sum is kept as a tree over id with `fanout` children per node, as
    deep as the largest id needs: a draw walks down from the top, so no sum runs
    over the whole table. The rows are read twice: once for the sums of the
    lowest inner nodes, which are written to the shared folder and from which
    the others are made, and once for the leaves that a draw has reached. On the
    two highest levels, which many draws share, a draw meets the few children in
    its cell (`_in_cells`), below them its node's.
    """
    slot = F.col(id)
    checked = F.when(slot >= 0, slot.cast("bigint")).otherwise(
        F.raise_error(F.lit("a slot number is missing or negative")).cast("bigint")
    )
    leaves = rows.select(checked.alias("node"), priority(F.col(td), alpha).alias("p"))
    parent = F.floor(F.col("node") / F.lit(fanout)).cast("bigint")
    inner = stored(
        leaves.groupBy(parent.alias("node")).agg(F.sum("p").alias("p"), F.count("*").alias("n")), "sample-nodes"
    )
    size, top_node, weight = inner.agg(F.sum("n"), F.max("node"), F.sum("p")).first()
    empty = rows.sparkSession.createDataFrame([], "draw_id long, node long, p double, rows long, total double")
    if not size:
        walk, depth = empty, -1
    else:
        # levels above the leaves: the highest one has at most `fanout` nodes
        depth = 1
        while top_node >= fanout**depth:
            depth += 1

    def level(k: int) -> DataFrame:
        """Nodes k levels above the leaves, k from 1."""
        above = F.floor(F.col("node") / F.lit(fanout ** (k - 1))).cast("bigint")
        return inner.groupBy(above.alias("node")).agg(F.sum("p").alias("p")) if k > 1 else inner.select("node", "p")

    if depth > 0:
        total, goal = F.lit(TINY if weight is None else max(weight, TINY)), F.col("u") * F.col("total")
        walk = (
            _first_draws(draws.select("draw_id", "u"), size)
            .repartition("draw_id")  # a small file's draws too are spread over the tasks
            .select("draw_id", "u", F.lit(size).alias("rows"), total.alias("total"))
            # a goal beyond every sum falls back to the first row
            .withColumn("goal", F.when(goal > F.lit(weight), F.lit(-1.0)).otherwise(goal))
            .select("draw_id", "rows", "total", "goal", F.lit(0).cast("bigint").alias("node"), F.lit(weight).cast("double").alias("p"))
        )
    for k in range(depth, -1, -1):
        at = walk.select("draw_id", "rows", "total", "goal", F.col("node").alias("parent"), F.col("p").alias("scale"))
        if k == 0:
            hit = walk.select(F.col("node").alias("parent")).distinct()
            nodes = leaves.join(hit, parent == F.col("parent"), "left_semi")
        else:
            nodes = level(k)
        # one child's range holds the goal; the others are passed over in the join
        holds = (F.col("low") < F.col("goal")) & (F.col("goal") <= F.col("high"))
        child = _children(nodes, fanout)
        meets = F.col("parent") == F.col("at")
        if k and k >= depth - 1:
            # at most fanout x fanout children, each in about two cells
            child = F.broadcast(_in_cells(child, fanout))
            at = at.withColumn("_cell", _cell(F.col("goal"), F.col("scale"), fanout))
            meets &= F.col("_cell") == F.col("cell")
        walk = at.join(child.withColumnRenamed("parent", "at"), meets & holds).select(
            "draw_id", "rows", "total", (F.col("goal") - F.col("base")).alias("goal"), "node", "p"
        )
    share = F.col("rows") * (F.col("p") / F.col("total"))
    return walk.select(
        "draw_id", F.col("node").alias(id), "p", F.pow(share, F.lit(-beta)).alias("weight")
    )


def update_priorities(
    prio: DataFrame, updates: DataFrame, id: str = "id", alpha: float = 0.6
) -> DataFrame:
    """Priorities `(id, p)` with the given `(id, td, seq)` applied; the last one wins."""
    fresh = updates.groupBy(id).agg(priority(F.max_by("td", "seq"), alpha).alias("_fresh"))
    return (
        prio.join(fresh, id, "left")
        .withColumn("p", F.coalesce("_fresh", "p"))
        .drop("_fresh")
    )
