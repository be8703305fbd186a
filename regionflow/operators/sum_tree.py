"""Weighted draws from a stored sum tree whose priorities change.

Slots 0, 1, ... up to a capacity are leaves; a page holds FAN neighbours' sums in an
array, and pages of pages lead up to one at the top. Pages lie in the shared folder
in groups of PAGES, each group in versions by the round that wrote it. An update
writes new versions of the touched groups along the paths to the top, a draw
reads the groups on its way down, so neither reads more of a larger table. A
round counts once its mark is written; one that breaks off is passed over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.functions.scalar import priority
from regionflow.operators.skew import stored
from regionflow.session import matching

FAN, PAGES = 256, 64
TINY = 1e-12
_PAGE = "page bigint, kids array<double>, counts array<bigint>"


def _depth(capacity: int) -> int:
    depth = 1
    while FAN**depth < capacity:
        depth += 1
    return depth


def _rounds(spark: SparkSession, path: str) -> set[int]:
    return {int(f.split("/")[-2].removeprefix("round=")) for f in matching(spark, f"{path}/done/round=*/_SUCCESS")}


def _shape(spark: SparkSession, path: str) -> tuple[int, float]:
    """The tree's depth and the exponent of its priorities."""
    r = spark.read.schema("depth int, alpha double").parquet(f"{path}/shape").first()
    return r["depth"], r["alpha"]


def _read(spark: SparkSession, path: str, level: int, groups: Sequence[int], done: set[int]) -> DataFrame:
    """The pages of some groups of a level, as the last finished round left them."""
    newest: dict[str, int] = {}
    for start in range(0, len(groups), 1000):
        some = ",".join(str(g) for g in groups[start : start + 1000])
        for f in matching(spark, f"{path}/level={level}/group={{{some}}}/round=*"):
            folder, _, number = f.rpartition("/round=")
            if int(number) in done:
                newest[folder] = max(newest.get(folder, -1), int(number))
    paths = [f"{folder}/round={n}" for folder, n in newest.items()]
    return spark.read.schema(_PAGE).parquet(*paths) if paths else spark.createDataFrame([], _PAGE)


def _write(pages: DataFrame, path: str, level: int, number: int) -> None:
    group = F.floor(F.col("page") / F.lit(PAGES)).alias("group")
    rows = pages.select("page", "kids", "counts", group, F.lit(number).alias("round"))
    # a group's pages are gathered, so that a group is one file
    rows.repartition("group").write.mode("append").partitionBy("group", "round").parquet(f"{path}/level={level}")


def _finish(spark: SparkSession, path: str, number: int) -> None:
    spark.range(1).write.mode("overwrite").parquet(f"{path}/done/round={number}")


def _above(pages: DataFrame) -> DataFrame:
    """(node, p, n): the sum and the number of rows of each page, as a child of the next level."""
    total = lambda c, zero: F.aggregate(c, zero, lambda acc, x: acc + x)
    return pages.select(
        F.col("page").alias("node"), total("kids", F.lit(0.0)).alias("p"), total("counts", F.lit(0).cast("bigint")).alias("n")
    )


def _pages(nodes: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Pages that hold the given nodes (node, p, n); other children as in `old`, or empty."""
    at = F.pmod("node", F.lit(FAN)).cast("int")
    entries = F.map_from_entries(F.collect_list(F.struct(at.alias("at"), F.struct("p", "n").alias("v"))))
    fresh = nodes.groupBy(F.floor(F.col("node") / F.lit(FAN)).alias("page")).agg(entries.alias("new"))
    fresh = fresh.withColumns({"kids": F.lit(None).cast("array<double>"), "counts": F.lit(None).cast("array<bigint>")}) if old is None else fresh.join(old, "page", "left")
    slots = F.sequence(F.lit(0), F.lit(FAN - 1))
    get = lambda part, was, zero: F.transform(slots, lambda i: F.coalesce(F.try_element_at("new", i)[part], F.get(was, i), F.lit(zero)))
    return fresh.select("page", get("p", "kids", 0.0).alias("kids"), get("n", "counts", 0).cast("array<bigint>").alias("counts"))


def _slot(id: str) -> Column:
    slot = F.col(id)
    bad = F.raise_error(F.lit("a slot number is missing or negative")).cast("bigint")
    return F.when(slot >= 0, slot.cast("bigint")).otherwise(bad)


def build(rows: DataFrame, path: str, capacity: int, id: str = "id", td: str = "td", alpha: float = 0.6) -> None:
    """Writes the tree of (id, td), ids being whole, unique, from 0 and below `capacity`."""
    spark, depth = rows.sparkSession, _depth(capacity)
    spark.createDataFrame([(depth, alpha)], "depth int, alpha double").coalesce(1).write.parquet(f"{path}/shape")
    nodes = rows.select(_slot(id).alias("node"), priority(F.col(td), alpha).alias("p"), F.lit(1).cast("bigint").alias("n"))
    for level in range(1, depth + 1):
        pages = stored(_pages(nodes), "pages")
        _write(pages, path, level, 0)
        nodes = _above(pages)
    _finish(spark, path, 0)


def update(spark: SparkSession, path: str, updates: DataFrame, id: str = "id") -> int:
    """Applies (id, td, seq), the last of an id wins; new ids are added. Returns the round's number.

    Only the groups of touched pages are read and written, level by level. Their
    numbers, at most one for each update, come to the driver.
    """
    depth, alpha = _shape(spark, path)
    done = _rounds(spark, path)
    begun = [int(f.rpartition("=")[2]) for f in matching(spark, f"{path}/begun/round=*")]
    number = max([*done, *begun]) + 1
    spark.range(1).write.mode("overwrite").parquet(f"{path}/begun/round={number}")
    room = F.when(F.col("node") < FAN**depth, F.col("node")).otherwise(F.raise_error(F.lit("a slot number is beyond the capacity")).cast("bigint"))
    last = updates.groupBy(_slot(id).alias("node")).agg(priority(F.max_by("td", "seq"), alpha).alias("p"))
    nodes = stored(last.select(room.alias("node"), "p", F.lit(1).cast("bigint").alias("n")), "changes")
    for level in range(1, depth + 1):
        group = F.floor(F.col("node") / F.lit(FAN * PAGES)).alias("g")
        groups = [r["g"] for r in nodes.select(group).distinct().collect()]
        if not groups:
            return max(done)
        old = _read(spark, path, level, groups, done)
        changed = stored(_pages(nodes, old), "pages")
        # pages of the group that did not change are written on with the others
        rest = old.join(changed.select("page"), "page", "left_anti")
        _write(changed.unionByName(rest), path, level, number)
        nodes = _above(changed)
    _finish(spark, path, number)
    return number


def draw(spark: SparkSession, path: str, draws: DataFrame, id: str = "id", beta: float = 0.4) -> DataFrame:
    """One row per draw (draw_id, u): (draw_id, id, p, weight), with replacement, as `sampling.weighted_sample`.

    A draw takes the first slot at which the running sum of priorities reaches u
    times their total. Only the groups on the draws' way are read; their numbers,
    at most one for each draw, come to the driver.
    """
    depth, _ = _shape(spark, path)
    done = _rounds(spark, path)
    top = _read(spark, path, depth, [0], done)
    sums = _above(top).first()
    if sums is None or not sums["n"]:
        return spark.createDataFrame([], f"draw_id bigint, {id} bigint, p double, weight double")
    total, rows = max(TINY, sums["p"]), sums["n"]
    goal = F.col("u") * F.lit(total)
    # a goal beyond every sum falls back to the first slot
    walk = draws.select("draw_id", F.when(goal > F.lit(sums["p"]), F.lit(-1.0)).otherwise(goal).alias("goal"), F.lit(0).cast("bigint").alias("page"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("base"), F.lit(0).alias("i"), F.lit(-1).alias("kid"), F.lit(-1).alias("last"), F.lit(0.0).alias("last_base"))
    for level in range(depth, 0, -1):
        groups = [0] if level == depth else [r["g"] for r in walk.select(F.floor(F.col("page") / F.lit(PAGES)).alias("g")).distinct().collect()]
        pages = _read(spark, path, level, groups, done)

        def step(acc: Column, x: Column) -> Column:
            reached = (acc["kid"] < 0) & (x > 0) & (acc["sum"] + x >= F.col("goal"))
            return F.struct(
                (acc["sum"] + x).alias("sum"),
                F.when(reached, acc["sum"]).otherwise(acc["base"]).alias("base"),
                (acc["i"] + 1).alias("i"),
                F.when(reached, acc["i"]).otherwise(acc["kid"]).alias("kid"),
                F.when(x > 0, acc["i"]).otherwise(acc["last"]).alias("last"),
                F.when(x > 0, acc["sum"]).otherwise(acc["last_base"]).alias("last_base"),
            )

        found = walk.join(pages, "page").withColumn("f", F.aggregate("kids", start, step))
        # rounding can leave a goal above all children's sum: the last one takes it
        kid = F.when(F.col("f.kid") < 0, F.col("f.last")).otherwise(F.col("f.kid"))
        base = F.when(F.col("f.kid") < 0, F.col("f.last_base")).otherwise(F.col("f.base"))
        walk = stored(
            found.select("draw_id", (F.col("goal") - base).alias("goal"), (F.col("page") * FAN + kid).alias("page"), F.get("kids", kid).alias("p")), "walk"
        )
        walk = walk if level == 1 else walk.drop("p")
    share = F.lit(float(rows)) * (F.col("p") / F.lit(total))
    return walk.select("draw_id", F.col("page").alias(id), "p", F.pow(share, F.lit(-beta)).alias("weight"))
