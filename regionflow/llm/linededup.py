"""Removes repeated passages of lines, found by overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionflow.llm.common import col, keyed
from regionflow.operators.skew import stored


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """A row per run of `window` lines: its place and its 128-bit hash. Runs of blank lines are left out."""
    lines = lambda i: [F.get("lines", i + k) for k in range(window)]
    starts = F.when(F.size("lines") >= window, F.sequence(F.lit(0), F.size("lines") - window))
    hashed = F.transform(
        starts,
        lambda i: F.struct(
            F.xxhash64(*lines(i)).alias("h1"),
            F.xxhash64(F.lit(window), *lines(i)).alias("h2"),
            F.concat(*lines(i)).rlike(r"[^\x20\x09-\x0D]").alias("said"),
        ),
    )
    return (
        rows.select(F.col("id").isNull().alias("no_id"), "id", "own", "rid", F.posexplode(hashed).alias("pos", "w"))
        .filter("w.said")
        .select("no_id", "id", "own", "rid", "pos", "w.h1", "w.h2")
    )


def remove_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 3) -> DataFrame:
    """The rows of `docs` as `row`, with `kept` (the text that is left), `n_lines`, `n_removed`.

    Lines end at line feeds. Every run of `window` consecutive lines is hashed
    (128 bits); of equal runs with any text in them, wherever they stand, the
    first in the order (doc_id, hash of the text, line) stays and every other one
    marks its lines, so that it does not matter how the rows are stored. Marked lines go; overlapping marks are merged. A null id comes last;
    repeated rows count as copies, so one of them stays whole. A null text stays
    null with 0 lines; a text of fewer lines than `window` is kept as it is.
    """
    rows = keyed(docs, "lines", id=col(doc_id))
    lines = F.split(F.col("row")[text], "\n", -1)
    own = F.conv(F.substring(F.md5(F.col("row")[text]), 1, 15), 16, 10).cast("long").alias("own")
    windows = _windows(rows.select("rid", "id", own, lines.alias("lines")), window)
    place = F.struct("no_id", "id", "own", "rid", "pos")
    first = stored(
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("h1", "h2", F.col("first.rid").alias("first_rid"), F.col("first.pos").alias("first_pos")),
        "first-windows",
    )
    marks = (
        windows.join(first, ["h1", "h2"])
        .filter((F.col("rid") != F.col("first_rid")) | (F.col("pos") != F.col("first_pos")))
        .groupBy("rid")
        .agg(F.collect_set("pos").alias("marks"))
    )
    covered = F.flatten(F.transform("marks", lambda p: F.sequence(p, p + (window - 1))))
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered), lambda i: F.get("lines", i)
    )
    # the lines are cut again after the join, which so moves each text once
    merged = rows.join(marks, "rid", "left").withColumn("lines", lines).withColumn("left", F.when(F.col("marks").isNull(), F.col("lines")).otherwise(kept))
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    return merged.select(
        "row",
        F.array_join("left", "\n").alias("kept"),
        n_lines.alias("n_lines"),
        F.coalesce(n_lines - F.when(F.col("left").isNotNull(), F.size("left")), F.lit(0)).cast("long").alias("n_removed"),
    )
