"""Results that change, kept as versions in append-only files, and their compaction.

A stream in append mode writes a new version of each key that a batch touches; the
native file sink writes each batch once, replays included. Readers take the newest
version of each key. `compact` folds the files so far into one generation beside
them, `newest` reads the last generation and the files after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionflow.session import matching


def _generations(spark: SparkSession, path: str) -> list[int]:
    """The finished generations beside a folder of versions: those whose list of files is written."""
    return sorted(int(f.split("/")[-3]) for f in matching(spark, f"{path}-generations/*/files/_SUCCESS"))


def _parts(spark: SparkSession, path: str, schema: T.StructType) -> tuple[int, DataFrame | None, list[str], list[str]]:
    """The number of the last generation, its rows, the files that it covers and the files after it."""
    done = _generations(spark, path)
    last = done[-1] if done else -1
    rows, covered = None, []
    if done:
        folder = f"{path}-generations/{last}"
        rows = spark.read.schema(schema).parquet(f"{folder}/rows")
        covered = [r["file"] for r in spark.read.schema("file string").parquet(f"{folder}/files").collect()]
    known = set(covered)
    # the sink's log says which files count; their names are few beside their rows
    fresh = [f for f in spark.read.schema(schema).parquet(path).inputFiles() if f not in known]
    return last, rows, covered, fresh


def _newest(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.col(version)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*[c if c in keys else F.col("_best")[c].alias(c) for c in rows.columns])


def _all(spark: SparkSession, rows: DataFrame | None, fresh: list[str], schema: T.StructType) -> DataFrame:
    after = spark.read.schema(schema).parquet(*fresh) if fresh else spark.createDataFrame([], schema)
    return after if rows is None else rows.unionByName(after)


def newest(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], version: str = "version") -> DataFrame:
    """The newest version of each key: from the last generation and the files that it does not cover."""
    _, rows, _, fresh = _parts(spark, path, schema)
    return _newest(_all(spark, rows, fresh, schema), keys, version)


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], version: str = "version") -> int:
    """Folds the files since the last generation into a new one; returns how many files that were.

    Safe to repeat: without new files nothing is written, and a run that breaks off
    leaves no list of files, so the next one writes the same generation again. The
    stream may go on meanwhile; files that it adds are read beside the generation.
    """
    last, rows, covered, fresh = _parts(spark, path, schema)
    if not fresh:
        return 0
    folder = f"{path}-generations/{last + 1}"
    _newest(_all(spark, rows, fresh, schema), keys, version).write.mode("overwrite").parquet(f"{folder}/rows")
    names = spark.createDataFrame([(f,) for f in [*covered, *fresh]], "file string")
    names.coalesce(1).write.mode("overwrite").parquet(f"{folder}/files")  # last: it makes the generation count
    return len(fresh)
