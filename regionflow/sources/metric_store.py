"""A metric log that grows by appends and reads as its latest values: merged on reading.

`append` adds a folder with rows sorted by (run, step) and an index with the least
and largest (run, step) of each file. `read_latest` opens only the files that can
hold what is asked, and the last write of a (run, step, key) wins: that of the
latest append, and of the largest seq within it. `compact` folds the appends so
far into one generation. One writer at a time; readers may go on meanwhile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.session import matching

_ROWS = "run string, step bigint, key string, value double, seq bigint, append bigint"
_INDEX = "file string, least struct<run:string,step:bigint>, most struct<run:string,step:bigint>, n bigint"


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The finished appends or generations: those whose index is written."""
    return sorted(int(f.split("/")[-3]) for f in matching(spark, f"{path}/{kind}/*/index/_SUCCESS"))


def _folders(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The number of the last append, and the folders that hold the log: the last generation and the appends after it."""
    appends, generations = (_numbers(spark, path, kind) for kind in ("appends", "generations"))
    covered = generations[-1] if generations else -1
    folders = [f"{path}/generations/{covered}"] if generations else []
    folders += [f"{path}/appends/{n}" for n in appends if n > covered]
    return max([covered, *appends]), folders


def _write(rows: DataFrame, folder: str, files: int) -> None:
    spark = rows.sparkSession
    place = F.struct("run", "step")
    sorted_rows = rows.repartitionByRange(files, "run", "step").sortWithinPartitions("run", "step")
    sorted_rows.write.mode("overwrite").parquet(f"{folder}/rows")
    back = spark.read.schema(_ROWS).parquet(f"{folder}/rows").select("run", "step", F.col("_metadata.file_path").alias("file"))
    index = back.groupBy("file").agg(F.min(place).alias("least"), F.max(place).alias("most"), F.count("*").alias("n"))
    index.coalesce(1).write.mode("overwrite").parquet(f"{folder}/index")  # last: it makes the folder count


def append(log: DataFrame, path: str, files: int = 4) -> int:
    """Appends (run, step, key, value, seq) rows; returns the append's number.

    An append that breaks off leaves no index and is written again by the next one.
    """
    spark = log.sparkSession
    number = _folders(spark, path)[0] + 1
    rows = log.select("run", F.col("step").cast("bigint").alias("step"), "key", F.col("value").cast("double").alias("value"), F.col("seq").cast("bigint").alias("seq"))
    _write(rows.withColumn("append", F.lit(number).cast("bigint")), f"{path}/appends/{number}", files)
    return number


def files_for(spark: SparkSession, path: str, run: str | None = None, first: int | None = None, last: int | None = None) -> list[str]:
    """The files that can hold rows of a run and of steps from `first` to `last`; all by default.

    Names of files come to the driver, as for any read; their rows do not.
    """
    _, folders = _folders(spark, path)
    if not folders:
        return []
    index = spark.read.schema(_INDEX).parquet(*[f"{f}/index" for f in folders])
    one_run = F.col("least.run").eqNullSafe(F.col("most.run"))
    if run is not None:
        low, high = (F.struct(F.lit(run).alias("run"), F.lit(x).cast("bigint").alias("step")) for x in (first, last))
        index = index.filter(F.col("most.run") >= run).filter(F.coalesce(F.col("least.run"), F.lit("")) <= run)
        index = index if first is None else index.filter(F.col("most") >= low)
        index = index if last is None else index.filter(F.col("least") <= high)
    else:  # steps of all runs: only a file of a single run tells them
        index = index if first is None else index.filter(~one_run | (F.col("most.step") >= first))
        index = index if last is None else index.filter(~one_run | (F.col("least.step") <= last))
    return sorted(r["file"] for r in index.select("file").collect())


def _latest(rows: DataFrame) -> DataFrame:
    """The last write of each (run, step, key)."""
    newest = F.max_by(F.struct("value", "seq", "append"), F.struct("append", "seq")).alias("_last")
    return rows.groupBy("run", "step", "key").agg(newest).select("run", "step", "key", "_last.*")


def read_latest(spark: SparkSession, path: str, run: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """(run, step, key, value, seq, append): the last write of every key, of one run or all, of some steps or all."""
    files = files_for(spark, path, run, first, last)
    rows = spark.read.schema(_ROWS).parquet(*files) if files else spark.createDataFrame([], _ROWS)
    for wanted, keep in ((run, F.col("run") == run), (first, F.col("step") >= F.lit(first)), (last, F.col("step") <= F.lit(last))):
        rows = rows if wanted is None else rows.filter(keep)
    return _latest(rows)


def compact(spark: SparkSession, path: str, files: int = 4) -> int:
    """Folds all appends so far into one generation of latest values; returns how many folders that were.

    Safe to repeat: with a single folder left nothing is written, and a generation without an
    index does not count.
    """
    number, folders = _folders(spark, path)
    if len(folders) > 1:
        rows = spark.read.schema(_ROWS).parquet(*[f"{f}/rows" for f in folders])
        _write(_latest(rows).select("run", "step", "key", "value", "seq", "append"), f"{path}/generations/{number}", files)
        return len(folders)
    return 0
