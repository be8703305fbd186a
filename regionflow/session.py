"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(
    app_name: str = "regionflow",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings every operator here expects.

    On a cluster leave `master` and `shuffle_partitions` unset, so that the
    submitter's values hold.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # call-site capture costs several JVM round trips per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    Only a local-mode session without the setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its machine, so that is
    an error.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_KEY, None
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="regionflow-")
    spark.conf.set(CHECKPOINT_KEY, path)
    return path


_FOLDERS: dict[str, tuple[SparkSession, str]] = {}


def working_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it is deleted when the program ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = spark, os.path.join(shared_dir(spark), f"regionflow-{uuid.uuid4().hex}")
        atexit.register(release, spark, app)
    return _FOLDERS[app][1]


def release(spark: SparkSession, app: str | None = None) -> None:
    """Deletes what this application wrote to the shared folder; tables read from it are gone then."""
    _, folder = _FOLDERS.pop(app or spark.sparkContext.applicationId, (None, None))
    if folder is not None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        except Exception as error:  # noqa: BLE001 - the JVM may be gone already
            print(f"{folder} could not be deleted: {type(error).__name__}", file=sys.stderr)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return os.path.join(working_folder(spark), f"{name}-{uuid.uuid4().hex}")


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern with `*` stands for, in order, on whatever store it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or ())
