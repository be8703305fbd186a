"""What the operators here share: stable row numbers and tables in the shared folder."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionflow.operators.skew import stored


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def keyed(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    """The rows packed into one struct `row`, a row number `rid` and the given columns.

    The table is written to the shared folder and read back, so `rid` stays the
    same however often it is read and whichever executor is lost. Packing the
    input keeps its column names apart from those used inside an operator.
    """
    packed = df.select(
        F.struct(*[col(c) for c in df.columns]).alias("row"),
        F.monotonically_increasing_id().alias("rid"),
        *[expression.alias(c) for c, expression in columns.items()],
    )
    return stored(packed, name)


def identified(df: DataFrame) -> DataFrame:
    """(row, same): the rows packed into one struct, and 128 bits that are equal for equal rows only.

    Unlike a row number it needs no table: it is the same whenever and wherever a
    row is read. Rows that it holds for equal agree in every column; maps are
    compared by their entries, whatever order these are in.
    """

    def hashed(f: T.StructField) -> Column:
        if not isinstance(f.dataType, T.MapType):
            return col(f.name)
        return F.to_json(F.struct(F.array_sort(F.map_entries(col(f.name))).alias("m")), {"ignoreNullFields": "false"})

    parts = [x for f in df.schema.fields for x in (col(f.name).isNull(), hashed(f))]  # hashes pass over nulls
    # one text, as parts of a struct may differ in whether they can be null, which would shuffle twice
    same = F.concat_ws("-", F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit("again"), *parts)))
    return df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), same.alias("same"))


#: Rows and bytes of whole texts that go to Python in one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python: bounds this session's Arrow batches by rows and, for long texts, by bytes.

    Settings that are smaller already stay. They are read when a plan is run, so they hold on.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Returns memory that a batch has left unused to the system: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def words_in(text: Column) -> Column:
    """How many runs of characters other than ASCII white space a text holds (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
