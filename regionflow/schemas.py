"""Struct types of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

STATE_FIELDS = ["s", "i", "r", "d", "v", "hosp_cap", "t", "t_max", "seed"]

STATE = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in STATE_FIELDS[:6]]
    + [T.StructField(name, T.IntegerType()) for name in STATE_FIELDS[6:]]
)

TRANSITION = T.StructType(
    [
        T.StructField("s", STATE),
        T.StructField("a", T.IntegerType()),
        T.StructField("r", T.DoubleType()),
        T.StructField("s2", STATE),
        T.StructField("done", T.BooleanType()),
    ]
)

SERIES = "entity STRING, t INT, value DOUBLE"
TARGETS = "entity STRING, t_arrive DOUBLE, peak DOUBLE"
EDGES = "src STRING, dst STRING, w DOUBLE"
SURFACE = "beta DOUBLE, travel DOUBLE, loss DOUBLE"
SNAPSHOT = "country STRING, t INT, i DOUBLE, arrival INT, peak DOUBLE, loss DOUBLE"


def parse(schema: str | T.StructType) -> T.StructType:
    """A struct type from a DDL string, or the type itself."""
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
