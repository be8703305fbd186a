"""Tables compared by digests: only what differs is compared row by row.

A row's digest is 128 bits of hash over all its columns. Rows are dealt to the
leaves of a small tree by their hash, and a node's digest is the sum of its rows'
digests, in four lanes of 32 bits, so it does not depend on order. Equal tables
shuffle nothing but digests, at most FAN ** DEPTH rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionflow.operators.quality import row_differences
from regionflow.operators.skew import stored

#: Children of a node, and levels below the root.
FAN, DEPTH = 16, 4
_LANES = ("d0", "d1", "d2", "d3")


def _parts(df: DataFrame) -> list[Column]:
    """Every column and whether it is null; nested ones as JSON, as hashes pass over nulls inside them too."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    found = []
    for f in df.schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, T.MapType):
            c = F.array_sort(F.map_entries(c))
        if isinstance(f.dataType, nested):
            c = F.to_json(F.struct(c.alias("c")), {"ignoreNullFields": "false"})
        found += [c.isNull(), c]
    return found


def _leaf(df: DataFrame) -> Column:
    return F.pmod(F.xxhash64(*_parts(df)), F.lit(FAN**DEPTH)).cast("int")


def digest_tree(df: DataFrame) -> DataFrame:
    """(level, node, n, d0 to d3): the digest of every node that holds rows; level 0 is the root, DEPTH the leaves."""
    parts = _parts(df)
    halves = [(F.xxhash64(*parts), "a"), (F.xxhash64(F.lit("again"), *parts), "b")]
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda h: F.shiftrightunsigned(h, 32)
    lanes = [half(h).alias(name) for name, (half, (h, _)) in zip(_LANES, [(f, h) for h in halves for f in (low, high)], strict=True)]
    sums = [F.sum(lane).alias(lane) for lane in _LANES]
    leaves = df.select(_leaf(df).alias("leaf"), *lanes).groupBy("leaf").agg(F.count("*").alias("n"), *sums)
    level = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level")
    above = F.floor(F.col("leaf") / F.pow(F.lit(float(FAN)), F.lit(DEPTH) - F.col("level"))).cast("int")
    return leaves.select("*", level).groupBy("level", above.alias("node")).agg(F.sum("n").alias("n"), *sums)


def differing_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """(leaf) of the leaves whose digests differ between two trees, found from the root down.

    A level is met only below the nodes that differ on the one above it.
    """
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1)))
    summed = both.groupBy("level", "node").agg(*[F.sum(F.col(c) * F.col("side")).alias(c) for c in ("n", *_LANES)])
    odd = stored(summed.filter(" OR ".join(f"{c} <> 0" for c in ("n", *_LANES))), "odd-nodes")
    found = odd.filter("level = 0").select("node")
    for level in range(1, DEPTH + 1):
        if found.isEmpty():
            break
        below = odd.filter(F.col("level") == level).withColumn("above", F.floor(F.col("node") / FAN).cast("int"))
        found = below.join(found.withColumnRenamed("node", "above"), "above", "left_semi").select("node")
    return found.withColumnRenamed("node", "leaf")


def differences(a: DataFrame, b: DataFrame, tree_a: DataFrame | None = None, tree_b: DataFrame | None = None) -> DataFrame:
    """`quality.row_differences` of two tables of equal columns: rows with their `surplus` in `a`.

    Only rows of leaves that differ are shuffled. Trees made before may be given,
    so that a stored table need not be read again while it is equal.
    """
    b = b.select(*["`" + c.replace("`", "``") + "`" for c in a.columns])
    trees = [stored(digest_tree(t), "digests") if tree is None else tree for t, tree in ((a, tree_a), (b, tree_b))]
    leaves = stored(differing_leaves(*trees), "odd-leaves")

    def rows(t: DataFrame) -> DataFrame:
        # at most FAN ** DEPTH leaves, whatever the tables
        return t.withColumn("_leaf", _leaf(t)).join(F.broadcast(leaves), F.col("_leaf") == F.col("leaf"), "left_semi").drop("_leaf")

    return row_differences(rows(a), rows(b))
