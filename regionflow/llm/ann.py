"""Nearest neighbours by a forest of hash prefixes.

A vector has one hash string per tree: the sides of random planes it lies on.
A tree is the sorted array of its strings. A query descends to the longest
prefix it shares with any string of a tree, which is where its own string would
stand; then it ascends in all trees at once, one character at a time, until the
strings that share the prefix number enough candidates. Those are compared
exactly. The index is cut into shards of a fixed size at random, each with a
forest of its own, so that recall does not depend on the number of vectors; each
block of queries meets each shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionflow.llm.common import col
from regionflow.operators.skew import stored

#: Vectors of a shard, queries of a block, trees, characters of a string (bits).
SHARD, BLOCK, TREES, BITS = 8192, 2048, 128, 32
#: Strings under the common prefixes, as a share of the shard, at which a query stops ascending; in small shards at least so many.
ENOUGH, LEAST = 0.5, 4000
SEED = 7
_FOUND = "query_row long, query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, copies) of the vectors that take part: with an id, at least one component not 0, none null or not finite.

    Exact repeats of a row are one row here, with their number; they are
    found, and ask, as often as they occur. Different vectors with one id are rows
    of their own.
    """
    infinite = F.lit(float("inf"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)
    rows = vectors.select(col(vec_id).cast("long").alias("vec_id"), col(embedding).cast("array<double>").alias("v"))
    kept = rows.filter(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", sound)
        & F.exists("v", lambda x: x != 0)
    )
    return kept.groupBy("vec_id", "v").agg(F.count("*").alias("copies"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(-1, dim)


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors get equal values."""
    norm = lambda x: np.sqrt((x * x).sum(axis=-1))
    return (rows * query).sum(axis=-1) / (norm(rows) * norm(query))


class Forest:
    """The trees over one shard's vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.bits, self.trees = bits, trees
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * bits))
        strings = self.strings(vectors)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """(trees, vectors) hash strings as integers, the first character in the highest bit."""
        found = np.empty((self.trees, len(vectors)), np.uint64)
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        for t in range(self.trees):
            sides = vectors @ self.planes[:, t * self.bits : (t + 1) * self.bits] > 0
            found[t] = (sides * weights).sum(axis=1, dtype=np.uint64)
        return found

    def ranges(self, strings: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings that share `level` characters begin and end in each tree: (trees, queries) each."""
        rest = np.uint64(self.bits - level)
        low = strings >> rest << rest
        high = low + ((np.uint64(1) << rest) - np.uint64(1))
        begin = np.stack([np.searchsorted(s, x, "left") for s, x in zip(self.sorted, low, strict=True)])
        end = np.stack([np.searchsorted(s, x, "right") for s, x in zip(self.sorted, high, strict=True)])
        return begin, end

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query the positions of its candidates, from all trees."""
        strings = self.strings(queries)
        begin, end = self.ranges(strings, self.bits)
        waiting = (end - begin).sum(axis=0) < enough
        for level in range(self.bits - 1, -1, -1):
            if not waiting.any():
                break
            at = np.flatnonzero(waiting)
            begin[:, at], end[:, at] = self.ranges(strings[:, at], level)
            waiting[at] = (end[:, at] - begin[:, at]).sum(axis=0) < enough
        marked = np.zeros(self.order.shape[1], bool)
        for q in range(len(queries)):
            marked[:] = False
            for t in range(self.trees):
                marked[self.order[t, begin[t, q] : end[t, q]]] = True
            yield np.flatnonzero(marked)


def _search(queries: pa.Table, shard: pa.Table, k: int) -> pa.Table:
    found: dict[str, list] = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
    if queries.num_rows and shard.num_rows:
        dim = shard["dim"][0].as_py()
        vectors, asked = _matrix(shard["v"], dim), _matrix(queries["v"], dim)
        ids, own, rows = shard["vec_id"].to_numpy(), queries["vec_id"].to_numpy(), queries["query_row"].to_numpy()
        copies = np.minimum(shard["copies"].to_numpy(), k + 1)
        enough = max(LEAST, int(ENOUGH * len(vectors)))
        for q, near in enumerate(Forest(vectors).candidates(asked, enough)):
            itself = ids[near] == own[q]
            itself[itself] = (vectors[near[itself]] == asked[q]).all(axis=1)
            near = np.repeat(near, copies[near] - itself)  # a query's other copies are candidates
            scores = cosines(vectors[near], asked[q])
            best = np.lexsort((ids[near], -scores))[:k]
            found["query_row"] += [rows[q]] * len(best)
            found["query_id"] += [own[q]] * len(best)
            found["vec_id"] += ids[near][best].tolist()
            found["score"] += scores[best].tolist()
    types = {"score": pa.float64()}
    return pa.table({name: pa.array(values, types.get(name, pa.int64())) for name, values in found.items()})


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` vectors of largest cosine found for each query, ties to the smaller id.

    Both tables are those of `usable`. A query meets vectors of its own length, all
    rows but its own; queries that share an id have `k` rows each, copies of a
    query included. Fewer than `k` rows mean that there are no more.
    """
    vectors = stored(vectors, "vectors")
    queries = stored(queries.withColumn("query_row", F.monotonically_increasing_id()), "queries")
    n, asked = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked // BLOCK))
    part = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "v"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    keys = ["dim", "shard", "block"]
    index = vectors.select("vec_id", "v", "copies", F.size("v").alias("dim"), part(1, shards).alias("shard")).withColumn("block", every(blocks))
    wanted = queries.select("query_row", "vec_id", "v", F.size("v").alias("dim"), part(2, blocks).alias("block")).withColumn("shard", every(shards))
    found = (
        wanted.groupBy(*keys)
        .cogroup(index.groupBy(*keys))
        .applyInArrow(lambda left, right: _search(left, right, k), _FOUND)
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    repeated = queries.filter("copies > 1").select("query_row", "copies")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long"))))
    return ranked.join(repeated, "query_row", "left").select("query_id", "rank", "vec_id", "score", each.alias("copy")).drop("copy")
