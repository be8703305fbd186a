"""SimHash near-duplicates, linked through a generalised pigeonhole index.

Fingerprints that differ in at most `distance` bits agree closely in some group
of their bits: if the groups get thresholds t whose t + 1 sum to distance + 1,
then in one group at least the two differ in at most its t bits. Groups hold
bits that go together, and the thresholds, -1 (unused) included, are those of the
least estimated work, found by dynamic programming on statistics of all
fingerprints. They decide what is compared, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionflow.llm.common import give_back
from regionflow.llm.components import components
from regionflow.operators.skew import stored

BITS, SHINGLE, DISTANCE, SEED = 64, 4, 4, 42
#: Cost of comparing one candidate, in units of one probe row that is shuffled and sorted.
CANDIDATE_COST = 0.1
#: Highest threshold of a group: the masks of a probe are part of the plan, here at most 2,081 of them.
MOST_THRESHOLD = 2
#: Shingles voted on in one go.
STEP = 1 << 15


def simhash(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text as an unsigned integer; 0 for one without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    if len(found) <= words:
        spans = [(0, len(joined))]
    else:
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = list(zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True))
    votes = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(spans), STEP):
        part = spans[at : at + STEP]
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in part), "<u8", len(part))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(spans), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    found = np.fromiter((simhash(t.as_py()) for t in texts), np.uint64, len(texts))
    give_back()
    return pa.array(found.view(np.int64))


def fingerprint(text: Column) -> Column:
    """The SimHash of whole texts as a long (its 64 bits). A null text has fingerprint 0."""
    return _fingerprint(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often bits i <= j are set together, one row per pair of bits and task."""
    total = np.zeros((BITS, BITS))
    for batch in batches:
        fps = np.ascontiguousarray(batch[0].to_numpy(zero_copy_only=False).astype(np.int64))
        bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += bits.T @ bits
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "n": pa.array(total[i, j].astype(np.int64))})


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and the (BITS, BITS) counts of bits set together, over all of them."""
    n = fps.count()
    rows = fps.select("fp").mapInArrow(_pair_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    together = np.zeros((BITS, BITS))
    for i, j, count in rows.collect():  # one row per pair of bits, whatever the data
        together[i, j] = together[j, i] = count
    return n, together


def group_bits(n: int, together: np.ndarray, groups: int) -> list[list[int]]:
    """Bits in `groups` groups of even size, each grown around the bits it goes together with most."""
    share = together.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    related = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    free, found = set(range(BITS)), []
    for g in range(groups):
        size = BITS // groups + (g < BITS % groups)
        pick = lambda among: max(sorted(free), key=lambda b: round(float(related[b, sorted(among)].sum()), 9))  # noqa: B023, E731
        group = [pick(free)]
        free.discard(group[0])
        while len(group) < size:
            group.append(pick(group))
            free.discard(group[-1])
        found.append(sorted(group))
    return found


def _near_share(agree: np.ndarray, most: int) -> np.ndarray:
    """The estimated share of pairs that differ in at most 0..most of the bits that agree with these shares."""
    exactly = np.zeros(most + 1)
    exactly[0] = 1.0
    for a in agree:
        exactly[1:] = exactly[1:] * a + exactly[:-1] * (1 - a)
        exactly[0] *= a
    return exactly.cumsum()


def plan_probes(n: int, together: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the groups to probe, of the least estimated work."""
    n = max(n, 1)  # no fingerprints make no work, but then every plan would do
    share = together.diagonal() / n
    agree = share**2 + (1 - share) ** 2
    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    for m in range(1, distance + 2):
        groups = group_bits(n, together, m)
        # least work of the first groups for a sum of thresholds plus one each
        table: list[tuple[float, list[int]]] = [(0.0, [])] + [(np.inf, [])] * (distance + 1)
        for bits in groups:
            near = _near_share(agree[bits], distance)
            probes = np.cumsum([comb(len(bits), t) for t in range(distance + 1)])
            work = [0.0] + [n * probes[t] + CANDIDATE_COST * n * n / 2 * near[t] for t in range(distance + 1)]
            work = [w if k <= MOST_THRESHOLD + 1 else np.inf for k, w in enumerate(work)]
            table = [
                min(((table[s - k][0] + work[k], [*table[s - k][1], k - 1]) for k in range(s + 1)), key=lambda x: x[0])
                for s in range(distance + 2)
            ]
        cost, thresholds = table[-1]
        if cost < best[0]:
            best = cost, [(bits, t) for bits, t in zip(groups, thresholds, strict=True) if t >= 0]
    return best[1]


def _mask(bits) -> int:
    """The bits as a signed 64-bit mask."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def close_pairs(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints `fp` that differ in at most `distance` bits."""
    n, together = bit_statistics(fps)
    pairs = None
    for g, (bits, threshold) in enumerate(plan_probes(n, together, distance)):
        own = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        flips = [_mask(c) for t in range(threshold + 1) for c in combinations(bits, t)]
        index = fps.select(F.lit(g).alias("g"), own.alias("v"), F.col("fp").alias("b"))
        masks = F.explode(F.array(*[F.lit(m) for m in flips]))
        probes = fps.select(F.col("fp").alias("a"), own.alias("own"), masks.alias("flip")).select(
            F.lit(g).alias("g"), F.col("own").bitwiseXOR(F.col("flip")).alias("v"), "a"
        )
        both = (probes, index) if pairs is None else (pairs[0].unionByName(probes), pairs[1].unionByName(index))
        pairs = both
    if pairs is None:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    probes, index = pairs[0].alias("p"), pairs[1].alias("i")
    same = (F.col("p.g") == F.col("i.g")) & (F.col("p.v") == F.col("i.v")) & (F.col("a") < F.col("b")) & near
    return probes.join(index, same).select("a", "b")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """`docs` (doc_id, fp and more) with `root` and `component_id`.

    Documents with equal fingerprints, and all whose fingerprints are linked by
    steps of at most `distance` bits, form one component. `root` is its smallest
    fingerprint, `component_id` its smallest doc_id (null only if all are).
    Equal fingerprints are compared once, however many documents share them.
    """
    fps = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprints")
    roots = components(close_pairs(fps, distance))
    rooted = stored(
        fps.join(roots, fps["fp"] == roots["node"], "left").select(
            "fp", "least_id", F.coalesce("root", "fp").alias("root")
        ),
        "rooted",
    )
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = stored(rooted.select("fp", "root").join(named, "root"), "classes")
    return docs.join(classes, "fp")
