"""Importance resampling of documents towards a target distribution of hashed n-grams.

A feature is a run of one to three consecutive words, hashed by CRC-32. The words of
a document are read once, each behind one space, and the running CRC is stored at
every word's end. The CRC of any n-gram follows from two of these: the one before
its first word is carried on over as many zero bytes as the n-gram is long, a
linear map over GF(2), and cancels against the one after its last word.

A document's weight is the sum of its features' gains, the scaled log ratios of
their buckets' smoothed shares in the target texts and in all documents. Adding
Gumbel noise to the weights and taking the highest scores draws without
replacement, in proportion to the importance weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.llm.common import col
from regionflow.operators.skew import stored

ORDERS, BUCKETS, SEED, PERCENT, LEAST_WORDS = 3, 10_000, 42, 5, 20
#: Bytes of a text cut into words in one go, and words whose features are made in one go.
PIECE, STEP = 1 << 20, 1 << 17

_POLYNOMIAL = 0xEDB88320
_WORD_BYTE = [0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)]
#: A-Z in lower case, every byte of a separator a space; bytes above 0x7F only occur within words.
_NORMAL = bytes(b if _WORD_BYTE[b] else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256))


def _byte_table() -> np.ndarray:
    """The register after each byte, from an empty one."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_BYTES = _byte_table()


def _apply(tables: np.ndarray, registers: np.ndarray) -> np.ndarray:
    found = tables[0][registers & 255]
    for k in (1, 2, 3):
        found = found ^ tables[k][registers >> np.uint32(8 * k) & 255]
    return found


def _shifts(doublings: int = 40) -> np.ndarray:
    """(doublings, 4, 256): the linear map of 2^k zero bytes, by the four bytes of a register."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    images = _BYTES[bits & 255] ^ bits >> np.uint32(8)
    found = np.zeros((doublings, 4, 256), np.uint32)
    for k in range(doublings):
        for b in range(32):
            has = np.arange(256) >> b % 8 & 1 == 1
            found[k, b // 8, has] ^= images[b]
        images = _apply(found[k], images)
    return found


_SHIFTS = _shifts()


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC carried on over its number of zero bytes."""
    found, k = crcs.copy(), 0
    while len(lengths) and int(lengths.max()) >> k:
        at = np.flatnonzero(lengths >> k & 1)
        found[at] = _apply(_SHIFTS[k], found[at])
        k += 1
    return found


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a normalised text, in pieces of about PIECE bytes that end between words."""
    start = 0
    while start < len(data):
        end = start + PIECE
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


class _Reader:
    """Features of texts, made for about STEP words of one or many texts at a time."""

    def __init__(self, orders: int):
        self.orders = orders
        self._clear()

    def _clear(self) -> None:
        self.words: list[bytes] = []
        self.segments: list[tuple[int, int, int]] = []  # first word, owner, words that an earlier piece has counted

    def read(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(owner, words) and the CRCs of features: (owner of each word, owner of each feature, its CRC)."""
        for owner, text in enumerate(texts):
            if not text.is_valid:
                continue
            tail: list[bytes] = []
            for own in _words(text.as_py().encode("utf-8", "surrogatepass").translate(_NORMAL)):
                self.segments.append((len(self.words), owner, len(tail)))
                self.words += tail
                self.words += own
                tail = [*tail, *own][1 - self.orders :] if self.orders > 1 else []
                if len(self.words) >= STEP:
                    yield self._features()
                    self._clear()
        if self.words:
            yield self._features()
            self._clear()

    def _features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spaced = [b" " + w for w in self.words]
        after = np.fromiter(accumulate(spaced, lambda c, w: crc32(w, c), initial=0), np.uint32, len(spaced) + 1)
        register = ~after[:-1]  # the stored CRCs are inverted registers
        before = ~(_BYTES[(register ^ 32) & 255] ^ register >> np.uint32(8))
        ends = np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced)))
        starts = np.concatenate([[0], ends[:-1]]) + 1
        first, owner, known = (np.array(x) for x in zip(*self.segments, strict=True))
        sizes = np.diff(np.append(first, len(spaced)))
        of_word, begin = np.repeat(owner, sizes), np.repeat(first, sizes)
        fresh = np.repeat(first + known, sizes)
        place = np.arange(len(spaced))
        owners, crcs = [], []
        for n in range(1, self.orders + 1):
            last = np.flatnonzero((place - (n - 1) >= begin) & (place >= fresh))
            head = last - (n - 1)
            crcs.append(after[last + 1] ^ shifted(before[head], ends[last] - starts[head]))
            owners.append(of_word[last])
        return of_word[place >= fresh], np.concatenate(owners), np.concatenate(crcs)


def bucket_counts(texts: DataFrame, text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, reader = np.zeros(buckets, np.int64), _Reader(orders)
        for batch in batches:
            for _, _, crcs in reader.read(batch[0]):
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    counted = texts.select(col(text)).mapInArrow(count, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Every bucket's gain, from the bucket counts of all documents and of the target texts.

    At most one number a bucket and table is collected, whatever the data.
    """
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, table in ((documents, s), (target, t)):
        for bucket, n in counts.select("bucket", "n").collect():
            table[bucket] = n
    above, below = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([floor(1000 * log((y + 1.0) * above / ((x + 1.0) * below))) for x, y in zip(s.tolist(), t.tolist(), strict=True)])


def weigh(spark, gain: np.ndarray, text: Column, orders: int = ORDERS) -> Column:
    """struct(n_words, n_features, weight): a whole text's words, features and the sum of their gains (null: all 0)."""
    held = spark.sparkContext.broadcast(gain)  # one number a bucket

    @F.arrow_udf("n_words long, n_features long, weight long")
    def run(texts: pa.Array) -> pa.Array:
        found = np.zeros((3, len(texts)), np.int64)
        for words, owners, crcs in _Reader(orders).read(texts):
            found[0] += np.bincount(words, minlength=len(texts))
            found[1] += np.bincount(owners, minlength=len(texts))
            # sums below 2^53 are exact as doubles
            found[2] += np.bincount(owners, held.value[crcs % np.uint32(len(held.value))], len(texts)).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(x) for x in found], ["n_words", "n_features", "weight"])

    return run(text)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from SHA-256 of seed and id, rounded down; a null id counts as an empty one."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-F.log(-F.log((h + 0.5) / 4294967296.0)) * 1000.0)


def drawn_in_order(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """`scored` (id, n_words, score and more) with `rank`: the place by score among the documents drawn, else null.

    Drawn are floor(percent * N / 100) of the N documents of at least `least_words`
    words, those of the highest scores, ties to the smaller id (null last); rows
    equal in both take their places by their other columns. The order is
    made by a range shuffle of the scores alone: the number of a row within its
    range, and the summed sizes of the ranges before it, give its place.
    """
    apt = F.col("n_words") >= least_words
    names = [c for c in scored.columns if c not in ("score", "id")]
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), *[F.col(c) for c in names]]
    able = scored.filter(apt)
    parts = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = able.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    inside = F.lit((1 << 33) - 1)
    placed = placed.select("*", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(inside).alias("_place"))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a range
    along = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_range",
        F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_start"),
        F.floor(F.sum("_n").over(Window.partitionBy()) * percent / 100).alias("_most"),
    )
    rank = F.col("_start") + F.col("_place") + 1
    ranked = placed.join(starts, "_range").withColumn("rank", F.when(rank <= F.col("_most"), rank).cast("long"))
    rest = scored.filter(~apt).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*scored.columns, "rank").unionByName(rest)


def resample(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    orders: int = ORDERS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank), a row per row of `docs`.

    Words are runs of ASCII letters (A-Z in lower case), digits and all characters
    above 0x7F. A null or empty text has no features and weight 0; a null id is
    noise of its own and comes last among ties; repeated rows count each. Bucket
    counts cover all texts of both tables; an empty table leaves the smoothing.
    """
    spark = docs.sparkSession
    gain = gains(*(bucket_counts(rows, text, orders, buckets) for rows in (docs, target)), buckets)
    found = docs.select(col(doc_id).alias("id"), weigh(spark, gain, col(text), orders).alias("w")).select("id", "w.*")
    scored = found.withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    return drawn_in_order(stored(scored, "scores"), percent, least_words)
