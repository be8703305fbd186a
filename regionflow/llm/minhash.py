"""Document fingerprints: one-permutation MinHash with optimal densification, built-in columns only.

Each word shingle is hashed once. The top bits of a hash name its bin, and a bin
keeps its smallest hash. An empty bin takes the value of another one, found by a
probe sequence of its own that visits all bins in a fixed order and so is the
same for every document. Of each bin's value, hashed with
the bin, the low four bits are kept and packed, sixteen bins to a long. Two values agree by chance in one case of 16;
`likeness` corrects for that.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionflow.llm.common import col

SHINGLE, BINS, KEPT_BITS = 5, 256, 4
_BIN_SHIFT = 64 - (BINS.bit_length() - 1)
_LOW = (1 << _BIN_SHIFT) - 1
#: Probes that are tried one by one before the rest of the sequence is searched at once.
_QUICK_PROBES = 6


def _probe_rule(b: int) -> tuple[int, int]:
    """(step, start) of bin b's probe sequence start, start + step, ... modulo BINS; odd steps reach every bin."""
    mixed = (b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    mixed = (mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return (mixed >> 20) % BINS | 1, (mixed >> 40) % BINS


_RULES = [_probe_rule(b) for b in range(BINS)]


def _ints(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _bin(h: Column) -> Column:
    """The bin as its place among hashes in signed order."""
    return F.shiftrightunsigned(h, _BIN_SHIFT).cast("int").bitwiseXOR(F.lit(BINS // 2))


def with_fingerprint(df: DataFrame, text: Column, out: str, words: int = SHINGLE) -> DataFrame:
    """`df` with the fingerprint of a text: BINS * KEPT_BITS / 64 longs, or an empty array if it has no words.

    Words are runs of characters other than ASCII white space. A text of fewer
    than `words` words is one shingle. A null text has no words. Each step is a
    column of its own, so that nothing is computed twice.
    """
    w, s, x = f"{out}_words", f"{out}_hashes", f"{out}_bins"
    found = F.coalesce(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), F.array().cast("array<string>"))
    by_word = df.withColumn(w, F.transform(found, lambda v: F.xxhash64(v)))
    n = F.size(w)
    shingles = F.transform(
        F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)])
    )
    hashes = F.when(n >= words, shingles).when(n > 0, F.array(F.xxhash64(F.col(w)))).otherwise(F.array().cast("array<bigint>"))
    # one hash of all ones in its low bits for each bin, so that every bin has an entry and shows whether it is empty
    marks = _ints([(((b ^ BINS // 2) << _BIN_SHIFT | _LOW) + (1 << 63)) % (1 << 64) - (1 << 63) for b in range(BINS)])
    sorted_ = by_word.withColumn(s, F.sort_array(F.concat(hashes, marks)))
    least = F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1))))
    empty = lambda h: h.bitwiseAND(F.lit(_LOW)) == F.lit(_LOW)
    binned = sorted_.withColumn(x, F.transform(least, lambda h: F.when(~empty(h), h)))

    full = F.filter(F.transform(x, lambda v, b: F.struct(b.alias("b"), v.alias("v"))), lambda e: e["v"].isNotNull())
    probed = binned.withColumn(f"{x}_full", full)
    step_back = _ints([pow(a, -1, BINS) for a, _ in _RULES])
    start = _ints([c for _, c in _RULES])

    def search(b: Column) -> Column:
        """The value of the full bin that comes first in bin b's probe sequence."""
        at = lambda e: ((e["b"] - F.get(start, b) + BINS) * F.get(step_back, b)) % BINS
        return F.array_min(F.transform(f"{x}_full", lambda e: F.struct(at(e).alias("at"), e["v"].alias("v"))))["v"]

    quick = [_ints([(c + t * a) % BINS for a, c in _RULES]) for t in range(_QUICK_PROBES)]
    dense = F.transform(x, lambda v, b: F.coalesce(v, *[F.get(x, F.get(p, b)) for p in quick], search(b)))
    filled = F.when(F.size(f"{x}_full") == BINS, F.col(x)).otherwise(dense)
    # hashed with the bin, so that copies of one value do not all agree by one chance
    low = lambda v, b: F.xxhash64(v, b).bitwiseAND(F.lit((1 << KEPT_BITS) - 1))
    lowered = probed.withColumn(f"{x}_dense", filled).withColumn(f"{x}_low", F.transform(f"{x}_dense", low))
    per_long = 64 // KEPT_BITS
    join = lambda acc, v: F.shiftleft(acc, KEPT_BITS).bitwiseOR(v)
    # written out, as a column used in one lambda alone would be computed anew for each of its elements
    packed = F.array(
        *[F.aggregate(F.slice(f"{x}_low", i * per_long + 1, per_long), F.lit(0).cast("long"), join) for i in range(BINS // per_long)]
    )
    return lowered.withColumn(out, F.when(n > 0, packed).otherwise(F.array().cast("array<bigint>"))).drop(
        w, s, x, f"{x}_full", f"{x}_dense", f"{x}_low"
    )


def as_hex(fp: Column) -> Column:
    """One hexadecimal digit per bin; empty for a text without words."""
    return F.array_join(F.transform(fp, lambda v: F.lower(F.lpad(F.hex(v), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two texts' shingles, from their fingerprints.

    Two texts without words are alike (1), one without words is unlike any other (0).
    """

    def agreeing(x: Column, y: Column) -> Column:
        odd = x.bitwiseXOR(y)
        odd = odd.bitwiseOR(F.shiftrightunsigned(odd, 1))
        odd = odd.bitwiseOR(F.shiftrightunsigned(odd, 2)).bitwiseAND(F.lit(0x1111111111111111))
        return 64 // KEPT_BITS - F.bit_count(odd)

    agree = F.aggregate(F.zip_with(a, b, agreeing), F.lit(0), lambda acc, v: acc + v) / F.lit(float(BINS))
    chance = 1.0 / (1 << KEPT_BITS)
    corrected = F.greatest((agree - chance) / (1 - chance), F.lit(0.0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(corrected)


#: Rows of a stretch of ids, and the most stretches.
STRETCH, MOST_STRETCHES = 500, 4096


def _number(docs: DataFrame, doc_id: str) -> Column:
    """A whole number that never falls as the id grows: whole ids themselves, others rounded down, of texts the first
    bytes after those that all ids share."""
    kind = docs.schema[doc_id].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(doc_id).cast("long")
    if not isinstance(kind, T.StringType):
        return F.floor(F.col(doc_id).cast("double")).cast("long")
    ends = docs.agg(F.min(doc_id).alias("a"), F.max(doc_id).alias("b")).first()
    shared = len(os.path.commonprefix([(x or "").encode() for x in ends]))
    digits = F.rpad(F.substring(F.hex(F.encode(doc_id, "UTF-8")), 2 * shared + 1, 14), 14, "0")
    return F.conv(digits, 16, 10).cast("long")


def stretched(docs: DataFrame, doc_id: str = "doc_id", tie: str = "tie") -> DataFrame:
    """`docs` cut into `stretch`es of descending ids, each with a copy (`copied` = 1) of the row that begins the next one.

    Ids are cut at quantiles, rows without id by `tie`, so no task sorts more
    than a stretch. Cut points and first rows are at most MOST_STRETCHES each,
    whatever the data, and so may be broadcast.
    """
    number = _number(docs, doc_id)
    stats = docs.agg(F.count("*").alias("n"), F.count(doc_id).alias("known")).first()
    parts = max(1, min(MOST_STRETCHES, stats["known"] // STRETCH))
    cuts = []
    if parts > 1:
        quantiles = F.percentile_approx(number, [k / parts for k in range(1, parts)], 20 * parts)
        cuts = sorted(set(docs.agg(quantiles.alias("q")).first()["q"]))
    # rows without id are cut by their tie value
    spread = max(1, min(MOST_STRETCHES, (stats["n"] - stats["known"]) // STRETCH))
    among_null = F.floor((F.shiftright("tie_", 32) + (1 << 31)) * spread / float(1 << 32)) - spread
    passed = F.size(F.filter(_ints(cuts), lambda c: c <= number)) if cuts else F.lit(0)
    cut = docs.withColumn("tie_", F.col(tie)).withColumn(
        "stretch", F.when(F.col(doc_id).isNotNull(), passed).otherwise(among_null).cast("long")
    )
    first = cut.groupBy("stretch").agg(F.max(F.struct(F.col(doc_id).alias("d"), F.col("tie_").alias("t"))).alias("f"))
    order = Window.orderBy(F.desc("stretch"))
    before = F.coalesce(F.lag("stretch").over(order), F.min("stretch").over(Window.partitionBy()))
    firsts = F.broadcast(first.select(F.col("stretch").alias("s"), "f", before.alias("before")))
    copies = (
        cut.join(firsts, (F.col("stretch") == F.col("s")) & F.col(doc_id).eqNullSafe(F.col("f.d")) & (F.col("tie_") == F.col("f.t")))
        .withColumn("stretch", F.col("before"))
        .drop("s", "f", "before")
    )
    return cut.withColumn("copied", F.lit(0)).unionByName(copies.withColumn("copied", F.lit(1)))


def next_of(rows: DataFrame, keys: list[str], doc_id: str = "doc_id") -> DataFrame:
    """The rows of `stretched` with `next_<key>`: the columns of the next row by descending id; the first follows the last.

    Rows of equal id follow each other by tie, descending; rows without id come
    last. A row alone is its own next one.
    """
    along = Window.partitionBy("stretch").orderBy("copied", F.col(doc_id).desc_nulls_last(), F.desc("tie_"))
    return (
        rows.withColumns({f"next_{k}": F.lead(k).over(along) for k in keys})
        .filter("copied = 0")
        .drop("copied", "stretch", "tie_")
    )


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint) of every document.

    The edited text has the last third of its characters (rounded down) replaced
    by the first as many, or all, of the next document's. A null text counts as
    empty; equal ids follow each other by a hash of their texts.
    """
    rows = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    rows = stretched(rows.withColumn("tie", F.xxhash64("text")))
    joined = next_of(with_fingerprint(rows, F.col("text"), "fingerprint"), ["text", "fingerprint"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - third), F.left("next_text", third))
    drawn = joined.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    return with_fingerprint(drawn, F.col("edited"), "edited_fingerprint")
