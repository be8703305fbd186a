"""Groups the spelling variants of a corpus's words by single edits.

Two words are near if one inserted, deleted or replaced character turns one into
the other. The vectors of their letter counts then lie at a squared distance of 1
(lengths next to each other) or 2 (equal lengths). A block holds the words that can
be so near: letters fall into a few classes, and a word stands in the block of its
class counts less one letter, for each class that it has, and in the block of its
own counts, to meet words longer by one. Near words share exactly one block. In a
block the squared distances come from the Gram matrix of the letter counts, one
NumPy product for each stretch of rows; pairs at most two apart whose lengths
are equal or next to each other are compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow.llm.common import col
from regionflow.operators.skew import stored

RUN, LEAST_LETTERS, LEAST_COUNT, RATIO, DAMAGED = "A-Za-zÀ-ÿ", 7, 2, 10, 31
CLASSES = 13
#: Words of a block beyond which it is cut into parts that meet pair by pair.
MOST_IN_BLOCK = 4096
#: Rows of a Gram product, and rows that they meet in one go.
ROWS, ACROSS = 256, 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A number for each class of letters; a block's key is the sum over a word's letters, wrapped to 64 bits.
_CLASS_KEYS = np.random.default_rng(11).integers(-(1 << 63), (1 << 63) - 1, CLASSES, np.int64)
_OWN = -1
_ROWS = "key long, gone int, word string, n long"


def corpus_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word): a row for every run of letters that can still have LEAST_LETTERS, A-Z in lower case.

    Where DAMAGED divides the CRC-32 of `<doc_id>:<run>`, the run loses the character
    at that number modulo its length. A null id counts as an empty one, a null
    text has no runs; repeated rows count each.
    """
    found = F.regexp_extract_all(col(text), F.lit(f"[{RUN}]{{{LEAST_LETTERS},}}"), F.lit(0))
    runs = docs.select(F.coalesce(col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    low = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"), F.char_length("run").alias("len"))
    at = F.pmod("h", "len").cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.col("len")))
    return hashed.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least `letters` characters that occur at least `least` times."""
    counts = words.filter(F.char_length("word") >= letters).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least)


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all words, and where each word starts and how long it is."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return codes, np.cumsum(lengths) - lengths, lengths


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) to a row for each block that the word stands in; `gone`: the class it is less a letter of."""
    for batch in batches:
        codes, starts, lengths = _flat(batch["word"].to_pylist())
        owner = np.repeat(np.arange(len(lengths)), lengths)
        has = np.bincount(owner * CLASSES + codes % CLASSES, minlength=len(lengths) * CLASSES).reshape(-1, CLASSES)
        own = (has * _CLASS_KEYS).sum(axis=1, dtype=np.int64)
        at, gone = np.nonzero(has)
        at, gone = np.concatenate([np.arange(len(lengths)), at]), np.concatenate([np.full(len(lengths), _OWN), gone])
        less = np.append(_CLASS_KEYS, 0)  # the last one is that of _OWN
        for s in range(0, len(at), 1 << 16):
            part = at[s : s + (1 << 16)]
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array(own[part] - less[gone[s : s + (1 << 16)]]),
                    "gone": pa.array(gone[s : s + (1 << 16)], pa.int32()),
                    "word": batch["word"].take(pa.array(part)).cast(pa.string()),
                    "n": batch["n"].take(pa.array(part)),
                }
            )


def _split(rows: DataFrame, most: int) -> DataFrame:
    """Block rows with their part and the pair of parts (low, high) they go to; blocks of up to `most` rows are one part."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > most)
    parts = stored(sizes.select("key", F.ceil(F.col("size") / most).cast("int").alias("parts")), "large-blocks")
    one = F.lit(0)
    if parts.isEmpty():
        return rows.withColumns({"part": one, "low": one, "high": one})
    cut = rows.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    met = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumns({"low": F.least("part", "with"), "high": F.greatest("part", "with")}).drop("with", "parts")


def _met(table: pa.Table) -> pa.Table:
    """The near pairs of whole blocks in a row, each in both directions: (word, other, other_n)."""
    where = np.stack([table[c].to_numpy() for c in ("key", "low", "high")])
    new = np.append(True, (where[:, 1:] != where[:, :-1]).any(axis=0))
    group = np.cumsum(new) - 1
    alone = np.bincount(group)[group] == 1
    table, group = table.filter(pa.array(~alone)), group[~alone]
    gone, part, n = (table[c].to_numpy() for c in ("gone", "part", "n"))
    cross = table["low"].to_numpy() != table["high"].to_numpy()
    codes, starts, lengths = _flat(table["word"].to_pylist())
    letters, column = np.unique(codes, return_inverse=True)
    owner, d = np.repeat(np.arange(len(lengths)), lengths), max(1, len(letters))
    exact = np.float32 if not len(lengths) or lengths.max() < 2000 else np.float64
    counts = np.bincount(owner * d + column, minlength=len(lengths) * d).reshape(-1, d).astype(exact)
    norms = (counts * counts).sum(axis=1)
    ends = np.searchsorted(group, group, "right")
    left, right = [], []
    for i in range(0, len(group), ROWS):
        rows = slice(i, min(i + ROWS, len(group)))
        for j in range(i, ends[rows.stop - 1], ACROSS):
            other = slice(j, min(j + ACROSS, ends[rows.stop - 1]))
            square = counts[rows] @ counts[other].T
            square *= -2
            square += norms[rows, None]
            square += norms[None, other]
            a, b = np.nonzero(square <= 2)
            a, b = a + i, b + j
            fits = (a < b) & (group[a] == group[b]) & (~cross[a] | (part[a] != part[b]))
            a, b = a[fits], b[fits]
            longer = lengths[a] - lengths[b]
            replaced = (longer == 0) & (gone[a] != _OWN) & (gone[b] != _OWN)
            put_in = (longer == 1) & (gone[a] != _OWN) & (gone[b] == _OWN)
            taken_out = (longer == -1) & (gone[a] == _OWN) & (gone[b] != _OWN)
            x, y = a[replaced], b[replaced]
            fine = _one_replaced(codes, starts, lengths, x, y, gone)
            left.append(x[fine])
            right.append(y[fine])
            x, y = np.concatenate([a[put_in], b[taken_out]]), np.concatenate([b[put_in], a[taken_out]])
            fine = _one_more(codes, starts, lengths, x, y)
            left.append(x[fine])
            right.append(y[fine])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    a, b = pa.array(np.concatenate([a, b])), np.concatenate([b, a])
    return pa.table({"word": table["word"].take(a), "other": table["word"].take(pa.array(b)), "other_n": pa.array(n[b], pa.int64())})


def _along(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces of a flat array: where each piece begins in their sequence, the places within pieces, the flat places."""
    begin = np.cumsum(lengths) - lengths
    inside = np.arange(lengths.sum()) - np.repeat(begin, lengths)
    return begin, inside, np.repeat(starts, lengths) + inside


def _one_replaced(codes, starts, lengths, a, b, gone) -> np.ndarray:
    """Whether words of equal length differ in one letter, those of the classes that their block lacks."""
    if not len(a):
        return np.zeros(0, bool)
    begin, inside, at = _along(starts[a], lengths[a])
    beside = np.repeat(starts[b], lengths[a]) + inside
    differ = codes[at] != codes[beside]
    one = np.add.reduceat(differ, begin, dtype=np.int64) == 1
    where = np.flatnonzero(differ & np.repeat(one, lengths[a]))
    own = np.flatnonzero(one)
    one[own] = (codes[at[where]] % CLASSES == gone[a[own]]) & (codes[beside[where]] % CLASSES == gone[b[own]])
    return one


def _one_more(codes, starts, lengths, a, b) -> np.ndarray:
    """Whether word a is word b with one letter put in."""
    if not len(a):
        return np.zeros(0, bool)
    begin, inside, at = _along(starts[b], lengths[b])
    beside = np.repeat(starts[a], lengths[b]) + inside
    first = np.minimum.reduceat(np.where(codes[at] != codes[beside], inside, np.iinfo(np.int64).max), begin)
    last = np.maximum.reduceat(np.where(codes[at] != codes[beside + 1], inside, -1), begin)
    return last < first


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted block rows to near pairs; a block that a batch cuts waits for its rest."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        where = np.stack([batch[c].to_numpy() for c in ("key", "low", "high")])
        last = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if not cut and waiting and (where[:, 0] != np.array([waiting[-1][c][-1].as_py() for c in ("key", "low", "high")])).any():
            yield from _met(pa.Table.from_batches(waiting)).to_batches()
            waiting = []
        if cut:
            yield from _met(pa.Table.from_batches([*waiting, batch.slice(0, cut)])).to_batches()
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield from _met(pa.Table.from_batches(waiting)).to_batches()


def near_words(words: DataFrame, most_in_block: int = MOST_IN_BLOCK) -> DataFrame:
    """(word, other, other_n): every pair of `words` (word, n; each word once, not empty) one edit apart, in both directions."""
    rows = words.select("word", "n").mapInArrow(_blocks, _ROWS)
    place = ["key", "low", "high"]
    sent = _split(rows, most_in_block).repartition(*place).sortWithinPartitions(*place)
    return sent.mapInArrow(_pairs, "word string, other string, other_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word that the forms lead to. A form's n grows tenfold, so chains are short."""
    found = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = found.join(onward, "root", "left")
        if moved.filter("onward IS NOT NULL").isEmpty():
            return found
        found = stored(moved.select("word", F.coalesce("onward", "root").alias("root")), "roots")


def variants(words: DataFrame, ratio: int = RATIO, most_in_block: int = MOST_IN_BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for `words` (word, n), each word once.

    `n_near` counts the words one edit away. Of these the one of the largest n, ties
    to the first in code-point order, is the word's `form` if its n is at least
    `ratio` times the word's own; `root` is the last word that forms lead to, or
    the word itself. No words give no rows; null and empty words are left out.
    """
    words = stored(words.filter("word <> ''").select("word", "n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = near_words(words, most_in_block).groupBy("word").agg(F.count("*").alias("n_near"), best)
    fits = -F.col("best.less") >= F.col("n") * ratio
    found = stored(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(fits, F.col("best.other")).alias("form"),
            F.when(fits, -F.col("best.less")).alias("form_n"),
        ),
        "near-words",
    )
    roots = _roots(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
