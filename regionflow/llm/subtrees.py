"""Removes passages that earlier documents hold, by prefix-partitioned suffix trees over words.

Every window of words has an anchor: the run of GRAM words in it with the least
hash. Suffixes start at anchors, about one in eighteen places, and windows with
equal words have equal anchors at equal offsets. Prefixes split the suffixes into
groups that fit in memory: GRAM words, or, where more suffixes share these than a
subtree may hold, all words around an anchor, and then all words of a window; such
a group is a single node. A prefix in one document alone ends there. The suffixes of
the other groups travel with
the words before them, and a subtree is built over them as a sorted list with the
lengths of common prefixes: a run of suffixes that share `d` words is the node of
depth d. The nodes deep enough for a window, met with those of the words before,
are the repeats; the least document below each stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from regionflow.llm.common import col
from regionflow.operators.skew import stored

WINDOW, GRAM = 50, 16
#: Suffixes of one prefix that a subtree takes; suffixes whose subtrees are built at a time.
MOST_IN_SUBTREE, AT_ONCE = 4096, 8192

_ANCHORS = "array<struct<prefix:long,pos:int,first:int,last:int>>"
_ROLL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end."""
    codes = np.frombuffer(data, np.uint8)
    space = np.ones(len(codes) + 2, np.int8)
    space[1:-1] = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edge = np.diff(space)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _anchors(data: bytes, window: int, gram: int) -> np.ndarray:
    """Rows (prefix hash, place, first window, last window) of the anchors; every window start is in one row's range."""
    starts, ends = _places(data)
    if len(starts) < window:
        return np.zeros((4, 0), np.int64)
    spans = zip(starts.tolist(), ends.tolist(), strict=True)
    words = np.fromiter((xxh3_64_intdigest(data[a:b]) for a, b in spans), np.uint64, len(starts))
    runs = words[: len(words) - gram + 1].copy()
    for k in range(1, gram):
        runs *= _ROLL
        runs += words[k : len(words) - gram + 1 + k]
    runs ^= runs >> np.uint64(32)
    runs *= _MIX
    runs ^= runs >> np.uint64(32)
    least = np.lib.stride_tricks.sliding_window_view(runs, window - gram + 1).argmin(axis=1)
    at = least + np.arange(len(least))
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(at)) - 1
    return np.stack([runs[at[first]].view(np.int64), at[first], first, last])


def _scan(window: int, gram: int):
    @F.arrow_udf(_ANCHORS)
    def run(texts: pa.Array) -> pa.Array:
        found = [_anchors(t.as_py().encode("utf-8", "surrogatepass"), window, gram) for t in texts]
        offsets = np.cumsum([0, *(x.shape[1] for x in found)])
        flat = np.concatenate([*found, np.zeros((4, 0), np.int64)], axis=1)
        parts = [pa.array(flat[0]), *(pa.array(x, pa.int32()) for x in flat[1:])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, ["prefix", "pos", "first", "last"]))

    return run


def _suffix_type(id_type: T.DataType) -> T.StructType:
    """`firsts`: the first windows of equal suffixes of a text; `before`: words before the suffix; `windows`: how many there are."""
    kind = T.StructType().add("whole", T.BooleanType()).add("k1", T.LongType()).add("k2", T.LongType()).add("id", id_type)
    kind = kind.add("h1", T.LongType()).add("h2", T.LongType()).add("firsts", T.ArrayType(T.IntegerType()))
    return kind.add("before", T.IntegerType()).add("windows", T.IntegerType()).add("words", T.BinaryType())


_NAMES = ["whole", "k1", "k2", "id", "h1", "h2", "firsts", "before", "windows", "words"]


def _batches(batch: pa.RecordBatch, i: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Suffix rows (whole, k1, k2, firsts, before, windows, words) of a batch's row i."""
    for s in range(0, len(rows), 4096):
        whole, k1, k2, firsts, before, windows, words = zip(*rows[s : s + 4096], strict=True)
        same = [batch[c].take(pa.array([i] * len(whole))) for c in ("id", "h1", "h2")]
        columns = [pa.array(whole), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), *same, pa.array(firsts, pa.list_(pa.int32()))]
        columns += [pa.array(before, pa.int32()), pa.array(windows, pa.int32()), pa.array(words, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _hash(words: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(xxh3_128_digest(words), np.int64).tolist())


def _suffixes(window: int):
    """Texts with their anchors and the wanted prefixes to suffix rows, each with the words of all its windows.

    Suffixes of a prefix that too many share get the hash of these words for a key,
    and those of one text with equal words are one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch["text"][i].as_py().encode("utf-8", "surrogatepass")
                starts, ends = (x.tolist() for x in _places(data))
                wanted = {w["prefix"]: w["whole"] for w in batch["wanted"][i].as_py()}
                rows: list[tuple] = []
                equal: dict[tuple, list[int]] = {}
                for a in batch["anchors"][i].as_py():
                    whole = wanted.get(a["prefix"])
                    if whole is None:
                        continue
                    words = data[starts[a["first"]] : ends[a["last"] + window - 1]]
                    size = a["pos"] - a["first"], a["last"] - a["first"] + 1
                    if whole:
                        equal.setdefault((*size, b" ".join(words.split())), []).append(a["first"])
                    else:
                        rows.append((False, a["prefix"], 0, [a["first"]], *size, words))
                rows += [(True, *_hash(words), firsts, *size, words) for (*size, words), firsts in equal.items()]
                yield from _batches(batch, i, rows)

    return run


def _windows(window: int):
    """Suffix rows to one for each of their windows, by the hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, firsts = batch["words"][i].as_py().split(), batch["firsts"][i].as_py()
                rows = []
                for k in range(batch["windows"][i].as_py()):
                    rows.append((True, *_hash(b" ".join(words[k : k + window])), [f + k for f in firsts], 0, 1, None))
                yield from _batches(batch, i, rows)

    return run


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of word numbers, and how many words each has in common with the one before it."""
    order = np.lexsort(rows.T[::-1])
    differ = rows[order[1:]] != rows[order[:-1]]
    return order, np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def _nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """The node of the given depth above each suffix."""
    found = np.empty(len(order), np.int64)
    found[order] = np.append(0, np.cumsum(common < depth))
    return found


def _repeats(table: pa.Table, window: int, gram: int) -> pa.Table:
    """(h1, h2, firsts, n): `n` words from `firsts` on that a smaller document holds too, for whole groups of suffixes."""
    numbers: dict[bytes, int] = {}
    texts = [w.as_py().split() for w in table["words"]]
    flat = np.array([numbers.setdefault(w, len(numbers) + 1) for t in texts for w in t], np.int32)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    first = np.array([x[0].as_py() for x in table["firsts"]])  # suffixes of short prefixes are not folded
    before, windows = (table[c].to_numpy().astype(np.int64) for c in ("before", "windows"))
    reach = np.arange(window)
    at = before[:, None] + reach
    after = np.where(at < sizes[:, None], flat[np.minimum(begin[:, None] + at, len(flat) - 1)], 0)
    at = before[:, None] - 1 - reach[: window - gram]
    ahead = np.where(at >= 0, flat[begin[:, None] + np.maximum(at, 0)], 0)
    tree, back = _sorted(after), _sorted(ahead)
    ranks = pc.rank(table["id"].combine_chunks(), sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    marked = np.zeros((len(texts), window - gram + 3), bool)  # by window start, from `first`, with an empty edge
    for offset in range(window - gram + 1):
        has = np.flatnonzero((offset <= before) & (offset > before - windows))
        if not len(has):
            continue
        node = _nodes(*tree, window - offset)[has] * (len(texts) + 1) + _nodes(*back, offset)[has]
        _, below = np.unique(node, return_inverse=True)
        least = np.full(below.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, below, ranks[has])
        marked[has, before[has] - offset + 1] = ranks[has] > least[below]
    edge = np.diff(marked.astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    firsts = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1), pa.int32()), pa.array(first[row] + start, pa.int32()))
    named = {c: table[c].take(pa.array(row)) for c in ("h1", "h2")}
    return pa.table(named | {"firsts": firsts, "n": pa.array(stop - start + window - 1, pa.int32())})


def _subtrees(window: int, gram: int, at_once: int):
    """Suffixes sorted by prefix to repeats, some whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            keys = batch["k1"].to_numpy()
            last = np.flatnonzero(keys[1:] != keys[:-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            if not cut and waiting and keys[0] != waiting[-1]["k1"][-1].as_py():
                cut = -1  # a new group, with nothing of the one before
            if cut and held + max(cut, 0) >= at_once:
                whole = [*waiting, batch.slice(0, cut)] if cut > 0 else waiting
                yield from _repeats(pa.Table.from_batches(whole), window, gram).to_batches()
                waiting, held, batch = [], 0, batch.slice(max(cut, 0))
            waiting.append(batch)
            held += batch.num_rows
        if waiting:
            yield from _repeats(pa.Table.from_batches(waiting), window, gram).to_batches()

    return run


def repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST_IN_SUBTREE, at_once: int = AT_ONCE
) -> tuple[DataFrame, DataFrame]:
    """From (id, h1, h2, text): the least document of each text, and the spans of it that smaller documents hold.

    The first table is (h1, h2, least) with least = struct(none, id); the second
    (h1, h2, firsts, n): `n` words from each of `firsts` on. Equal texts are read as one.
    """
    place = F.struct(F.col("id").isNull().alias("none"), "id")
    scanned = docs.select("h1", "h2", place.alias("place"), _scan(window, gram)(F.col("text")).alias("anchors"))
    texts = stored(scanned.groupBy("h1", "h2").agg(F.min("place").alias("least"), F.any_value("anchors").alias("anchors")), "anchors")
    # all suffixes are counted, but a text asks for each of its prefixes once
    prefixes = texts.select("h1", "h2", "least", F.explode(F.transform("anchors", lambda a: a["prefix"])).alias("prefix"))
    shared = prefixes.groupBy("prefix").agg(F.count("*").alias("n"), F.min("least").alias("a"), F.max("least").alias("b"))
    shared = shared.filter("a < b").select("prefix", (F.col("n") > most).alias("whole"))
    asked = texts.select("h1", "h2", F.explode(F.array_distinct(F.transform("anchors", lambda a: a["prefix"]))).alias("prefix"))
    wanted = asked.join(shared, "prefix").groupBy("h1", "h2").agg(F.collect_list(F.struct("prefix", "whole")).alias("wanted"))
    once = docs.groupBy("h1", "h2").agg(F.any_value("text").alias("text"))
    sent = once.join(wanted, ["h1", "h2"]).join(texts, ["h1", "h2"])
    sent = sent.select("h1", "h2", F.col("least.id").alias("id"), "text", "anchors", "wanted")
    kind = _suffix_type(docs.schema["id"].dataType)
    suffixes = stored(sent.mapInArrow(_suffixes(window), kind), "suffixes")

    grouped = suffixes.filter("NOT whole").select("k1", "id", "h1", "h2", "firsts", "before", "windows", "words")
    spans = "h1 long, h2 long, firsts array<int>, n int"
    inner = grouped.repartition("k1").sortWithinPartitions("k1").mapInArrow(_subtrees(window, gram, at_once), spans)

    def nodes(rows: DataFrame, how: str = "inner") -> DataFrame:
        """Rows whose keys are in several documents, with the `least` of these; with all others if `how` is left."""
        rows = rows.withColumn("place", place)
        deep = rows.groupBy("k1", "k2").agg(F.min("place").alias("least"), F.max("place").alias("most")).filter("least < most")
        return rows.join(deep.drop("most"), ["k1", "k2"], how)

    def covered(rows: DataFrame) -> DataFrame:
        """The words of all windows of rows that a smaller document has as they are."""
        return rows.filter("place > least").select("h1", "h2", "firsts", (F.col("windows") + (window - 1)).cast("int").alias("n"))

    # equal words around an anchor are met as a whole; what is left of them, and all others, window by window
    around = stored(nodes(suffixes.filter("whole"), "left"), "around")
    left = around.filter("least IS NULL OR place <= least").select(*_NAMES)
    whole = covered(around).unionByName(covered(nodes(left.mapInArrow(_windows(window), kind))))
    return texts.select("h1", "h2", "least"), inner.unionByName(whole)


def _keep(window: int):
    @F.arrow_udf("kept string, n_words long, n_removed long")
    def run(texts: pa.Array, spans: pa.Array, later: pa.Array) -> pa.Array:
        found = []
        for text, own, copied in zip(texts, spans, later, strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            edge = np.zeros(len(words) + 1, np.int64)
            if copied.as_py() and len(words) >= window:
                edge[0] = 1
            for s in own.as_py() or ():
                for first in s["firsts"]:
                    edge[first] += 1
                    edge[first + s["n"]] -= 1
            stays = np.cumsum(edge[:-1]) == 0
            kept = b" ".join(compress(words, stays)).decode("utf-8", "surrogatepass")
            found.append({"kept": kept, "n_words": len(words), "n_removed": int(len(words) - stays.sum())})
        return pa.array(found, pa.struct([("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())]))

    return run


def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    window: int = WINDOW,
    gram: int = GRAM,
    most: int = MOST_IN_SUBTREE,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """The rows of `docs` as `row`, with `kept` (the words left, joined by spaces), `n_words`, `n_removed`.

    Words are runs of characters other than ASCII white space. A word goes if it is
    in a run of `window` words that also starts in a row of a smaller id; a null id
    is larger than any other, and rows of equal ids leave each other alone. A
    null text has no words; texts shorter than `window` stay.
    """
    said = F.coalesce(col(text), F.lit(""))
    rows = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"),
        col(doc_id).alias("id"),
        said.alias("text"),
        F.xxhash64(said).alias("h1"),
        F.xxhash64(F.lit("again"), said).alias("h2"),
    )
    least, spans = repeats(rows.select("id", "h1", "h2", "text"), window, gram, most, at_once)
    gathered = spans.groupBy("h1", "h2").agg(F.collect_list(F.struct("firsts", "n")).alias("spans"))
    place = F.struct(F.col("id").isNull().alias("none"), "id")
    known = least.join(gathered, ["h1", "h2"], "left")
    done = rows.drop("text").join(known, ["h1", "h2"], "left").withColumn("later", place > F.col("least"))
    return done.select("row", _keep(window)(F.col("row")[text], F.col("spans"), F.col("later")).alias("k")).select("row", "k.*")
