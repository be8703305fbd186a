"""Removes repeated byte strings, found through a prefix-free parse of the corpus.

A rolling hash over WINDOW bytes triggers where its value falls into one of
PERIOD classes. Triggers depend on the bytes under the window alone, so equal
strings trigger at the same places and are cut into the same phrases. A string
of LENGTH bytes that starts at a place is then the end of one phrase, whole
phrases (its core, from its first trigger to its last), and the beginning of
another one. Two strings are equal if their cores are the same part of the parse
and the ends and beginnings around them agree.

1. Texts are packed into chunks, which are written once.
2. Triggers whose window occurs once in the corpus cannot be in a repeated
   string. Windows are counted through all chunks, and each chunk gets back a bit
   for each of its distinct windows.
3. Places whose string holds no such trigger are grouped into cells: neighbours
   with the same triggers, hence the same core. A cell travels as the hash of its
   core and the few bytes around it, and cells meet by core.
4. There the different phrase ends form a dictionary with its suffix array, and
   what follows the cores in the parse is sorted too. Both together put the
   strings into corpus order, where a string that occurs again stands next to an
   equal one. Each chunk gets back a bit for each of its strings.
5. Covered bytes are removed.

What leaves a chunk is distinct within it, so a string that is everywhere is
shuffled once per chunk, and equal cells of many chunks enter the order once.
Corpus order is made bucket by bucket, cores being dealt out by hash: which of
two different cores is smaller decides nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from regionflow.llm.common import col, small_batches
from regionflow.operators.skew import stored

LENGTH, WINDOW, PERIOD = 200, 64, 24
#: Bytes of text in a chunk at least and at most (a longer text has one of its own), bytes worked on at once, bytes of
#: text for each bucket. A chunk sends at most a row to each bucket, so chunks grow with the text.
CHUNK, MOST_CHUNK, TILE, BUCKET = 1 << 20, 128 << 20, 1 << 18, 4 << 20
LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 16
#: Pairs of continuations compared in one go.
COMPARED = 1 << 16

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_K1, _K2 = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _K1
    x = (x ^ (x >> _U(29))) * _K1
    return x ^ (x >> _U(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, base, _U)]), dtype=_U)


class Rolling:
    """Hashes of any part of a byte array, by prefix sums."""

    powers = inverses = np.ones(1, _U)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Rolling.powers) <= n:
            Rolling.powers, Rolling.inverses = _powers(_BASE, n), _powers(_INVERSE, n)
        terms = (data.astype(_U) + _U(1)) * Rolling.powers[:n]
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(terms, dtype=_U)])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        part = (self.sums[start + length] - self.sums[start]) * Rolling.inverses[start]
        return _mixed(part + np.atleast_1d(length).astype(_U) * _K2)


@dataclass
class Chunk:
    """Texts one after the other; `ends` is where each one ends."""

    data: np.ndarray
    ends: np.ndarray

    def tiles(self) -> Iterator[tuple[int, int]]:
        """(start, stop) of the places looked at together; bytes up to LENGTH beyond belong to their strings."""
        for start in range(0, len(self.data), TILE):
            yield start, min(start + TILE, len(self.data))

    def text_end(self, places: np.ndarray) -> np.ndarray:
        return self.ends[np.searchsorted(self.ends, places, "right")]

    def triggers(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the triggers and the hashes of their windows, in order."""
        places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
        for start, stop in self.tiles():
            part = self.data[start : stop + WINDOW - 1]
            if len(part) >= WINDOW:
                at = np.arange(len(part) - WINDOW + 1)
                h = Rolling(part).of(at, WINDOW)
                hit = np.flatnonzero((h * _K2 >> _U(40)) % _U(PERIOD) == 0)
                inside = hit + start + WINDOW <= self.text_end(hit + start)
                places.append(hit[inside] + start)
                hashes.append(h[hit[inside]])
        return np.concatenate(places), np.concatenate(hashes)

    def cells(self, triggers: np.ndarray, repeated: np.ndarray) -> Cells:
        """The cells of all places that may start a repeated string."""
        # triggers, and triggers seen once, before each of them
        once = np.concatenate([[0], np.cumsum(~repeated)])
        found = [Cells.none()]
        for start, stop in self.tiles():
            at = np.arange(start, min(stop, len(self.data) - LENGTH + 1))
            at = at[at + LENGTH <= self.text_end(at)] if len(at) else at
            first = np.searchsorted(triggers, at, "left")
            last = np.searchsorted(triggers, at + (LENGTH - WINDOW), "right")  # one past
            may = once[last] == once[first]
            at, first, last = at[may], first[may], last[may]
            if len(at):
                found.append(self._tile_cells(start, min(stop + LENGTH, len(self.data)), at, first, last, triggers))
        return Cells.joined(found)

    def _tile_cells(self, start, stop, at, first, last, triggers) -> Cells:
        bare = first == last  # no trigger: the core is the whole string
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (first[1:] != first[:-1]) | (last[1:] != last[:-1]) | bare[1:]
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(at)))
        begin, bare = at[head], bare[head]
        core = np.where(bare, begin, triggers[np.minimum(first[head], len(triggers) - 1)] if len(triggers) else begin)
        core_end = np.where(bare, begin + LENGTH, triggers[last[head] - 1] + WINDOW if len(triggers) else begin + LENGTH)
        rolling = Rolling(self.data[start:stop])
        key = rolling.of(core - start, core_end - core)
        whole = rolling.of(begin - start, size + (LENGTH - 1)) ^ _mixed(key + size.astype(_U))
        return Cells(begin, size, core, core_end, key, whole)


@dataclass
class Cells:
    """Runs of places `begin`, ..., `begin + size - 1` whose strings have one core; `whole` is a hash of all their bytes."""

    begin: np.ndarray
    size: np.ndarray
    core: np.ndarray
    core_end: np.ndarray
    key: np.ndarray
    whole: np.ndarray

    @staticmethod
    def none() -> Cells:
        i, u = np.zeros(0, np.int64), np.zeros(0, _U)
        return Cells(i, i, i, i, u, u)

    @staticmethod
    def joined(parts: list[Cells]) -> Cells:
        return Cells(*[np.concatenate([getattr(p, f) for p in parts]) for f in Cells.__annotations__])

    def take(self, which: np.ndarray) -> Cells:
        return Cells(*[getattr(self, f)[which] for f in Cells.__annotations__])

    def distinct(self) -> tuple[Cells, np.ndarray, np.ndarray]:
        """Different cells in the order of key and `whole`; which of them each one is; how often each occurs."""
        order = np.lexsort((self.whole, self.key))
        key, whole = self.key[order], self.whole[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(new) - 1
        return self.take(order[new]), index, np.bincount(index, minlength=int(new.sum()))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each length, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _slices(bucket_of: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, stop) of the runs of equal buckets in an ascending array."""
    edges = np.searchsorted(bucket_of, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), int(edges[b]), int(edges[b + 1])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return hashes >> _U(64 - (buckets.bit_length() - 1))


def _chunk_of(row: dict) -> Chunk:
    raw = zstandard.decompress(row["data"]) if row["data"] else b""
    return Chunk(np.frombuffer(raw, np.uint8), np.cumsum(np.asarray(row["lengths"], np.int64)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


# --- windows -------------------------------------------------------------------------------


def _window_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A window's bucket and 32 bits more: enough to rule strings out."""
    return _bucket(hashes, buckets) << _U(32) | (hashes & _U(0xFFFFFFFF))


def _emit_windows(buckets: int):
    def run(batches):
        for row in _rows(batches):
            _, hashes = _chunk_of(row).triggers()
            keys, counts = np.unique(_window_keys(hashes, buckets), return_counts=True)
            out = {"bucket": [], "chunk": [], "keys": [], "again": []}
            for b, i, j in _slices(keys >> _U(32), buckets):
                out["bucket"].append(b)
                out["chunk"].append(row["chunk"])
                out["keys"].append(keys[i:j].astype(np.uint32).tobytes())
                out["again"].append(np.packbits(counts[i:j] > 1).tobytes())
            yield from _batches(out, WINDOWS)

    return run


def _count_windows(rows: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows["keys"]]
    again = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(p)) for x, p in zip(rows["again"], parts, strict=True)]
    _, index = np.unique(np.concatenate(parts), return_inverse=True)
    repeated = np.bincount(index, weights=1 + np.concatenate(again)) > 1
    return _bits_back(rows, repeated[index], [len(p) for p in parts])


def _bits_back(rows: pa.Table, flags: np.ndarray, lengths: list[int]) -> pa.Table:
    edges = np.cumsum([0, *lengths])
    bits = [np.packbits(flags[i:j]).tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"chunk": rows["chunk"], "bucket": rows["bucket"], "bits": pa.array(bits, pa.binary())})


WINDOWS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("again", pa.binary())])
CELLS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("cells", pa.binary())])
BITS = "chunk long, bucket int, bits binary"


def _batches(out: dict[str, list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if out["bucket"]:
        yield pa.RecordBatch.from_pydict(out, schema)


def _merged_bits(bits: list[dict] | None, buckets_of: np.ndarray, buckets: int) -> np.ndarray:
    """The flags of a chunk's distinct things, from the bits of their buckets."""
    flags = np.zeros(len(buckets_of), bool)
    by_bucket = {x["bucket"]: x["bits"] for x in bits or []}
    for b, i, j in _slices(buckets_of, buckets):
        flags[i:j] = np.unpackbits(np.frombuffer(by_bucket[b], np.uint8), count=j - i)
    return flags


def _repeated_triggers(chunk: Chunk, bits: list[dict] | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    places, hashes = chunk.triggers()
    keys, index = np.unique(_window_keys(hashes, buckets), return_inverse=True)
    return places, _merged_bits(bits, keys >> _U(32), buckets)[index]


# --- cells ---------------------------------------------------------------------------------


def _packed(chunk: Chunk, cells: Cells, counts: np.ndarray) -> bytes:
    """Core hashes, sizes and the bytes before and after the cores, compressed."""
    left, right = cells.core - cells.begin, cells.begin + cells.size - 1 + LENGTH - cells.core_end
    heads = np.stack([cells.size, left, right, counts > 1], axis=1).astype("<u2")
    around = chunk.data[np.concatenate([_spread(cells.begin, left), _spread(cells.core_end, right)])]
    body = np.uint32(len(heads)).tobytes() + cells.key.tobytes() + heads.tobytes() + around.tobytes()
    return zstandard.compress(body, 1)


def _emit_cells(buckets: int):
    def run(batches):
        for row in _rows(batches):
            chunk = _chunk_of(row)
            cells, _, counts = chunk.cells(*_repeated_triggers(chunk, row["windows"], buckets)).distinct()
            out = {"bucket": [], "chunk": [], "cells": []}
            for b, i, j in _slices(_bucket(cells.key, buckets), buckets):
                out["bucket"].append(b)
                out["chunk"].append(row["chunk"])
                out["cells"].append(_packed(chunk, cells.take(np.arange(i, j)), counts[i:j]))
            yield from _batches(out, CELLS)

    return run


@dataclass
class Ends:
    """Cells of one bucket: core, size, and the bytes before and after the core, in two arrays one after the other."""

    key: np.ndarray
    size: np.ndarray
    left: np.ndarray
    right: np.ndarray
    before: np.ndarray
    after: np.ndarray
    again: np.ndarray

    @staticmethod
    def unpacked(packed: bytes) -> Ends:
        body = zstandard.decompress(packed)
        n = int(np.frombuffer(body, np.uint32, 1)[0])
        key = np.frombuffer(body, _U, n, 4)
        size, left, right, again = np.frombuffer(body, "<u2", 4 * n, 4 + 8 * n).reshape(n, 4).astype(np.int64).T
        around = np.frombuffer(body, np.uint8, offset=4 + 16 * n)
        return Ends(key, size, left, right, around[: left.sum()], around[left.sum() :], again)

    @staticmethod
    def joined(parts: list[Ends]) -> Ends:
        return Ends(*[np.concatenate([getattr(p, f) for p in parts]) for f in Ends.__annotations__])

    def take(self, which: np.ndarray) -> Ends:
        spans = [(n, np.cumsum(n) - n) for n in (self.left, self.right)]
        before, after = (x[_spread(at[which], n[which])] for x, (n, at) in zip((self.before, self.after), spans, strict=True))
        return Ends(self.key[which], self.size[which], self.left[which], self.right[which], before, after, self.again[which])

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first of each kind of cell; of which kind each one is; how often each kind occurs (2: more than once)."""
        _, left, _ = _kinds(self.before, self.left)
        _, right, _ = _kinds(self.after, self.right)
        whole = _mixed(self.key ^ _mixed(left * _K2 + right) + self.size.astype(_U))
        _, first, kind = np.unique(whole, return_index=True, return_inverse=True)
        return first, kind, np.bincount(kind, weights=1 + self.again)


def _kinds(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of strings one after the other: where each begins, its hash, and its kind, numbered by hash."""
    starts = np.cumsum(lengths) - lengths
    hashes = Rolling(data).of(starts, lengths)
    return starts, hashes, np.unique(hashes, return_inverse=True)[1]


def _suffix_ranks(symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The rank of each suffix among all, by doubling; a suffix ends at its string's `last` place, a terminator 0."""
    at = np.arange(len(symbols))
    value = np.zeros(len(symbols), np.int64)
    for k in range(7):
        value = value * 512 + np.where(at + k <= last, symbols[np.minimum(at + k, last)], 0)
    rank, seen = np.unique(value, return_inverse=True)[1], 7
    longest = int((last - at).max(initial=0)) + 1
    while seen < longest:
        follows = np.where(at + seen <= last, rank[np.minimum(at + seen, last)] + 1, 0)
        rank, seen = np.unique(rank * (len(symbols) + 1) + follows, return_inverse=True)[1], 2 * seen
    return rank


def _dictionary(cells: Ends) -> np.ndarray:
    """The rank, in the suffix array of the dictionary, of what stands before the core in each string of the cells.

    The dictionary holds the different phrase ends; a string's part of it is a
    suffix, and equal suffixes have equal ranks.
    """
    starts, _, kind = _kinds(cells.before, cells.left)
    first = np.unique(kind, return_index=True)[1]
    lengths = cells.left[first]
    place = np.cumsum(lengths + 1) - (lengths + 1)
    symbols = np.zeros(int((lengths + 1).sum()), np.int64)
    symbols[_spread(place, lengths)] = cells.before[_spread(starts[first], lengths)].astype(np.int64) + 1
    ranks = _suffix_ranks(symbols, np.repeat(place + lengths, lengths + 1))
    return ranks[_spread(place[kind], cells.size)]


def _continuations(cells: Ends) -> tuple[np.ndarray, np.ndarray]:
    """The rank of what follows each cell's core, and the continuations as rows in that order, 0 after their end."""
    starts, _, kind = _kinds(cells.after, cells.right)
    first = np.unique(kind, return_index=True)[1]
    lengths = cells.right[first]
    rows = np.zeros((len(first), int(lengths.max(initial=0)) + 1), np.uint8)
    # no byte of UTF-8 is 255, so one more fits
    rows[np.repeat(np.arange(len(first)), lengths), _spread(np.zeros_like(lengths), lengths)] = cells.after[_spread(starts[first], lengths)] + np.uint8(1)
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[kind], rows[order]


def _same_neighbours(cells: Ends) -> np.ndarray:
    """Whether each string of the cells is equal to another one: its neighbour in corpus order agrees with it throughout.

    Corpus order: by the part before the core in the dictionary's suffix array,
    then by core, then by what follows it in the parse.
    """
    cell = np.repeat(np.arange(len(cells.key)), cells.size)
    step = _spread(np.zeros_like(cells.size), cells.size)
    core = np.unique(cells.key, return_inverse=True)[1]
    group = _dictionary(cells) * (len(core) + 1) + core[cell]
    rank, rows = _continuations(cells)
    rank = rank[cell]
    wanted = cells.right[cell] - (cells.size[cell] - 1 - step)  # bytes after the core; one number within a group
    order = np.lexsort((rank, group))
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(group[a] == group[b])
    a, b = a[near], b[near]
    same = rank[a] == rank[b]
    other = np.flatnonzero(~same)
    for start in range(0, len(other), COMPARED):
        part = other[start : start + COMPARED]
        differ = rows[rank[a[part]]] != rows[rank[b[part]]]
        same[part] = differ.argmax(axis=1) >= wanted[a[part]]
    found = np.zeros(len(cell), bool)
    found[a[same]] = found[b[same]] = True
    return found


def _count_strings(rows: pa.Table) -> pa.Table:
    parts = [Ends.unpacked(x.as_py()) for x in rows["cells"]]
    cells = Ends.joined(parts)
    first, kind, count = cells.distinct()
    one = cells.take(first)
    found = _same_neighbours(one) | np.repeat(count > 1, one.size)
    at = np.cumsum(one.size) - one.size
    return _bits_back(rows, found[_spread(at[kind], cells.size)], [int(p.size.sum()) for p in parts])


# --- result --------------------------------------------------------------------------------


def _covered(chunk: Chunk, windows: list[dict] | None, strings: list[dict] | None, buckets: int) -> np.ndarray:
    """Whether each byte of the chunk lies in a repeated string."""
    every = chunk.cells(*_repeated_triggers(chunk, windows, buckets))
    cells, index, _ = every.distinct()
    before = np.cumsum(cells.size) - cells.size
    flags = _merged_bits(strings, np.repeat(_bucket(cells.key, buckets), cells.size), buckets)
    places = _spread(every.begin, every.size)
    starts = places[flags[_spread(before[index], every.size)]]
    started = np.zeros(len(chunk.data), np.int32)
    started[starts] = 1
    np.cumsum(started, out=started)
    over = np.zeros_like(started)  # strings that began and ended before a byte
    over[LENGTH:] = started[:-LENGTH]
    return started > over


def _result(buckets: int, schema: pa.Schema):
    def run(batches):
        for row in _rows(batches):
            chunk = _chunk_of(row)
            gone = _covered(chunk, row["windows"], row["strings"], buckets)
            out = {name: [] for name in schema.names}
            for key, stop, size in zip(row["keys"], chunk.ends.tolist(), row["lengths"], strict=True):
                data, away = chunk.data[stop - size : stop], gone[stop - size : stop]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], away.astype(np.int8), [0]])))
                out["key"].append(key)
                out["n_bytes"].append(size)
                out["n_removed"].append(int(away.sum()))
                out["spans"].append([{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)])
                out["kept"].append(data[~away].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema)

    return run


def _pack(chunk_bytes: int, key_type: pa.DataType):
    schema = pa.schema([("chunk", pa.int64()), ("keys", pa.list_(key_type)), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        keys, texts, size = [], [], 0

        def closed():
            nonlocal keys, texts, size, made
            data = zstandard.compress(b"".join(texts), 3)
            row = {"chunk": [part << 32 | made], "keys": [keys], "lengths": [[len(t) for t in texts]], "data": [data]}
            keys, texts, size, made = [], [], 0, made + 1
            return pa.RecordBatch.from_pydict(row, schema)

        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                keys.append(key.as_py())
                texts.append(raw)
                size += len(raw)
                if size >= chunk_bytes:
                    yield closed()
        if keys:
            yield closed()

    return run


def _power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_bytes: int | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept), one row per row of `docs`.

    A byte goes if it lies in a string of LENGTH bytes that starts anywhere else
    in the texts too, in the same one included; strings never reach over texts and
    are judged on the input. `spans` are the removed runs [start, stop), `kept`
    the other bytes, which need not be whole characters. A null text counts as
    empty; null and repeated keys are kept as they are, each row for itself.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(col(key).alias("key"), col(text).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk_bytes = chunk_bytes or min(MOST_CHUNK, max(CHUNK, total // MOST_BUCKETS))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, _power_of_two(max(total / BUCKET, 4 * parallel, LEAST_BUCKETS)))
    key_ddl = source.schema["key"].dataType.simpleString()
    key_type = to_arrow_type(source.schema["key"].dataType)

    packed = source.mapInArrow(_pack(chunk_bytes, key_type), f"chunk long, keys array<{key_ddl}>, lengths array<long>, data binary")
    chunks = stored(packed, "chunks")

    def gathered(bits: DataFrame, name: str) -> DataFrame:
        return stored(bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name)), name)

    windows = chunks.mapInArrow(_emit_windows(buckets), "bucket int, chunk long, keys binary, again binary")
    with_windows = chunks.join(gathered(windows.groupBy("bucket").applyInArrow(_count_windows, BITS), "windows"), "chunk", "left")
    cells = with_windows.mapInArrow(_emit_cells(buckets), "bucket int, chunk long, cells binary")
    strings = gathered(cells.groupBy("bucket").applyInArrow(_count_strings, BITS), "strings")
    schema = pa.schema(
        [("key", key_type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
         ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())]
    )
    return with_windows.join(strings, "chunk", "left").mapInArrow(
        _result(buckets, schema),
        f"key {key_ddl}, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary",
    )


def n_spans(spans: Column) -> Column:
    return F.size(spans).cast("long")
