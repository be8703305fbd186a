"""Encoding and decoding with a sentencepiece BPE model, by a table of prefixes.

The pieces of a text's prefixes determine each other: the pieces of a prefix are
those of a shorter one and one more, its last piece. So a table with the last
piece of every prefix holds the whole encoding. It is filled from left to right:
an Aho-Corasick automaton names the pieces that end at a position, and exactly
one of them goes with the last piece of the prefix before it (both stay apart
when merged by themselves). Read backwards from the end, the table gives the ids.

The different chunks of many texts are worked on side by side, those of one
length together: one step fills the table for a position of all of them.

Pieces never reach over a space mark that follows other characters, nor over a
character that is in no piece, so texts are encoded chunk by chunk, each different
chunk once. Texts are read whole, and no row meets another one.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from regionflow.llm.common import give_back, small_batches

SPACE = "▁"
#: Characters that the table of states has columns for, and the longest chunk worked on by numpy.
CLASSES, LONGEST = 128, 32
#: Slots of the table of pairs that were tried out; half of them are filled at most.
PAIR_SLOTS = 1 << 20
#: Pairs kept for chunks that numpy does not work on.
MOST_ASKED = 100_000
#: Bytes of text encoded in one go.
STEP = 1 << 20


def read_model(path: str) -> dict:
    """The vocabulary of a model file as plain lists, to be sent to the tasks.

    Refuses models that change characters, drop spaces, or hold pieces with a
    space mark after another character: they need another encoder.
    """
    import sentencepiece

    with open(path, "rb") as file:
        model = sentencepiece.SentencePieceProcessor(model_proto=file.read())
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    kinds = ["control" if model.is_control(i) else "unknown" if model.is_unknown(i) else "byte" if model.is_byte(i) else "piece" for i in range(n)]
    probe = " ﬁ  ½\tÁ "
    if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError("the model normalises texts")
    if any(model.is_unused(i) for i in range(n)) or kinds.count("byte") != 256:
        raise ValueError("the model has unused pieces or no byte fallback")
    if any(SPACE in p.lstrip(SPACE) for p, kind in zip(pieces, kinds, strict=True) if kind == "piece"):
        raise ValueError("the model has pieces that reach over a space")
    return {
        "pieces": pieces,
        "kinds": kinds,
        "scores": [model.get_score(i) for i in range(n)],
        "begin": model.bos_id(),
        "end": model.eos_id(),
    }


#: Texts that are not cut at single spaces alone.
_ODD = rf"^$|^ |  |[{SPACE}\x00]"


class Automaton:
    """Aho-Corasick over the pieces; its states can be kept and gone on from."""

    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}]
        ending: list[int] = [-1]
        for number, piece in enumerate(pieces):
            state = 0
            for c in piece:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    ending.append(-1)
                state = self.next[state][c]
            ending[state] = number
        #: For each state the pieces that end there, longest first, as (length, piece).
        self.found: list[tuple] = [()] * len(self.next)
        self.back = [0] * len(self.next)
        self.order: list[int] = []  # by depth
        queue = deque([0])
        while queue:
            state = queue.popleft()
            self.order.append(state)
            for c, child in self.next[state].items():
                self.back[child] = self.move(self.back[state], c) if state else 0
                own = ((len(pieces[ending[child]]), ending[child]),) if ending[child] >= 0 else ()
                self.found[child] = own + self.found[self.back[child]]
                queue.append(child)

    def move(self, state: int, c: str) -> int:
        while state and c not in self.next[state]:
            state = self.back[state]
        return self.next[state].get(c, 0)


class Pairs:
    """Which units stay apart side by side: an open hash table that numpy reads, filled by trying pairs out."""

    def __init__(self, try_out):
        self.try_out = try_out
        self.clear()

    def clear(self) -> None:
        self.keys = np.full(PAIR_SLOTS, -1, np.int64)
        self.apart = np.zeros(PAIR_SLOTS, bool)
        self.filled = 0
        self.asked: dict[int, bool] = {}

    def one(self, key: int) -> bool:
        found = self.asked.get(key)
        if found is None:
            if len(self.asked) >= MOST_ASKED:
                self.asked.clear()
            found = self.asked[key] = bool(self.many(np.array([key]))[0])
        return found

    def add(self, key: int) -> bool:
        if self.filled >= PAIR_SLOTS // 2:
            self.clear()
        slot = int(self.slots(np.array([key]))[0])
        while self.keys[slot] >= 0:
            slot = (slot + 1) % PAIR_SLOTS
        self.keys[slot], self.apart[slot] = key, self.try_out(key)
        self.filled += 1
        return bool(self.apart[slot])

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - (PAIR_SLOTS.bit_length() - 1))).astype(np.int64)

    def many(self, keys: np.ndarray) -> np.ndarray:
        slots = self.slots(keys)
        held = self.keys[slots]
        out = self.apart[slots]
        open_ = np.flatnonzero(held != keys)
        while len(open_):
            new = open_[held[open_] < 0]
            if len(new):
                own, back = np.unique(keys[new], return_inverse=True)
                out[new] = np.array([self.add(k) for k in own.tolist()])[back]
                open_ = open_[held[open_] >= 0]
            slots[open_] = (slots[open_] + 1) % PAIR_SLOTS
            held[open_] = self.keys[slots[open_]]
            out[open_] = self.apart[slots[open_]]
            open_ = open_[held[open_] != keys[open_]]
        return out


class Codec:
    """Encoder and decoder of one model; one per Python worker."""

    def __init__(self, model: dict):
        self.begin, self.end = (np.array([model[x]], "<u4").tobytes() for x in ("begin", "end"))
        ids, self.score, byte_ids = {}, {}, {}
        self.surface: list[bytes] = []
        self.control, self.byte_value, self.marked = set(), {}, set()
        for i, (text, kind, score) in enumerate(zip(model["pieces"], model["kinds"], model["scores"], strict=True)):
            surface = text.replace(SPACE, " ").encode()
            if kind == "piece":
                ids[text], self.score[text] = i, score
                if text.startswith(SPACE):
                    self.marked.add(i)
            elif kind == "byte":
                self.byte_value[i] = int(text[1:-1], 16)
                byte_ids[self.byte_value[i]] = i
                surface = bytes([self.byte_value[i]])
            elif kind == "control":
                self.control.add(i)
                surface = b""
            else:
                surface = " ⁇ ".encode()
            self.surface.append(surface)
        n = len(self.surface)
        self.control_ids = np.array(sorted(self.control), "<u4")
        self.is_control, self.is_marked = np.zeros(n, bool), np.zeros(n, bool)
        self.is_control[list(self.control)] = self.is_marked[list(self.marked)] = True
        self.surface_size = np.array([len(x) for x in self.surface])
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        self.byte_ids = [np.array([byte_ids[b]], "<u4").tobytes() for b in range(256)]
        self.alphabet = {c for p in ids for c in p}
        # a character within longer pieces but no piece itself still stands alone at first
        self.units = [*ids, *sorted(c for c in self.alphabet if c not in ids)]
        self.packed = [np.array([ids[u]], "<u4").tobytes() if u in ids else self.as_bytes(u) for u in self.units]
        self.automaton = Automaton(self.units)
        self.chunk = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.plain = "\n" not in self.alphabet
        self.pairs = Pairs(self.try_out)
        self.unit_ids = np.array([ids.get(u, -1) for u in self.units], np.int64)
        self._tables(ids)

    def _tables(self, ids: dict[str, int]) -> None:
        """The automaton as arrays, for the characters that most pieces hold."""
        uses = Counter(c for p in ids for c in p)
        common = [c for c, _ in sorted(uses.items(), key=lambda x: (-x[1], x[0])) if c in ids][: CLASSES - 1]
        self.class_of = np.zeros(0x110000, np.uint8)
        self.class_of[[ord(c) for c in common]] = np.arange(1, len(common) + 1)
        auto = self.automaton
        self.moves = np.zeros((len(auto.next), CLASSES), np.uint16 if len(auto.next) <= 1 << 16 else np.int32)
        number = {c: k + 1 for k, c in enumerate(common)}
        for state in auto.order:
            if state:
                self.moves[state] = self.moves[auto.back[state]]
            for c, child in auto.next[state].items():
                if c in number:
                    self.moves[state, number[c]] = child
        most = max(map(len, auto.found))
        self.found_unit = np.full((len(auto.next), most), -1, np.int32)
        self.found_size = np.ones((len(auto.next), most), np.int16)
        for state, found in enumerate(auto.found):
            for k, (size, unit) in enumerate(found):
                self.found_unit[state, k], self.found_size[state, k] = unit, size

    def as_bytes(self, c: str) -> bytes:
        """The packed ids of a character that is no piece."""
        return b"".join([self.byte_ids[b] for b in c.encode()])

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: best score first, leftmost of equals."""
        parts = list(text)
        while True:
            best = min(
                ((-self.score[ab], k) for k, ab in enumerate(map(str.__add__, parts, parts[1:])) if ab in self.score),
                default=None,
            )
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def try_out(self, key: int) -> bool:
        """Whether two units stay as they are side by side; without a left one (0): whether the right one stands by itself."""
        left, right = divmod(key, len(self.units))
        want = [self.units[left - 1], self.units[right]] if left else [self.units[right]]
        return self.merged("".join(want)) == want

    def learn(self, chunk: str) -> bytes:
        """The packed ids of one chunk, by its own table."""
        state, last, size = 0, [], []
        for at, c in enumerate(chunk):
            state = self.automaton.move(state, c)
            unit, length = -1, 1  # a character in no piece
            for length, unit in self.automaton.found[state]:  # noqa: B007
                left = last[at - length] + 1 if at >= length else 0
                if self.pairs.one(left * len(self.units) + unit):
                    break
            last.append(unit)
            size.append(length)
        parts, at = [], len(chunk) - 1
        while at >= 0:
            parts.append(self.packed[last[at]] if last[at] >= 0 else self.as_bytes(chunk[at]))
            at -= size[at]
        return b"".join(reversed(parts))

    def _learn_group(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of one length by the rows of `classes`: their units from the last one on, and how many."""
        m, n = classes.shape
        last, size = np.empty((n, m), np.int64), np.empty((n, m), np.int64)
        state = np.zeros(m, np.int64)
        for at in range(n):
            state = self.moves[state, classes[:, at]]
            rest, k = np.arange(m), 0
            while len(rest):
                unit, length = self.found_unit[state[rest], k], self.found_size[state[rest], k]
                before = at - length
                left = np.where(before >= 0, last[np.maximum(before, 0), rest] + 1, 0)
                good = self.pairs.many(left * len(self.units) + unit)
                done = rest[good]
                last[at, done], size[at, done] = unit[good], length[good]
                rest, k = rest[~good], k + 1
        found, at, rows = np.full((m, n), -1, np.int64), np.full(m, n - 1), np.arange(m)
        count = np.zeros(m, np.int64)
        while len(rows):
            now = at[rows]
            found[rows, count[rows]] = last[now, rows]
            count[rows] += 1
            at[rows] = now - size[now, rows]
            rows = rows[at[rows] >= 0]
        return found, count

    def look_up(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different chunks one after the other, and how many each one has."""
        marked = pc.starts_with(keys, "\0")
        chunks = pc.if_else(marked, pc.utf8_slice_codeunits(keys, 1), pc.binary_join_element_wise(SPACE, keys, ""))
        chunks = pc.if_else(pc.equal(keys, "\n"), "\n", chunks)
        lengths = pc.utf8_length(chunks).to_numpy().astype(np.int64)
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), "")[0].as_py()
        classes = self.class_of[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        starts = np.cumsum(lengths) - lengths
        rare = np.concatenate([[0], np.cumsum(classes == 0)])
        usual = (rare[starts + lengths] == rare[starts]) & (lengths <= LONGEST) & (lengths > 0)
        groups = []
        counts = np.zeros(len(chunks), np.int64)
        for n in np.unique(lengths[usual]).tolist():
            which = np.flatnonzero(usual & (lengths == n))
            found, counts[which] = self._learn_group(classes[starts[which][:, None] + np.arange(n)])
            groups.append((which, found))
        special = {}
        for i in np.flatnonzero(~usual).tolist():
            special[i] = np.frombuffer(self.learn(text[starts[i] : starts[i] + lengths[i]]), "<u4")
            counts[i] = len(special[i])
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, "<u4")
        for which, found in groups:
            for k in range(int(counts[which].max(initial=0))):
                own = np.flatnonzero(counts[which] > k)
                out[ends[which[own]] - 1 - k] = self.unit_ids[found[own, k]]
        for i, ids in special.items():
            out[ends[i] - len(ids) : ends[i]] = ids
        return out, counts

    def encode(self, text: str) -> bytes:
        if not text:
            return self.begin + self.end
        chunks = self.chunk.findall(SPACE + text.replace(" ", SPACE))
        packed = {c: self.learn(c) for c in set(chunks)}
        return self.begin + b"".join(map(packed.__getitem__, chunks)) + self.end

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """The packed ids of each text (null: empty), with begin and end."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD) if self.plain else pa.array([True] * len(texts))
        usual = self._encode_usual(texts.filter(pc.invert(odd)))
        if not pc.any(odd).as_py():
            return usual
        special = pa.array([self.encode(t) for t in texts.filter(odd).to_pylist()], pa.binary())
        mask = odd.to_numpy(zero_copy_only=False)
        place = np.empty(len(mask), np.int64)
        place[~mask] = np.arange(len(usual))
        place[mask] = len(usual) + np.arange(len(special))
        return pa.concat_arrays([usual, special]).take(pa.array(place))

    def _encode_usual(self, texts: pa.Array) -> pa.Array:
        """Texts without empty ones, marks, leading and double spaces: cut by Arrow, put together by numpy."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n \0"), " ")
        bounds = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        ids, sizes = self.look_up(coded.dictionary)
        own = sizes[which]
        ids = ids[_spread((np.cumsum(sizes) - sizes)[which], own)]
        bounds = np.concatenate([[0], np.cumsum(own)])[bounds - bounds[0]]
        # begin and end around the ids of each text
        number = np.arange(len(texts) + 1)
        out = np.empty(len(ids) + 2 * len(texts), "<u4")
        inner = np.ones(len(out), bool)
        for edge, at in ((self.begin, bounds[:-1] + 2 * number[:-1]), (self.end, bounds[1:] + 2 * number[:-1] + 1)):
            out[at] = np.frombuffer(edge, "<u4")
            inner[at] = False
        out[inner] = ids
        return _binary(4 * (bounds + 2 * number), out.view(np.uint8), pa.binary())

    def decode_array(self, packed: pa.Array) -> pa.Array:
        """The texts of packed ids, null for null."""
        if packed.null_count == 0 and len(packed):
            edges = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
            ids = np.frombuffer(packed.buffers()[2], np.uint8)[edges[0] : edges[-1]].view("<u4")
            found = self._decode_usual(ids, (edges - edges[0]) // 4)
            if found is not None:
                return found
        return pa.array((self.decode(x.as_buffer()) if x.is_valid else None for x in packed), pa.string(), size=len(packed))

    def _decode_usual(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array | None:
        """The texts if each has one control id at either end and none between, and bytes that make characters."""
        size = np.diff(bounds)
        control = self.is_control[ids]
        if (size < 2).any() or not (control[bounds[:-1]] & control[bounds[1:] - 1]).all() or control.sum() != 2 * len(size):
            return None
        lengths = self.surface_size[ids]
        out = self.surface_bytes[_spread(self.surface_start[ids], lengths)]
        edges = np.concatenate([[0], np.cumsum(lengths)])[bounds]
        first = np.minimum(bounds[:-1] + 1, len(ids) - 1)
        strip = (size > 2) & self.is_marked[ids[first]]  # the mark that encoding puts in front
        out = np.delete(out, edges[:-1][strip])
        edges[1:] -= np.cumsum(strip)
        found = _binary(edges, out, pa.string())
        try:
            found.validate(full=True)
        except pa.ArrowInvalid:
            return None
        return found

    def decode(self, packed: bytes) -> str:
        array = np.frombuffer(packed, "<u4")
        ids = array.tolist()
        first = next((i for i in ids if i not in self.control), None)
        skip = int(first in self.marked)  # the mark that encoding puts in front
        if not np.isin(array[1:-1], self.control_ids).any():
            try:
                return b"".join(map(self.surface.__getitem__, ids)).decode()[skip:]
            except UnicodeDecodeError:
                pass
        out = []  # runs of byte pieces one by one
        for is_byte, run in groupby(ids, self.byte_value.__contains__):
            raw = b"".join(map(self.surface.__getitem__, run))
            out.append(_lenient(raw) if is_byte else raw.decode())
        return "".join(out)[skip:]


def _lenient(raw: bytes) -> str:
    """UTF-8 with a replacement character for each byte that starts no character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def _codec(path_key: str, holder: _Held) -> Codec:
    return Codec(holder.model)


class _Held:
    """A model that compares by name, so that a worker builds its codec once."""

    def __init__(self, name: str, model: dict):
        self.name, self.model = name, model

    def __eq__(self, other):
        return self.name == other.name

    def __hash__(self):
        return hash(self.name)


class PieceModel:
    """Column functions of a model file, which only the driver reads."""

    def __init__(self, spark, path: str):
        import hashlib

        with open(path, "rb") as file:
            name = hashlib.sha256(file.read()).hexdigest()
        small_batches(spark)
        # a vocabulary has a fixed size, whatever the data
        held = spark.sparkContext.broadcast(_Held(name, read_model(path)))

        @F.arrow_udf("binary")
        def encode(texts: pa.Array) -> pa.Array:
            done = _in_parts(_codec(name, held.value).encode_array, texts, pa.binary(), STEP)
            give_back()
            return done

        @F.arrow_udf("string")
        def decode(ids: pa.Array) -> pa.Array:
            done = _in_parts(_codec(name, held.value).decode_array, ids, pa.string(), STEP)
            give_back()
            return done

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        """The ids with begin and end, packed as little-endian 32-bit integers. A null text counts as empty."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """The text of packed ids; null for null."""
        return self._decode(ids)


def _parts(values: pa.Array, step: int) -> Iterator[pa.Array]:
    """Slices of about `step` bytes."""
    total = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(values):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + step, "right")))
        yield values[start:stop]
        start = stop


def _in_parts(convert, values: pa.Array, kind: pa.DataType, step: int) -> pa.Array:
    done = [convert(part) for part in _parts(values, step)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each length, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _binary(edges: np.ndarray, data: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def n_ids(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")
