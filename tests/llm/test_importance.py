"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from regionflow.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target, percent=5, least=20, buckets=10000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * big_s / ((s[b] + 1.0) * big_t)))
    found = []
    for i, text in rows:
        n, own = features(text)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        found.append((i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    apt = sorted((r for r in found if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(apt[: percent * len(apt) // 100], 1):
        rank.setdefault(r, []).append(k)
    return Counter((*r, k) for r in set(found) for k in [*rank.get(r, []), *[None] * (found.count(r) - len(rank.get(r, [])))])


def texts(seed, n=60):
    draw = random.Random(seed)
    vocabulary = ["alpha", "Beta", "γάμμα", "x1", "日本", "\U0001f600é", "z" * 70, "q"] + [f"w{k}" for k in range(30)]
    gaps = [" ", "  ", "\n", ", ", "-", "\x00", "_", "\x7f", "/"]
    return ["".join(draw.choice(vocabulary) + draw.choice(gaps) for _ in range(draw.choice([0, 1, 2, 3, 19, 20, 21, 60]))) for _ in range(n)]


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_resample(docs_of, percent):
    rows = list(enumerate(texts(1)))
    rows += [(None, "a b c " * 10), (None, "a b c " * 10), (3, rows[3][1]), (7, "another text " * 15), (900, None), (901, ""), (902, " ,.\n")]
    rows.append((903, "long words in a very long text " * 9000))
    docs, target = docs_of([(i, t, "en", "s") for i, t in rows]), docs_of(texts(2, 9))
    got = importance.resample(docs, target.select("text"), percent=percent).collect()
    assert Counter(map(tuple, got)) == brute(rows, texts(2, 9), percent)


def test_no_rows(docs_of):
    none, some = docs_of([]), docs_of(["one two three " * 9, None])
    assert importance.resample(none, some).collect() == []
    assert [r.n_features for r in importance.resample(some, none).orderBy("id").collect()] == [78, 0]


def test_text_ids(spark):
    rows = [(f"id{k}", t) for k, t in enumerate(texts(3, 30))]
    got = importance.resample(spark.createDataFrame(rows, "`a.b` string, text string"), spark.createDataFrame([("w1 w2",)], "text string"), doc_id="a.b", percent=50)
    assert Counter(map(tuple, got.collect())) == brute(rows, ["w1 w2"], 50)


def test_features_in_pieces(monkeypatch):
    """Texts cut into small pieces, and many texts at a time, have the CRCs of their n-grams."""
    monkeypatch.setattr(importance, "PIECE", 16)
    monkeypatch.setattr(importance, "STEP", 7)
    rows = texts(4, 40)
    found: dict[int, Counter] = {}
    for _, owners, crcs in importance._Reader(3).read(pa.array(rows)):
        for o, c in zip(owners.tolist(), crcs.tolist(), strict=True):
            found.setdefault(o, Counter())[c] += 1
    want = {k: Counter(zlib.crc32(f.encode()) for f in features(t)[1]) for k, t in enumerate(rows)}
    assert found == {k: v for k, v in want.items() if v}


def test_shifts():
    data = np.random.default_rng(5).bytes(300_000)
    cuts = [(0, 0), (0, 1), (5, 300_000), (1000, 1063), (70_000, 140_000)]
    a = np.array([zlib.crc32(data[:x]) for x, _ in cuts], np.uint32)
    b = np.array([zlib.crc32(data[:y]) for _, y in cuts], np.uint32)
    found = b ^ importance.shifted(a, np.array([y - x for x, y in cuts]))
    assert found.tolist() == [zlib.crc32(data[x:y]) for x, y in cuts]
