"""Spelling variants against a plain version."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from regionflow.llm import spelling

UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(counts, ratio=10):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), form[w] and counts[form[w]]) for w, n in counts.items()}


def edited(draw, word):
    at = draw.randrange(len(word) + 1)
    letter = draw.choice("abnorzéàÿ÷")
    return draw.choice([word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]])


def made_words(seed, bases=12, kinds=30):
    draw = random.Random(seed)
    found = {}
    for _ in range(bases):
        word = "".join(draw.choice("abenorsté") for _ in range(draw.choice([1, 2, 7, 8, 12])))
        for _ in range(kinds):
            found[word] = draw.choice([2, 3, 25, 300, 3000])
            word = edited(draw, word) or "a"
    return found


@pytest.mark.parametrize("seed,most", [(1, 4096), (2, 4096), (3, 5), (4, 1)])
def test_variants(spark, seed, most):
    """Also with blocks cut into many parts."""
    counts = made_words(seed)
    counts |= {"z" * 3000: 50, "z" * 2999: 3, "z" * 1500 + "b" + "z" * 1499: 4, "\U0001f600bcdefg": 2, "\U0001f601bcdefg": 20}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spelling.variants(words, most_in_block=most).collect()} == plain(counts)


def test_small_products(spark, monkeypatch):
    monkeypatch.setattr(spelling, "ROWS", 3)
    monkeypatch.setattr(spelling, "ACROSS", 4)
    import pyarrow as pa

    counts = made_words(5, 4, 60)
    rows = pa.table({"word": list(counts), "n": list(counts.values())})
    blocks = pa.Table.from_batches(spelling._blocks(rows.to_batches())).sort_by("key")
    zero = pa.array([0] * len(blocks))
    blocks = blocks.append_column("part", zero).append_column("low", zero).append_column("high", zero)
    got = [(r["word"], r["other"]) for b in spelling._pairs(iter(blocks.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in counts for b in counts if one_edit(a, b)}


def test_corpus(spark, docs_of):
    draw = random.Random(6)
    words = [w.capitalize() for w in made_words(7, 3, 5)] + ["straße", "ÀÉÎÕÜÝÞ", "×÷×÷×÷×", "naïveté"]
    rows = [(k % 40 if k else None, " ".join(draw.choice(words) for _ in range(60)), "en", "s") for k in range(80)]
    rows += [(50, None, "en", "s"), (51, "", "en", "s"), (52, "1234567 \n\x00", "en", "s"), (53, "verylongwords " * 5000, "en", "s")]
    counts = plain_counts([r[:2] for r in rows])
    got = spelling.variants(spelling.counted(spelling.corpus_words(docs_of(rows))))
    assert {tuple(r) for r in got.collect()} == plain(counts) and len(counts) > 10


def test_nothing(docs_of, spark):
    assert spelling.variants(spelling.counted(spelling.corpus_words(docs_of([])))).collect() == []
    words = spark.createDataFrame([(None, 3), ("", 4), ("lonely", 2)], "word string, n long")
    assert [tuple(r) for r in spelling.variants(words).collect()] == [("lonely", None, "lonely", 2, 0, None)]
