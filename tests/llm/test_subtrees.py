"""Removal of passages that earlier documents hold, against a plain version."""

from __future__ import annotations

import decimal
import random
import re

import pytest

from regionflow.llm import subtrees


def plain(rows, window):
    """(id, text) to what is kept and how many words go; None is the largest id."""
    order = lambda i: (i is None, 0 if i is None else i)
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), words in zip(rows, split, strict=True):
        for k in range(len(words) - window + 1):
            run = tuple(words[k : k + window])
            least[run] = min(least.get(run, order(i)), order(i))
    found = []
    for (i, _), words in zip(rows, split, strict=True):
        gone = {k + j for k in range(len(words) - window + 1) if least[tuple(words[k : k + window])] < order(i) for j in range(window)}
        found.append((i, " ".join(w for k, w in enumerate(words) if k not in gone), len(words), len(gone)))
    return sorted(found, key=repr)


def texts(seed, n, window):
    draw = random.Random(seed)
    word = lambda: draw.choice(["a", "b", "c", "d", "é", "日本", "\x01x", "w" * 40])
    passages = [[word() for _ in range(draw.randrange(window - 2, 3 * window))] for _ in range(6)]
    found = []
    for _ in range(n):
        words = [word() for _ in range(draw.randrange(0, 2 * window))]
        for _ in range(draw.randrange(3)):
            at = draw.randrange(len(words) + 1)
            words[at:at] = draw.choice(passages)
        found.append("".join(w + draw.choice([" ", "\n", "\t ", "  "]) for w in words))
    return found


@pytest.mark.parametrize("window,gram,most,at_once", [(6, 2, 4096, 8192), (6, 3, 2, 1), (9, 9, 1, 5), (50, 16, 3, 40), (50, 16, 4096, 8192)])
def test_against_plain(docs_of, window, gram, most, at_once):
    made = texts(window + most, 70, window)
    rows = [(k, t) for k, t in enumerate(made)]
    rows += [(200, made[3]), (3, made[5]), (-1, made[7]), (None, made[8]), (None, made[8]), (None, made[9] + " " + made[2]), (9, made[9])]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "rep " * 300), (304, "rep " * 200), (305, " ".join(f"u{k}" for k in range(20_000)))]
    rows.append((306, f"before {rows[-1][1]} after"))
    random.Random(1).shuffle(rows)
    done = subtrees.remove_repeats(docs_of([(i, t, "en", "s") for i, t in rows]), window=window, gram=gram, most=most, at_once=at_once)
    got = done.select("row.doc_id", "kept", "n_words", "n_removed", "row.text", "row.rid").collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == plain(rows, window)


@pytest.mark.parametrize("kind,make", [("string", "id{:03d}".format), ("decimal(9,2)", decimal.Decimal), ("smallint", int)])
def test_other_ids(spark, kind, make):
    rows = [(make(k), t) for k, t in enumerate(texts(3, 40, 8))]
    docs = spark.createDataFrame(rows, f"`a.b` {kind}, text string")
    done = subtrees.remove_repeats(docs, doc_id="a.b", window=8, gram=3, most=4).select("row", "kept", "n_words", "n_removed").collect()
    assert sorted(((r["row"][0], *r[1:]) for r in done), key=repr) == plain(rows, 8)


def test_no_rows(docs_of):
    assert subtrees.remove_repeats(docs_of([])).collect() == []


def test_a_passage_of_half_the_documents(docs_of):
    """Near copies share a long passage at different places; more of them than a subtree takes."""
    draw = random.Random(4)
    passage = [f"p{k}" for k in range(120)]
    made = []
    for k in range(400):
        own = [f"o{k}-{j}" for j in range(draw.randrange(40))]
        made.append((k, " ".join([*own, *passage[draw.randrange(9) :], *own] if k % 2 else own)))
    done = subtrees.remove_repeats(docs_of([(i, t, "en", "s") for i, t in made]), most=50)
    assert sorted((tuple(r) for r in done.select("row.doc_id", "kept", "n_words", "n_removed").collect()), key=repr) == plain(made, 50)
