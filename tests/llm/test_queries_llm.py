"""The registered queries against their SQL or a brute-force version, on the smallest tables."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from conftest_data import SF_DIR, brute_components, brute_repeats, brute_simhash, jaccard, shingles
from oracle import check, connect
from regionflow.llm import queries as q

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(spark, name):
    problem, *_ = check(spark, connect(SF_DIR), q.QUERIES[name], q.SQL[name], SF_DIR)
    assert problem is None


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in q.QUERIES) == list(range(1, 14))


def test_sentencepiece(spark, texts):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in q.QUERIES["op3_sentencepiece"](spark, SF_DIR).collect():
        ids = model.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_simhash(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in q.QUERIES["op5_simhash"](spark, SF_DIR).collect()}
    fps = {i: brute_simhash(t) for i, t in texts.items()}
    component = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", component[i]) for i in texts}


def test_language(spark):
    rows = q.QUERIES["op6_langid"](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [r for r in rows if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in judged) >= 0.9 * len(judged)
    assert all(0 <= r.score <= 1 for r in rows)


def test_nearest(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    unit = np.array([r.embedding for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    got: dict[int, list] = {}
    for r in q.QUERIES["op7_nearest"](spark, SF_DIR).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[i]
        score[i] = -2
        best = np.lexsort((ids, -score))[:5]
        found = sorted(got[ids[i]])
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(ids[best].tolist()))
    assert hits >= 0.9 * 5 * len(got)


def test_fingerprints(spark, texts):
    got = {r.doc_id: r for r in q.QUERIES["op8_fingerprints"](spark, SF_DIR).collect()}
    order, errors = sorted(texts, reverse=True), []
    for k, i in enumerate(order):
        text, follow = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + follow[:third]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors.append(got[i].near_edited - jaccard(shingles(text), shingles(edited)))
        assert abs(got[i].near_next - jaccard(shingles(text), shingles(follow))) < 0.2
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.02
    by_text: dict[str, set] = {}
    for i, t in texts.items():
        by_text.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_repeats(spark, texts):
    got = {r.doc_id: r for r in q.QUERIES["op10_repeats"](spark, SF_DIR).collect()}
    for i, (gone, data) in brute_repeats(texts).items():
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want


def test_pipeline(spark):
    """Each stage against its operator's query or a plain version of it, on what the stage before kept."""
    docs, kept = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).toArrow())
        kept.append([r.asDict() for r in docs.collect()])
    known, lines, near, mixed, encoded = kept
    source = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    und = {r.doc_id for r in q.QUERIES["op6_langid"](spark, SF_DIR).collect() if r.lang_pred == "und"}
    assert {r["doc_id"] for r in known} == set(source) - und
    assert all(set(r) == set(source[0].asDict()) for stage in kept[:4] for r in stage)

    windows = Counter()
    first: dict[tuple, tuple] = {}
    for r in sorted(known, key=lambda r: r["doc_id"]):
        own = r["text"].split("\n")
        for k in range(len(own) - 2):
            windows[tuple(own[k : k + 3])] += 1
            first.setdefault(tuple(own[k : k + 3]), (r["doc_id"], k))
    want = {}
    for r in known:
        own = r["text"].split("\n")
        marks = {k + j for k in range(len(own) - 2) for j in range(3) if "".join(own[k : k + 3]).split() and first[tuple(own[k : k + 3])] != (r["doc_id"], k)}
        left = "\n".join(x for k, x in enumerate(own) if k not in marks)
        if not marks or left.split():
            want[r["doc_id"]] = left
    assert {r["doc_id"]: r["text"] for r in lines} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines)

    component = brute_components({i: brute_simhash(t) for i, t in want.items()})
    assert {r["doc_id"] for r in near} == set(component.values())
    sizes = Counter()
    for r in near:
        sizes[r["source"]] += len(r["text"].split())
    counts = Counter(r["doc_id"] for r in mixed)
    assert set(counts) <= set(component.values()) and max(counts.values()) <= 3
    assert Counter(r["doc_id"] for r in encoded) == counts
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in encoded)
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(encoded)
