"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import datetime
import decimal
import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from conftest_data import SF_DIR, brute_components, brute_repeats, brute_simhash, jaccard, shingles
from regionflow.llm import ann, chat, langid, linededup, minhash, mixing, piece_bpe, prefixfree, simhash, warc
from regionflow.llm import queries as q
from regionflow.llm.common import identified
from regionflow.session import fresh_path

random.seed(5)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "straße", "日本", "\U0001d11e"]
LONG = " ".join(random.choice(WORDS) for _ in range(40_000))
PROSE = " ".join(random.choice(WORDS) for _ in range(120))
HARD = [
    (None, None, None, None),
    (None, PROSE, "en", None),
    (None, PROSE, "en", None),
    (1, "", "en", "a"),
    (1, "", "en", "a"),
    (2, "word", None, "a"),
    (3, LONG, "en", "b"),
    (4, LONG + " end", "de", "b"),
    (5, "   \n\t\n  ", "de", ""),
    (6, "1234 5678 !!", "fr", "\U0001d11e"),
    (7, "x\n\n\n\ny\nz\nx\n\n\n\ny\nz", "fr", "z"),
    (8, "\x00\x01 ▁ <s> �", "es", "z"),
    (-9, PROSE[:300], "es", "z"),
]


@pytest.fixture
def hard(docs_of):
    return docs_of(HARD)


@pytest.fixture
def empty(hard):
    return hard.limit(0)


# --- archive ---

PAGES = "page_id long, url string, html string, digest string, head string"


def test_archive_rebuilds_records(spark):
    big = "é" * 80
    rows = [(3, "http://a/\r\nX: y", big), (1, None, big), (1, None, big), (None, "u", big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small")]
    path = fresh_path(spark, "archive")
    warc.write_archive(spark.createDataFrame([(*r, "d", "h") for r in rows], PAGES), path)
    got = warc.records(warc.read_archive(spark, path)).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter(
        [(3, "revisit", 1), (1, "response", None), (1, "response", None), (None, "revisit", 1)] + [(i, "response", None) for i in (4, 5, 6, 7)]
    )
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    for r in got:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(body) - 4 and body.endswith(b"\r\n\r\n")
        payload = bytes(r.payload)
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
        if r.record_type == "response":
            assert body[:-4].endswith(b"\r\n\r\n" + payload)
        else:
            assert body == b"\r\n\r\n"
    assert next(r.url for r in got if r.page_id == 3) == "http://a/%0D%0AX: y"


def test_plain_files_hold_all_records(spark, tmp_path):
    rows = [(n, f"http://x/{n}", f"<p>{'é' * (n % 3 * 60)}\r\n\r\nWARC/1.1\r\n</p>", "", "") for n in range(20)]
    path = fresh_path(spark, "archive")
    warc.write_archive(spark.createDataFrame(rows, PAGES), path)
    archive = warc.read_archive(spark, path)
    warc.export_warc(archive, str(tmp_path / "plain"))
    found = Counter()
    for file in sorted((tmp_path / "plain").glob("part-*")):
        data, at = file.read_bytes(), 0
        while at < len(data):  # records follow each other by their lengths
            head_end = data.index(b"\r\n\r\n", at) + 4
            fields = dict(x.split(": ", 1) for x in data[at:head_end].decode().strip().split("\r\n")[1:])
            stop = head_end + int(fields["Content-Length"]) + 4
            found[data[at:stop]] += 1
            at = stop
    assert found == Counter(bytes(r.record) for r in warc.records(archive).collect())


def test_archive_refuses_a_changed_payload(spark):
    path = fresh_path(spark, "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "p" * 200, "", "")], PAGES), path)
    changed = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"q" * 200))
    other = fresh_path(spark, "archive")
    changed.write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{other}/records")
    with pytest.raises(Exception, match="no sound payload"):
        warc.read_archive(spark, other).collect()


def test_query_rebuilds_records(spark, tmp_path, monkeypatch):
    write = warc.write_archive

    def damaged(pages, path):
        write(pages, f"{path}-whole")
        spark.read.parquet(f"{path}-whole/payloads").write.parquet(f"{path}/payloads")
        heads = spark.read.parquet(f"{path}-whole/records")
        heads.select(F.regexp_replace("head", r"\r\nContent-Length: (\d+)\r\n\r\n", "\r\nContent-Length: 1$1\r\n\r\n").alias("head")).write.parquet(f"{path}/records")

    pages = spark.createDataFrame([(1, "u", "é" * 200), (2, None, "é" * 200), (None, "v", None)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert len(q.QUERIES["op1_warc"](spark, str(tmp_path)).collect()) == 3
    monkeypatch.setattr(warc, "write_archive", damaged)
    with pytest.raises(Exception, match="another length than its head says"):
        q.QUERIES["op1_warc"](spark, str(tmp_path)).collect()


def test_records_have_what_the_format_asks_for(spark):
    rows = [("a1", "u", "x" * 200), ("a>\r\n2 %", "u", "x" * 200), (None, "u", "x" * 200), (None, "u", "y"), ("é", None, "z")]
    path = fresh_path(spark, "archive")
    warc.write_archive(spark.createDataFrame(rows, "page_id string, url string, html string"), path)
    got = warc.checked(warc.records(warc.read_archive(spark, path, "string"))).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter(
        [("a1", "response", None), ("a>\r\n2 %", "revisit", "a1"), (None, "revisit", "a1"), (None, "response", None), ("é", "response", None)]
    )
    names = set()
    for r in got:
        fields = dict(x.split(": ", 1) for x in bytes(r.record).partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        names.add(fields["WARC-Record-ID"])
    assert len(names) == 5 and all(n.startswith("<urn:") for n in names)


def test_empty_archive(spark):
    path = fresh_path(spark, "archive")
    warc.write_archive(spark.createDataFrame([], PAGES), path)
    assert warc.read_archive(spark, path).count() == 0


# --- preference pairs ---

TURNS = "conv_id long, turn long, role string, text string, turns string, opening int"


def test_preferences(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "yes"),
        (2, 0, "user", "q"), (2, 1, "assistant", "no"), (2, 2, "user", None),
        (3, 0, "user", "q"), (3, 1, "assistant", "yes"), (3, 2, "user", "and"), (13, 0, "user", "q"), (13, 1, "assistant", "yes"),
        (4, 0, "user", "alone"), (4, 1, "assistant", "first"), (4, 2, "user", "more"), (4, 3, "assistant", "last"),
        (5, 0, "user", "no answer"),
        (7, 0, "user", "single"), (7, 1, "assistant", "only"),
        (8, 0, "user", "same"), (8, 1, "assistant", "s"), (9, 0, "user", "same"), (9, 1, "assistant", "s"),
        (10, 0, "user", "tied"), (10, 0, "user", "tied"), (10, 1, "assistant", "a"), (10, 1, "assistant", "b"),
        (11, 0, "user", "long"), (11, 1, "assistant", "w " * 50_000), (12, 0, "user", "long"), (12, 1, None, None),
        (6, None, None, None),
        (None, 0, "user", "q"),
    ]
    table = spark.createDataFrame([(*r, "t", 1) for r in rows], TURNS)
    got = {(r.chosen_id, r.rejected_id): r for r in chat.format_preferences(chat.preference_pairs(chat.conversations(table))).collect()}
    assert set(got) == {(1, 2), (1, 3), (4, 4), (10, 10), (11, 12)}  # 13 is as 1, 9 as 8
    assert got[10, 10].n_prompt == 3 and got[11, 12].chosen_spans == "14:100008"
    pair = got[1, 2]
    assert pair.prompt == "<|user|>\nq<|end|>\n" and pair.n_prompt == 1
    assert pair.chosen_completion == "<|assistant|>\nyes<|end|>\n" and pair.chosen_spans == "14:11"
    assert pair.rejected_completion == "<|assistant|>\nno<|end|>\n<|user|>\n<|end|>\n" and pair.rejected_spans == "14:10"
    assert pair.chosen_completion[14 : 14 + 11] == "yes<|end|>\n"
    assert (got[1, 3].n_prompt, got[1, 3].chosen_completion, got[1, 3].rejected_spans) == (2, "", "")
    assert got[4, 4].n_prompt == 3 and "first" in got[4, 4].rejected_completion
    assert chat.format_preferences(chat.preference_pairs(chat.conversations(table.limit(0)))).count() == 0


# --- pieces ---


@pytest.fixture(scope="module")
def model_path():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec(model_path):
    return piece_bpe.Codec(piece_bpe.read_model(model_path))


@pytest.fixture(scope="module")
def library(model_path):
    return sentencepiece.SentencePieceProcessor(model_file=model_path)


@settings(max_examples=600, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aeiothnr  \n▁éß日\x00"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_pieces_as_the_library(codec, library, text):
    want = library.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == want
    assert codec.decode(codec.encode(text)) == library.decode(want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aeiothnr  \n▁éß日\x00"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=30))
def test_arrays_of_texts_as_the_library(codec, library, texts):
    want = [library.encode(t, add_bos=True, add_eos=True) for t in texts]
    ids = codec.encode_array(pa.array(texts, pa.string()))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == want
    assert codec.decode_array(ids).to_pylist() == [library.decode(x) for x in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=12))
def test_decoding_any_ids(codec, library, ids):
    assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_pieces_of_hard_texts(spark, hard, empty, model_path, library):
    model = piece_bpe.PieceModel(spark, model_path)
    run = lambda df: df.select("text", model.encode(F.col("text")).alias("ids")).withColumn("back", model.decode(F.col("ids")))
    for r in run(hard).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.back == library.decode(library.encode(r.text or "", add_bos=True, add_eos=True))
    assert run(empty).count() == 0


# --- mixing ---


def test_targets(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 1000), (None, 0), ("d", 5)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight, limit, total = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {s: 3.0 * n for s, n in sizes}, 2015.0
    settled: dict = {}
    while True:  # share out, stop those above, share out the rest
        free = [s for s, _ in sizes if s not in settled]
        rest = total - sum(settled.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > limit[s]]
        if not above:
            break
        settled |= {s: limit[s] for s in above}
    assert got == pytest.approx(share | settled)


def test_mix_takes_near_its_targets(spark, docs_of):
    texts = [(i, "w " * (i % 13), "en", s) for i in range(900) for s in [["big", "mid", None][min(i % 20, 2)]]]
    rows = docs_of(texts).withColumn("rid", F.monotonically_increasing_id())
    mixed = lambda: [tuple(r) for r in q.mixed(spark, rows, SF_DIR).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()]
    got = mixed()
    assert sorted(got, key=repr) == sorted(mixed(), key=repr) and len(got) == 900
    for source in ("big", "mid", None):
        own = [r for r in got if r[1] == source]
        assert abs(sum(r[6] for r in own) - own[0][4]) <= 12 and all(r[6] <= 3 * r[2] for r in own)
        epochs = int(own[0][4] // own[0][3])
        assert all(r[5] in (epochs, epochs + 1) for r in own)


def test_reruns_agree_however_rows_are_stored(spark, docs_of, tmp_path):
    draw = random.Random(8)
    rows = [(None if i % 3 == 0 else i % 250, "w " * draw.randrange(30) + f"x{i % 400}", "en", draw.choice(["a", "b", None])) for i in range(600)]
    found = []
    for n, order in ((1, 1), (7, 1), (50, -1)):
        docs_of(rows[::order]).repartition(n).write.parquet(str(tmp_path / f"p{n}"))
        docs = spark.read.parquet(str(tmp_path / f"p{n}")).withColumn("rid", F.monotonically_increasing_id())
        taken = q.mixed(spark, docs, SF_DIR).join(docs.select("rid", F.col("text").alias("own")), "rid").select("doc_id", "own", "taken")
        found.append(Counter(map(tuple, taken.collect())))
    assert found[0] == found[1] == found[2]


def test_mix_of_hard_and_empty_tables(spark, hard, empty):
    run = lambda df: q.mixed(spark, df.withColumn("rid", F.monotonically_increasing_id()), SF_DIR)
    rows = run(hard).collect()
    assert len(rows) == len(HARD) and all(r.taken <= 3 * r["size"] for r in rows)
    assert run(empty).count() == 0


# --- SimHash ---


def test_simhash_of_hard_texts(hard, empty):
    found = simhash.near_duplicates(hard.select("doc_id", simhash.fingerprint(F.col("text")).alias("fp"))).collect()
    assert Counter(r.fp & (1 << 64) - 1 for r in found) == Counter(brute_simhash(t) for _, t, *_ in HARD)
    zero = {r.component_id for r in found if r.fp == 0}
    assert zero == {1}  # null, empty and blank texts are linked, whatever their ids
    assert simhash.near_duplicates(empty.select("doc_id", simhash.fingerprint(F.col("text")).alias("fp"))).count() == 0


@pytest.mark.parametrize("flips", [0.05, 0.5])
def test_links_of_any_fingerprints(spark, flips):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {}
    for i in range(400):  # chains of close fingerprints, and bits that go together
        fp = int(base[i % 40])
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            fp ^= 1 << int(b)
        fps[i] = fp | (0xFF << 20 if rng.random() < flips else 0)
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()]
    got = simhash.near_duplicates(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps)


def test_thresholds_suffice():
    rng = np.random.default_rng(1)
    bits = rng.random((500, 64)) < np.linspace(0.05, 0.95, 64)
    for n in (0, 1, 500, 10**6, 10**9, 10**12):
        together = (bits.T.astype(float) @ bits) / 500 * n
        chosen = simhash.plan_probes(n, together)
        assert sum(t + 1 for _, t in chosen) == simhash.DISTANCE + 1
        used = [b for g, _ in chosen for b in g]
        assert len(used) == len(set(used)) and all(t >= 0 for _, t in chosen)
        assert max(t for _, t in chosen) <= 2  # few masks, whatever the number of fingerprints


# --- language ---


def test_language_of_hard_texts(spark, hard, empty, docs_of):
    none = langid.fit(empty.select("lang", "text", F.col("doc_id").alias("key")))
    assert {tuple(r.p) for r in hard.select(langid.predict(spark, none, F.col("text")).alias("p")).collect()} == {("und", 0.0, 0, 0.0)}
    taught = docs_of([(i, t and t * 3, lang, "s") for i in range(20) for t, lang in [("the cat and the dog ", "en"), ("der hund und die katze ", "de"), (None, "xx"), ("lost", None)]])
    model = langid.fit(taught.select("lang", "text", F.col("doc_id").alias("key")))
    assert model.languages == ("de", "en")
    rows = docs_of(["the dog", "die katze und", "12 ² ½ ①", None, "", "der hund " * 200_000]).select("text", langid.predict(spark, model, F.col("text")).alias("p")).collect()
    assert [r.p.lang_pred for r in rows] == ["en", "de", "und", "und", "und", "de"]
    assert all(0.5 <= r.p.score <= 1 for r in rows if r.p.lang_pred != "und")


def test_language_as_a_plain_classifier(spark):
    """Every row of the query against naive Bayes in plain Python, with the n-grams' slots by the same hash."""
    m = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F]

    def slots(text):
        codes = [ord(c) for c in text.lower()]
        for n in (2, 3):
            for i in range(len(codes) - n + 1):
                h = codes[i] * m[0] % 2**32
                for k in range(1, n):
                    h = ((h ^ h >> 15) * m[k] + codes[i + k]) % 2**32
                yield (h ^ h >> 13) * m[n] % 2**32 >> 16

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    taught = [r for r in docs if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    counts, shares = {}, Counter(r.lang for r in taught)
    for r in taught:
        counts.setdefault(r.lang, Counter()).update(slots(r.text))
    totals = {lang: sum(c.values()) + 0.5 * 65536 for lang, c in counts.items()}
    got = {r.doc_id: r for r in q.QUERIES["op6_langid"](spark, SF_DIR).collect()}
    for r in docs:
        if r.text is None or not any(unicodedata.category(c)[0] == "L" for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        own = Counter(slots(r.text))
        joint = {lang: math.log(shares[lang] / len(taught)) + sum(n * math.log((c[s] + 0.5) / totals[lang]) for s, n in own.items()) for lang, c in counts.items()}
        best = max(sorted(joint), key=joint.get)
        assert got[r.doc_id].lang_pred == best
        assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(max(x - joint[best], -700)) for x in joint.values()), abs=1e-3)


def test_short_texts_stay_and_junk_goes(spark, docs_of):
    """Clean texts of any length are of a known language; letters at random and a language not learned are not."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = q.language_model(docs)
    draw = random.Random(3)
    letters = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") + " " * (draw.random() < 0.2) for _ in range(3000))
    other = "ζωή και θάνατος στην αρχαία πόλη " * 40
    clean = [r.text for r in docs.filter("text IS NOT NULL AND lang IS NOT NULL").limit(80).collect() if langid.has_letter(r.text)]
    heads = [" ".join(t.split()[:n]) for t in clean[:40] for n in (1, 2, 5, 20)]
    rows = docs_of([*clean, *[h for h in heads if langid.has_letter(h)], letters, other, "12 34"])
    found = rows.select("text", langid.is_known(langid.predict(spark, model, F.col("text"))).alias("known")).collect()
    refused = {r.text for r in found if not r.known}
    assert refused == {letters, other, "12 34"}


def test_sample_of_rows_without_id_and_of_copies(spark):
    rows = [("en", f"document {i:04d}", None) for i in range(600)] + [("de", "hund", 5)] * 300 + [("de", f"katze {i}", i) for i in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string, key long"), 100)
    assert model.languages == ("de", "en")
    # the smallest probability, that of an empty slot, tells how many n-grams were counted
    de, en = langid.SMOOTHING / np.exp(model.log_ngrams.min(axis=0).astype(float)) - langid.SMOOTHING * langid.SLOTS
    assert 50 < en / (2 * len("document 0000") - 3) < 160
    assert round(de) == sum(2 * len(text) - 3 for lang, text, _ in rows if lang == "de")


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(0)
    model = langid.LanguageModel(("a", "b"), rng.standard_normal((langid.SLOTS, 2)).astype(np.float32), np.zeros(2))
    texts = [LONG, "ab", "", "a", PROSE]
    together = model.score(texts)
    langid_step, langid.STEP = langid.STEP, 1000
    try:
        assert np.allclose(together, np.concatenate([model.score([t]) for t in texts]), rtol=1e-6)
    finally:
        langid.STEP = langid_step


# --- nearest neighbours ---


def test_nearest_of_hard_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [3.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (9, []), (2, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "dim": F.lit(2)})
    usable = ann.usable(table)
    got = sorted(tuple(r) for r in ann.nearest(usable.filter("vec_id % 50 = 0"), usable, 2).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0)]
    assert ann.nearest(usable.limit(0), usable.limit(0), 2).count() == 0


def test_vectors_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 1.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0])]
    usable = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.nearest(usable.filter("vec_id = 0"), usable, 5).collect()
    one, other = [(0, 1, 0, 1.0), (0, 2, 0, 0.707), (0, 3, 1, 0.0)], [(0, 1, 0, 0.707), (0, 2, 0, 0.707), (0, 3, 1, 0.707)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 3)) for r in got) == sorted(one + one + other)


def test_every_row_is_a_candidate(spark):
    """63 rows, three of them exact repeats: each query meets 62."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(60)]
    usable = ann.usable(spark.createDataFrame(rows + [rows[0], rows[0], rows[7]], "vec_id long, embedding array<double>"))
    got = Counter(r.query_id for r in ann.nearest(usable.filter("vec_id % 50 = 0"), usable, 100).collect())
    assert got == {0: 3 * 62, 50: 62}


def test_shards_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 64)
    rng = np.random.default_rng(2)
    same = rng.standard_normal(8).tolist()
    rows = [(i, same if i % 3 == 0 else rng.standard_normal(8).tolist()) for i in range(300)]
    usable = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got: dict[int, list] = {}
    for r in ann.nearest(usable.filter("vec_id % 50 = 0"), usable, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert [v for _, v in sorted(got[0])] == [3, 6, 9, 12, 15] and [v for _, v in sorted(got[150])] == [0, 3, 6, 9, 12]


# --- fingerprints ---


def test_fingerprints_of_hard_texts(hard, empty, docs_of):
    rows = minhash.edited_pairs(hard).collect()
    assert len(rows) == len(HARD)
    got = [r for r in rows if r.doc_id is not None]
    after = {8: HARD[10][1], 7: HARD[9][1], 4: LONG, 3: "word", 2: ""}
    for r in got:
        if r.doc_id in after:
            text = {i: t for i, t, *_ in HARD if i is not None}[r.doc_id]
            third = len(text) // 3
            assert r.edited == text[: len(text) - third] + after[r.doc_id][:third]
    assert all(r.fingerprint == [] for r in got if r.doc_id in (1, 5)) and all(len(r.fingerprint) == 16 for r in got if r.doc_id in (2, 3))
    assert minhash.edited_pairs(empty).count() == 0
    alone = minhash.edited_pairs(docs_of([(5, "abcdef", "en", "s")])).collect()
    assert alone[0].edited == "abcdab" and alone[0].next_fingerprint == alone[0].fingerprint


def test_next_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(minhash, "STRETCH", 7)
    ids = [None] * 40 + list(range(0, 500, 3)) + [1 << 60, -(1 << 60)]
    rows = [(i, 1000 + k if i is None else 0, f"t{k}") for k, i in enumerate(ids)]
    rows = [(i, (t * 0x9E3779B97F4A7C15) % (1 << 63) * (-1) ** t if t else 0, x) for i, t, x in rows]
    random.shuffle(rows)
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -r[1]))
    got = {r.text: r.next_text for r in minhash.next_of(minhash.stretched(spark.createDataFrame(rows, "doc_id long, tie long, text string")), ["text"]).collect()}
    assert got == {r[2]: want[(k + 1) % len(want)][2] for k, r in enumerate(want)}


@pytest.mark.parametrize("kind,make", [("string", lambda k: f"doc-{'é' * (k % 3)}{k * 7919 % 1201}"), ("decimal(9,1)", lambda k: decimal.Decimal(k) - 600), ("smallint", int), ("double", lambda k: k / 3 - 100)])
def test_next_with_other_ids(spark, kind, make):
    """More rows than a stretch holds; text ids are cut by the bytes after those that all share."""
    rows = [(make(k), k, f"t{k}") for k in range(1200)]
    random.shuffle(rows)
    cut = minhash.stretched(spark.createDataFrame(rows, f"doc_id {kind}, tie long, text string"))
    assert cut.select("stretch").distinct().count() > 1
    got = {r.text: r.next_text for r in minhash.next_of(cut, ["text"]).collect()}
    want = sorted(rows, key=lambda r: (r[0].encode() if kind == "string" else r[0], r[1]), reverse=True)
    assert got == {r[2]: want[(k + 1) % len(want)][2] for k, r in enumerate(want)}


def test_likeness_of_short_and_long_texts(spark):
    rng = random.Random(4)
    texts = []
    for n in (1, 2, 5, 6, 8, 12, 30, 80, 200, 600, 3000):
        words = [f"{rng.random():.6f}" for _ in range(n)]
        texts.append((" ".join(words), " ".join(words[: n * 9 // 10] + ["x", "y"])))
        texts.append((" ".join(words), " ".join(f"{rng.random():.6f}" for _ in range(n))))
    df = minhash.with_fingerprint(minhash.with_fingerprint(spark.createDataFrame(texts, "a string, b string"), F.col("a"), "fa"), F.col("b"), "fb")
    for r in df.withColumn("near", minhash.likeness(F.col("fa"), F.col("fb"))).collect():
        assert abs(r.near - jaccard(shingles(r.a), shingles(r.b))) < 0.15


# --- lines ---


def test_lines_of_hard_texts(hard, empty):
    rows = linededup.remove_repeated_lines(hard).collect()
    assert len(rows) == len(HARD) and all(r.row["odd.name"] == 1 for r in rows)
    by_id = {r.row.doc_id: r for r in rows}
    assert by_id[7].kept == "x\n\n\n\ny\nz" and (by_id[7].n_lines, by_id[7].n_removed) == (12, 6)
    assert by_id[5].kept == HARD[8][1] and by_id[5].n_removed == 0
    assert [(r.kept, r.n_lines, r.n_removed) for r in rows if r.row.text is None] == [(None, 0, 0)]
    assert linededup.remove_repeated_lines(empty).count() == 0


def test_lines_do_not_depend_on_how_rows_are_stored(spark, docs_of, tmp_path):
    passage = "one line\nanother line\na third line\n"
    rows = [(None if i % 4 else i % 3, f"{passage}own {i}\nown too\n" + passage * (i % 2), "en", "s") for i in range(40)]
    found = []
    for n, order in ((1, 1), (7, 1), (13, -1)):
        docs_of(rows[::order]).repartition(n).write.parquet(str(tmp_path / f"p{n}"))
        done = linededup.remove_repeated_lines(spark.read.parquet(str(tmp_path / f"p{n}")))
        found.append(Counter(map(tuple, done.select("row.doc_id", "row.text", "kept").collect())))
    assert found[0] == found[1] == found[2]


def test_one_copy_of_repeated_rows_stays(docs_of):
    text = "one\ntwo\nthree\nfour"
    rows = [(None, text, "en", "s")] * 3 + [(4, text, "en", "s"), (2, "zero\n" + text, "en", "s"), (2, "zero\n" + text, "en", "s")]
    got = Counter((r.row.doc_id, r.kept) for r in linededup.remove_repeated_lines(docs_of(rows)).collect())
    assert got == {(2, "zero\n" + text): 1, (2, ""): 1, (4, ""): 1, (None, ""): 3}


# --- repeats ---


def _check_repeats(df, texts):
    want = brute_repeats(dict(enumerate(texts)))
    got = {r.key: r for r in prefixfree.remove_repeats(df).collect()}
    assert len(got) == len(texts)
    for i, (gone, data) in want.items():
        assert got[i].n_bytes == len(data) and got[i].n_removed == gone.sum(), i
        assert bytes(got[i].kept) == bytes(np.frombuffer(data, np.uint8)[~gone])
        covered = np.zeros(len(data), bool)
        for s in got[i].spans:
            covered[s.start : s.stop] = True
        assert (covered == gone).all()


def _repeat_cases():
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, edge = prose(700), prose(200)
    return [
        None, "", "short", "a" * 199, "b" * 200, "c" * 201, "ab" * 300, prose(199),
        prose(500) + shared + prose(300), shared[100:450] + prose(50), prose(30) + shared[350:], "é" * 150,
        edge, prose(10) + edge, edge[1:] + "x", edge[:199], prose(2000), " ".join([prose(250)] * 3), prose(5000),
    ]


def test_repeats_of_hard_texts(docs_of, empty):
    texts = _repeat_cases()
    _check_repeats(docs_of(texts), texts)
    assert prefixfree.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("tile", [64, 257, 1000])
def test_repeats_over_tiles(tile, monkeypatch):
    """Chunk by chunk without Spark: small tiles find the same strings."""
    monkeypatch.setattr(prefixfree, "TILE", tile)
    data = [(t or "").encode() for t in _repeat_cases()]
    chunk = prefixfree.Chunk(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]))
    buckets = 64
    windows = pa.Table.from_batches(list(prefixfree._emit_windows(buckets)(iter([_as_row(chunk)]))))
    bits = _by_bucket(prefixfree._count_windows, windows)
    cells = pa.Table.from_batches(list(prefixfree._emit_cells(buckets)(iter([_as_row(chunk, windows=bits)]))))
    gone = prefixfree._covered(chunk, bits, _by_bucket(prefixfree._count_strings, cells), buckets)
    want = np.concatenate([g for g, _ in brute_repeats(dict(enumerate(_repeat_cases()))).values()])
    assert (gone == want).all()


def _as_row(chunk, **more):
    import zstandard

    sizes = np.diff(np.concatenate([[0], chunk.ends])).tolist()
    row = {"chunk": [1], "lengths": [sizes], "data": [zstandard.compress(chunk.data.tobytes())]} | {k: [v] for k, v in more.items()}
    return pa.RecordBatch.from_pydict(row)


def _by_bucket(count, rows):
    out = []
    for b in sorted(set(rows["bucket"].to_pylist())):
        part = count(rows.filter(pa.compute.equal(rows["bucket"], b)))
        out += [{"bucket": x["bucket"], "bits": x["bits"]} for x in part.to_pylist()]
    return out


@pytest.mark.parametrize("kind,make", [("smallint", int), ("decimal(9,2)", decimal.Decimal), ("date", lambda k: datetime.date(2024, 1, 1 + k))])
def test_repeats_with_other_ids(spark, kind, make):
    rows = [(make(k), f"{k} " + "passage " * 40) for k in range(4)]
    done = prefixfree.remove_repeats(spark.createDataFrame(rows, f"doc_id {kind}, text string")).select("key", "n_removed").collect()
    assert {r.key for r in done} == {make(k) for k in range(4)} and all(r.n_removed >= 200 for r in done)


def test_repeated_keys_are_rows_of_their_own(docs_of):
    rows = prefixfree.remove_repeats(docs_of([(1, "k" * 300, "en", "s"), (1, "k" * 300, "en", "s"), (None, None, "en", "s")])).collect()
    assert sorted((r.key or 0, r.n_bytes, r.n_removed) for r in rows) == [(0, 0, 0), (1, 300, 300), (1, 300, 300)]


# --- pipeline ---


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_hard_and_empty_tables(spark, hard, empty, name, stage):
    rows = stage(spark, hard, SF_DIR)
    found = rows.collect()
    assert stage(spark, empty, SF_DIR).count() == 0
    if name != "sentencepiece":
        assert rows.columns == hard.columns
    if name == "language_id":
        assert not {r.doc_id for r in found} & {1, 5, 6}
    if name == "line_dedup":
        assert any(r.text is None for r in found)
    if name == "simhash_near_dedup":
        assert sum(r.text is None or not r.text.strip() for r in found) == 1
    if name == "sentencepiece":
        assert len(found) == len(HARD)


def test_rows_that_differ_in_a_map_alone(spark):
    """Each is a row of its own for the stages that tell rows apart by their content."""
    rows = [(1, "a b c d", "s", {"x": 1}), (1, "a b c d", "s", {"x": 2}), (1, "a b c d", "s", None), (1, "a b c d", "s", {"x": 1})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>")
    assert identified(docs).select("same").distinct().count() == 3
    mixed = corpus_pipeline.mix_sources(spark, docs.withColumn("lang", F.lit("en")), SF_DIR)
    assert Counter(str(r.m) for r in mixed.collect()) == Counter(str(r[3]) for r in rows)
