"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow.llm.common import give_back, small_batches

#: Hash slots of the model, lengths of the n-grams, added to every count, documents to fit on for each language.
SLOTS, NGRAMS, SMOOTHING, FIT_DOCS = 1 << 16, (2, 3), 0.5, 5000
#: A model holds SLOTS numbers a language; beyond so many languages it is refused.
MOST_LANGUAGES = 500
UNKNOWN = "und"
#: A text is in no learned language if its n-grams are so many spreads less likely than that language's own, on
#: average; a short text, whose average says less, may fall short by ROOM over the root of its n-grams besides.
LEVEL, ROOM = 1.5, 45.0
#: Tasks that count the sample, and what they return.
FIT_TASKS, COUNTS = 16, "lang string, counts binary"
#: Characters looked at in one go.
STEP = 1 << 18

_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _slots(codes: np.ndarray, n: int) -> np.ndarray:
    """The slot of each run of n characters."""
    mixed = codes[: len(codes) - n + 1] * _MULTIPLIERS[0]
    for k in range(1, n):
        mixed = (mixed ^ (mixed >> np.uint32(15))) * _MULTIPLIERS[k] + codes[k : len(codes) - n + 1 + k]
    mixed = (mixed ^ (mixed >> np.uint32(13))) * _MULTIPLIERS[n]
    return mixed >> np.uint32(32 - (SLOTS.bit_length() - 1))


def _pieces(codes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Stretches of a text that overlap so that each run of n characters is in one of them."""
    for start in range(0, max(len(codes) - n + 1, 0), STEP):
        yield codes[start : start + STEP + n - 1]


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities: (slots, languages) of n-grams and (languages,) of languages.

    `mean` and `spread` are those of a language's n-grams in its own texts.
    """

    languages: tuple[str, ...]
    log_ngrams: np.ndarray
    log_prior: np.ndarray
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def score(self, texts: list[str]) -> np.ndarray:
        """The log joint probability of each text and language."""
        total = np.tile(self.log_prior, (len(texts), 1))
        slots, owner, held = [], [], 0
        for i, text in enumerate(texts):
            codes = _codes(text)
            for n in NGRAMS:
                for piece in _pieces(codes, n):
                    slots.append(_slots(piece, n))
                    owner.append(i)
                    held += len(piece)
                    if held >= STEP:
                        self._add(total, slots, owner)
                        slots, owner, held = [], [], 0
        self._add(total, slots, owner)
        return total

    def _add(self, total: np.ndarray, slots: list[np.ndarray], owner: list[int]) -> None:
        if slots:
            starts = np.cumsum([0, *map(len, slots[:-1])])
            sums = np.add.reduceat(self.log_ngrams[np.concatenate(slots)], starts, axis=0, dtype=np.float64)
            np.add.at(total, owner, sums)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text, copies) to (lang, slot counts as bytes), one row per language and task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text, copies in zip(*(batch[c].to_pylist() for c in ("lang", "text", "copies")), strict=True):
            own = counts.setdefault(lang, np.zeros(SLOTS, np.int64))
            codes = _codes(text)
            for n in NGRAMS:
                for piece in _pieces(codes, n):
                    own += copies * np.bincount(_slots(piece, n), minlength=SLOTS)
    if counts:
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(counts, pa.string()), "counts": pa.array([c.tobytes() for c in counts.values()], pa.binary())}
        )


def fit(rows: DataFrame, per_language: int = FIT_DOCS) -> LanguageModel:
    """Learns from (lang, text, key); rows without language or text teach nothing.

    The n-gram counts are taken from whole texts of about `per_language` different
    documents a language, those with the smallest hash of `key` and text; that
    bounds the work of fitting and nothing else. Equal rows are drawn together and
    read once, with their number. The languages' shares come from all rows.
    """
    taught = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    place = F.xxhash64(F.col("key"), F.col("text"))
    sizes = taught.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(place).alias("different"))
    found = sizes.limit(MOST_LANGUAGES + 1).collect()
    shares = {r["lang"]: r["n"] for r in found}
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not shares:
        return LanguageModel((), np.zeros((SLOTS, 0), np.float32), np.zeros(0))
    drawn = (F.shiftrightunsigned(place, 11) / F.lit(float(2**53))).alias("u")
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, per_language / min(r["n"], r["different"])))])
    sample = _sample(taught.filter(drawn < F.element_at(share, F.col("lang"))))
    # the sample is small, so few tasks count it and give one row a language
    counted = sample.mapInArrow(_count, COUNTS).groupBy("lang").applyInArrow(_add_up, COUNTS)
    totals = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in counted.collect()}
    languages = tuple(sorted(totals))
    smoothed = np.stack([totals[lang] for lang in languages], axis=1) + SMOOTHING
    prior = np.array([shares[lang] for lang in languages], float)
    log_ngrams = np.log(smoothed / smoothed.sum(axis=0))
    own = (smoothed - SMOOTHING) / np.maximum((smoothed - SMOOTHING).sum(axis=0), 1)
    mean = (own * log_ngrams).sum(axis=0)
    spread = np.sqrt(np.maximum((own * log_ngrams**2).sum(axis=0) - mean**2, 1e-12))
    return LanguageModel(languages, log_ngrams.astype(np.float32), np.log(prior / prior.sum()), mean, spread)


def _sample(drawn: DataFrame) -> DataFrame:
    """(lang, text, copies) of the rows drawn, dealt out without a key, as many rows may share one."""
    each = drawn.groupBy("lang", "key", "text").agg(F.count("*").alias("copies"))
    return each.select("lang", "text", "copies").repartition(FIT_TASKS)


def _add_up(counts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_buffer(), np.int64) for c in counts["counts"])
    return pa.table({"lang": counts["lang"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def predict(spark, model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score, n_grams, fit): the likeliest language of the whole text and its probability.

    `fit` is how far the mean log probability of the text's n-grams lies above (or
    below: negative) that of the language's own, in spreads of these; unlike the score it
    does not run to 1 with length. `und` with zeros for a null text, a text without
    letters, and a model without languages. Equal probabilities go to the first language by name.
    """
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # SLOTS x languages, both bounded

    @F.arrow_udf("lang_pred string, score double, n_grams long, fit double")
    def run(texts: pa.Array) -> pa.Array:
        found = _predict(held.value, texts)
        give_back()
        return found

    return run(text)


def _predict(model: LanguageModel, texts: pa.Array) -> pa.Array:
    langs: list[str] = [UNKNOWN] * len(texts)
    scores, fits, sizes = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for start in range(0, len(texts), 256):
        part = texts[start : start + 256].to_pylist()
        known = [i for i, t in enumerate(part) if model.languages and has_letter(t)]
        if known:
            joint = model.score([part[i] for i in known])
            best = joint.argmax(axis=1)
            top = joint[np.arange(len(best)), best]
            share = 1.0 / np.exp(joint - top[:, None]).sum(axis=1)
            at = start + np.array(known)
            size = [len(_codes(part[i])) for i in known]
            sizes[at] = [sum(max(n - k + 1, 0) for k in NGRAMS) for n in size]
            scores[at] = share
            if model.mean is not None:
                own = (top - model.log_prior[best]) / np.maximum(sizes[at], 1)
                fits[at] = np.where(sizes[at] > 0, (own - model.mean[best]) / model.spread[best], 0.0)
            for i, b in zip(at.tolist(), best, strict=True):
                langs[i] = model.languages[b]
    columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes), pa.array(fits, pa.float64())]
    return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "n_grams", "fit"])


def is_known(found: Column) -> Column:
    """Whether a prediction stands: the text has letters and is about as likely as texts of the language are."""
    short = F.lit(ROOM) / F.sqrt(F.greatest(found["n_grams"], F.lit(1)).cast("double"))
    return (found["lang_pred"] != UNKNOWN) & (found["fit"] >= -(F.lit(LEVEL) + short))
