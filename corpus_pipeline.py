"""From raw documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one
before it kept; `run` writes each result as Parquet and reads it again. Further
columns of the documents are carried along; the last stage returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.llm import langid, linededup, piece_bpe, queries, simhash
from regionflow.llm.common import col, identified, small_batches
from regionflow.operators.skew import stored
from regionflow.session import fresh_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known: those without letters or in no learned language go, short ones stay."""
    model = queries.language_model(docs)
    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), langid.predict(spark, model, col("text")).alias("found"))
    return packed.filter(langid.is_known(F.col("found"))).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated three-line passages out of the texts; a document of which no word is left goes."""
    done = linededup.remove_repeated_lines(docs)
    left = done.filter("n_removed = 0 OR kept RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.char_length("kept").cast("long"))}
    return left.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one of the smallest id (null last)."""
    small_batches(spark)
    rows = identified(docs)
    slim = rows.select(F.col("row.doc_id").alias("doc_id"), "same", simhash.fingerprint(F.col("row.text")).alias("fp"))
    found = simhash.near_duplicates(stored(slim, "near"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same"))
    kept = found.groupBy("root").agg(first.alias("first")).select(F.col("first.same").alias("same"))
    return rows.join(kept, "same", "left_semi").dropDuplicates(["same"]).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; one that it does not take goes.

    Equal rows are mixed one by one and come back as that many copies of one.
    """
    rows = identified(docs)
    slim = rows.select(*[F.col("row")[c].alias(c) for c in ("doc_id", "source", "text")], F.col("same").alias("rid"))
    taken = queries.mixed(spark, slim, sf_dir).groupBy("rid").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    once = rows.dropDuplicates(["same"]).join(taken, F.col("same") == F.col("rid"))
    return once.select("row", each.alias("copy")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): the packed token ids of every text, and what they decode to."""
    model = queries.piece_model(spark)
    ids = docs.select("doc_id", model.encode(col("text")).alias("ids"))
    return ids.select(
        "doc_id",
        piece_bpe.n_ids(F.col("ids")).alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(model.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: XXH64, the classifier and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
