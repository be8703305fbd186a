"""The registered queries of these operators, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.llm import ann, chat, importance, langid, linededup, minhash, mixing, piece_bpe, prefixfree, simhash, spelling, subtrees, warc
from regionflow.llm.common import col, small_batches, words_in
from regionflow.operators.skew import stored
from regionflow.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    "op1_warc",
    """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS g FROM pages),
f AS (SELECT g, min(page_id) AS m FROM p GROUP BY g)
SELECT page_id, n AS payload_bytes, p.g AS payload_digest,
       CASE WHEN n < 100 OR page_id IS NOT DISTINCT FROM m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < 100 OR page_id IS NOT DISTINCT FROM m THEN NULL ELSE m END AS refers_to
FROM p JOIN f ON p.g = f.g
""",
)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = fresh_path(spark, "warc"), _table(spark, sf_dir, "pages")
    warc.write_archive(pages, path)
    archive = warc.checked(warc.records(warc.read_archive(spark, path, pages.schema["page_id"].dataType.simpleString())))
    return archive.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SPANS = """coalesce(string_agg(CASE WHEN role = 'assistant'
    THEN (coalesce(before, 0) + length(head))::VARCHAR || ':' || length(body)::VARCHAR END, ',' ORDER BY i), '')"""


@_query(
    "op2_chat_preferences",
    f"""
WITH t AS (SELECT conv_id, role, text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, sha256(coalesce('=' || role, '-') || chr(10) || coalesce('=' || text, '-')) AS opening FROM t WHERE i = 1),
g AS (SELECT opening, min(conv_id) AS chosen_id, count(*) AS n FROM o GROUP BY opening),
a AS (SELECT conv_id, arg_min(text, i) AS stale, max(i) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
pairs AS (SELECT chosen_id, conv_id AS rejected_id FROM o JOIN g USING (opening) WHERE n > 1 AND conv_id <> chosen_id
          UNION ALL SELECT chosen_id, chosen_id FROM g JOIN a ON a.conv_id = chosen_id WHERE n = 1),
sides AS (SELECT chosen_id, rejected_id, 'chosen' AS side, i, role, text FROM pairs JOIN t ON t.conv_id = chosen_id
          UNION ALL
          SELECT chosen_id, rejected_id, 'rejected', i, role,
                 CASE WHEN chosen_id = rejected_id AND i = last THEN stale ELSE text END
          FROM pairs JOIN t ON t.conv_id = rejected_id LEFT JOIN a ON a.conv_id = rejected_id),
both_ AS (SELECT chosen_id, rejected_id, i,
                 count(*) = 2 AND count(DISTINCT coalesce('=' || role, '-') || chr(10) || coalesce('=' || text, '-')) = 1 AS same
          FROM sides GROUP BY ALL),
cut AS (SELECT chosen_id, rejected_id, min(i) FILTER (NOT same) - 1 AS n FROM both_ GROUP BY ALL HAVING NOT bool_and(same)),
r AS (SELECT *, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) AS head,
             coalesce(text, '') || '<|end|>' || chr(10) AS body FROM sides JOIN cut USING (chosen_id, rejected_id)),
rest AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY chosen_id, rejected_id, side ORDER BY i
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS before FROM r WHERE i > n),
done AS (SELECT chosen_id, rejected_id, side, string_agg(head || body, '' ORDER BY i) AS completion, {_SPANS} AS spans
         FROM rest GROUP BY ALL),
prompts AS (SELECT chosen_id, rejected_id, any_value(n)::INTEGER AS n_prompt,
                   coalesce(string_agg(head || body, '' ORDER BY i) FILTER (i <= n), '') AS prompt
            FROM r WHERE side = 'chosen' GROUP BY ALL)
SELECT p.chosen_id, p.rejected_id, n_prompt, prompt,
       coalesce(c.completion, '') AS chosen_completion, coalesce(c.spans, '') AS chosen_spans,
       coalesce(j.completion, '') AS rejected_completion, coalesce(j.spans, '') AS rejected_spans
FROM prompts p
LEFT JOIN done c ON c.chosen_id = p.chosen_id AND c.rejected_id = p.rejected_id AND c.side = 'chosen'
LEFT JOIN done j ON j.chosen_id = p.chosen_id AND j.rejected_id = p.rejected_id AND j.side = 'rejected'
""",
)
def op2_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = chat.conversations(_table(spark, sf_dir, "conversations"))
    return chat.format_preferences(chat.preference_pairs(convs))


SEED = 17


def mixed(spark: SparkSession, rows: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, text, rid) mixed as the contract says, without the text.

    Quality: documents labelled good weigh 2, bad 0.5, others 1. A row's place
    follows from its id and text alone, so reruns agree however the rows are stored;
    `rid` only tells apart rows that are equal in both.
    """
    labels = (
        _table(spark, sf_dir, "labels")
        .filter("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    quality = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    own = F.struct("doc_id", F.md5("text").alias("text"), "rid")
    key = -F.log(mixing.uniform(SEED, F.col("rid.doc_id"), F.col("rid.text"))) / quality
    sized = rows.select("doc_id", "source", words_in(F.col("text")).alias("size"), own.alias("rid"))
    mix = mixing.mix(sized.join(labels, "doc_id", "left").withColumn("key", key).drop("quality"))
    return mix.withColumn("rid", F.col("rid.rid"))


@_query(
    "op4_mixing",
    r"""
WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(text) AS h,
        -ln((('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
          / CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
      FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             source_size * 3.0::DOUBLE AS lim FROM s),
lv AS (SELECT *, row_number() OVER (ORDER BY lim / w, source NULLS LAST) AS pos,
         ((SELECT sum(source_size) FROM s)::DOUBLE
           - coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
       FROM w),
t AS (SELECT source, source_size, least(lim, (SELECT arg_min(level, pos) FROM lv WHERE level <= lim / w) * w) AS target FROM lv),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT doc_id, size, source_size, target, epochs,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, h NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
""",
)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").withColumn("rid", F.monotonically_increasing_id())
    return mixed(spark, rows, sf_dir).select("doc_id", "size", "source_size", "target", "taken")


@_query(
    "op9_line_dedup",
    r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, substr(md5(text), 1, 15)) AS r, doc_id, text,
             string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT r, i AS pos, lines[i] AS a, lines[i + 1] AS b, lines[i + 2] AS c
      FROM (SELECT r, lines, unnest(generate_series(1, len(lines) - 2)) AS i FROM d)),
s AS (SELECT * FROM w WHERE regexp_matches(a || b || c, '[^\x20\x09-\x0D]')),
f AS (SELECT a, b, c, min((r, pos)) AS first FROM s GROUP BY a, b, c HAVING count(*) > 1),
marks AS (SELECT DISTINCT r, pos + k AS pos
          FROM (SELECT s.r, s.pos FROM s JOIN f ON s.a = f.a AND s.b = f.b AND s.c = f.c WHERE (s.r, s.pos) <> f.first),
               (SELECT unnest([0, 1, 2]) AS k)),
l AS (SELECT r, i AS pos, lines[i] AS line FROM (SELECT r, lines, unnest(generate_series(1, len(lines))) AS i FROM d)),
k AS (SELECT l.r, string_agg(line, chr(10) ORDER BY l.pos) AS kept, count(*) AS n
      FROM l LEFT JOIN marks m ON m.r = l.r AND m.pos = l.pos WHERE m.pos IS NULL GROUP BY l.r)
SELECT d.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(n, 0))::BIGINT AS n_removed,
       CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(kept, '')) END AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r
""",
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.remove_repeated_lines(_table(spark, sf_dir, "documents"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def piece_model(spark: SparkSession, path: str | None = None) -> piece_bpe.PieceModel:
    """The model of the contract, or another model file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_bpe.PieceModel(spark, path)


@_query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_model(spark)
    encoded = _table(spark, sf_dir, "documents").select("doc_id", model.encode(F.col("text")).alias("ids"))
    return encoded.select(
        "doc_id",
        piece_bpe.n_ids(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(model.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )


@_query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", simhash.fingerprint(F.col("text")).alias("fp"))
    found = simhash.near_duplicates(stored(docs, "simhash"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def language_model(docs: DataFrame) -> langid.LanguageModel:
    """Learnt from the documents of `docs` that are not held out."""
    taught = docs.filter(F.coalesce(~held_out(col("doc_id")), F.lit(True)))
    return langid.fit(taught.select(col("lang").alias("lang"), col("text").alias("text"), col("doc_id").alias("key")))


@_query("op6_langid")
def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = docs.select("doc_id", langid.predict(spark, language_model(docs), F.col("text")).alias("p"))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "p.lang_pred", "p.score")


@_query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = minhash.edited_pairs(_table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        minhash.as_hex(F.col("fingerprint")).alias("fingerprint"),
        minhash.as_hex(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        minhash.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        minhash.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


@_query("op7_nearest")
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(_table(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors.filter("vec_id % 50 = 0"), vectors, 5)


@_query("op10_repeats")
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = prefixfree.remove_repeats(_table(spark, sf_dir, "documents"))
    return done.select(
        F.col("key").alias("doc_id"),
        "n_bytes",
        "n_removed",
        prefixfree.n_spans(F.col("spans")).alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: CTE `crc_table`: the register after each byte, from an empty one.
_CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS tab
  FROM (SELECT i, list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                              lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS v
        FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    """SQL for the unsigned CRC-32 of a string's UTF-8 bytes; needs `crc_table`."""
    octets = f"list_transform(range(strlen({text})), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce({octets}, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::BIGINT))"


def _features_sql(table: str, name: str) -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""{name}_words AS (
  SELECT row_number() OVER () AS r, * FROM (
    SELECT *, coalesce(regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM {table})),
{name}_features AS (
  SELECT r, unnest(list_concat(w, list_concat(
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS f FROM {name}_words)"""


@_query(
    "op13_importance",
    f"""
WITH {_CRC_TABLE},
{_features_sql("documents", "d")},
{_features_sql("benchmark", "b")},
buckets AS (SELECT f, {_crc("f")} % 10000 AS bucket FROM (SELECT f FROM d_features UNION SELECT f FROM b_features), crc_table),
d AS (SELECT r, bucket FROM d_features JOIN buckets USING (f)),
s AS (SELECT bucket, count(*) AS s FROM d GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b_features JOIN buckets USING (f) GROUP BY bucket),
gains AS (SELECT s.bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE)
            / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM d JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5)
               / 4294967296.0::DOUBLE)))::BIGINT AS score
           FROM d_words LEFT JOIN weights USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
             floor(5 * count(*) FILTER (n_words >= 20) OVER () / 100) AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= most THEN place END AS rank FROM placed
""",
)
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


@_query(
    "op11_spelling",
    f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
named AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS name, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {_crc("name")} AS h FROM named, crc_table),
cut AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word
        FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
open_ AS (SELECT word, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS k FROM places),
less AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM places),
near AS (SELECT a.word, b.word AS other FROM open_ a JOIN open_ b ON a.k = b.k AND a.word <> b.word
         UNION SELECT less.word, words.word FROM less JOIN words ON words.word = k
         UNION SELECT words.word, less.word FROM less JOIN words ON words.word = k),
best AS (SELECT near.word, count(*) AS n_near, min((-w.n, other)) AS best FROM near JOIN words w ON w.word = other GROUP BY near.word),
found AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near,
            CASE WHEN -(best[1]) >= 10 * n THEN best[2] END AS form, CASE WHEN -(best[1]) >= 10 * n THEN -(best[1]) END AS form_n
          FROM words LEFT JOIN best USING (word)),
up AS (SELECT word, form AS root FROM found WHERE form IS NOT NULL
       UNION ALL SELECT up.word, found.form FROM up JOIN found ON found.word = up.root WHERE found.form IS NOT NULL),
tops AS (SELECT up.word, up.root FROM up JOIN found ON found.word = up.root WHERE found.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n::BIGINT AS form_n FROM found LEFT JOIN tops USING (word)
""",
)
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted(spelling.corpus_words(_table(spark, sf_dir, "documents"))))


@_query(
    "op12_substrings",
    r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(50)) AS i FROM s JOIN f USING (g) WHERE doc_id > least),
k AS (SELECT l.doc_id, string_agg(word, ' ' ORDER BY l.i) AS kept, count(*) AS n
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) l
      LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i WHERE gone.i IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
""",
)
def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = subtrees.remove_repeats(_table(spark, sf_dir, "documents"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
