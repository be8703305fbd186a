"""A content-addressed web archive: payloads once by digest, record heads apart.

An archive is a folder of two Parquet tables:

* `payloads` (digest, payload): each distinct payload once, by its SHA-256;
* `records` (head): the exact head of every record, that is its WARC header and,
  for a response, the HTTP header that goes before the payload.

A record is its head, its payload if it is a response, and two line ends. The
payload is found by the digest in the head, so records are rebuilt by one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.llm.common import col

END = "\r\n"
LEAST_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """One header line; empty if there is no value. Line ends in the value are escaped."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(END)), F.lit(""))


def _field(name: str) -> Column:
    found = F.regexp_extract("head", rf"\r\n{name}: ([^\r]*)", 1)
    return F.when(found != "", found)


def write_archive(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = LEAST_BYTES,
    date: Column | None = None,
) -> None:
    """Writes one record per row of `pages` to the archive folder `path`.

    A null payload counts as empty. Of the rows with equal payloads of at least
    `least_bytes` bytes, those with the smallest id become responses and all
    others revisit them; smaller payloads are always responses. Null ids come
    last: they revisit any row with an id, and are responses among themselves.
    Repeated rows of the smallest id are each a response. A null address leaves
    its header line out. `date`, the time of a record, is that of writing if it is
    not given. A record is named by its id, whatever its type, or by a random name
    if that is null. Other columns are ignored.
    """
    named = lambda x: F.concat(F.lit("<urn:page:"), F.url_encode(x.cast("string")), F.lit(">"))
    time = F.date_format(F.to_utc_timestamp(F.current_timestamp() if date is None else date, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = (
        pages.select(
            col(page_id).alias("id"),
            col(url).cast("string").alias("url"),
            time.alias("date"),
            F.coalesce(col(payload).cast("string"), F.lit("")).alias("payload"),
        )
        .withColumn("digest", F.sha2("payload", 256))
        .withColumn("bytes", F.octet_length("payload").cast("long"))
    )
    rows.groupBy("digest").agg(F.first("payload").cast("binary").alias("payload")).write.parquet(f"{path}/payloads")

    heads = rows.select("id", "url", "date", "digest", "bytes")
    first = heads.groupBy("digest").agg(F.min("id").alias("first_id"))
    revisit = (F.col("bytes") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("first_id"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END + END),
    )
    block = F.when(revisit, F.lit(0)).otherwise(F.octet_length(http) + F.col("bytes"))
    (
        heads.join(first, "digest")
        .select(
            F.concat(
                F.lit(f"WARC/1.1{END}"),
                _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
                _line("WARC-Record-ID", F.coalesce(named(F.col("id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
                _line("WARC-Date", F.col("date")),
                _line("WARC-Target-URI", F.col("url")),
                _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
                _line("WARC-Payload-Length", F.col("bytes").cast("string")),
                _line("WARC-Refers-To", F.when(revisit, named(F.col("first_id")))),
                _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
                F.when(revisit, F.lit("")).otherwise(F.lit(f"Content-Type: application/http;msgtype=response{END}")),
                F.lit("Content-Length: "),
                block.cast("string"),
                F.lit(END + END),
                F.when(revisit, F.lit("")).otherwise(http),
            ).alias("head")
        )
        .write.parquet(f"{path}/records")
    )


def read_archive(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row per record: its parsed head, `head`, `payload`; ids are read as `id_type`.

    Every stored payload is hashed again, once; one that does not match its digest,
    or is missing or of another length than a record says, fails the job.
    """

    def page(name: str) -> Column:
        found = F.regexp_extract("head", rf"\r\n{name}: <urn:page:([^>\r]*)>", 1)
        return F.when(F.contains(F.col("head"), F.lit(f"\r\n{name}: <urn:page:")), F.url_decode(found)).cast(id_type)

    def sure(fits: Column) -> Column:
        refused = F.raise_error(F.concat(F.lit("no sound payload for "), F.col("payload_digest")))
        return F.when(fits, F.col("payload_digest")).otherwise(refused.cast("string"))

    heads = spark.read.parquet(f"{path}/records").select(
        "head",
        page("WARC-Record-ID").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Target-URI").alias("url"),
        F.regexp_extract("head", r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})", 1).alias("payload_digest"),
        _field("WARC-Payload-Length").cast("long").alias("payload_bytes"),
        page("WARC-Refers-To").alias("refers_to"),
    )
    payloads = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("payload_digest"), "payload")
    payloads = payloads.withColumn("payload_digest", sure(F.sha2("payload", 256) == F.col("payload_digest")))
    whole = heads.join(payloads, "payload_digest", "left")
    return whole.withColumn("payload_digest", sure(F.octet_length("payload").eqNullSafe(F.col("payload_bytes"))))


def records(archive: DataFrame) -> DataFrame:
    """The exact bytes of each record of `read_archive`, as `record`."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.withColumn("record", F.concat(F.col("head").cast("binary"), body, F.lit((END + END).encode())))


def checked(archive: DataFrame) -> DataFrame:
    """The rows of `records`; one whose bytes are not as many as its head says fails the job."""
    header = F.octet_length(F.substring_index("head", END + END, 1)) + len(END + END)
    block = F.regexp_extract("head", r"\r\nContent-Length: ([0-9]+)\r\n", 1).try_cast("long")
    sound = F.octet_length("record").eqNullSafe(header + block + len(END + END))
    refused = F.raise_error(F.concat(F.lit("a record of another length than its head says: "), F.col("payload_digest")))
    return archive.withColumn("payload_digest", F.when(sound, F.col("payload_digest")).otherwise(refused.cast("string")))


def export_warc(archive: DataFrame, path: str) -> None:
    """Writes the records of `read_archive` as plain WARC files, one per task. Payloads must be UTF-8 text."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    whole = F.decode(F.concat(F.col("head").cast("binary"), body), "UTF-8")
    archive.select(whole.alias("value")).write.option("lineSep", END + END).text(path)
