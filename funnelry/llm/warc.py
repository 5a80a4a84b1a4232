"""Content-addressed web archive: payload bytes once by digest, exact record headers apart.

`write` puts two tables into a folder. `payloads` has each distinct payload once, under its SHA-256;
that all payloads of a digest are the same is verified by their length and a second hash. `records`
has the exact header bytes of every record and the digest of its payload. `read_records` and
`read_pages` put records and payloads together again by joins and verify the digest of what they
read. Payloads are reduced to one per map task before they are shuffled, so a payload with very many
copies is no burden, and a join with a frequent digest is split by Spark.

Of the records with equal payloads of at least `min_revisit_bytes` that with the smallest id is the
response and the others revisit it. Edge cases: a NULL payload is empty; a NULL id is larger than
all others; rows that repeat id and payload of a response are responses too; if no id is known,
all are responses; a NULL url gives no target header, line breaks in it are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelry.llm.stores import pick, settings, stored

MIN_REVISIT_BYTES = 100
CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"


def _line(name: str, value: Column) -> Column:
    """A header line; nothing for a NULL value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _named(id_: Column) -> Column:
    return F.concat(F.lit(f"<{NAME}"), id_.cast("string"), F.lit(">"))


def header(id_: Column, url: Column, digest: Column, n: Column, refers_to: Column, date: str) -> Column:
    is_revisit = refers_to.isNotNull()
    url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.coalesce(_named(id_), F.lit(f"<{NAME}unknown>"))),
        _line("WARC-Target-URI", url),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _line("WARC-Refers-To", _named(refers_to)),
        _line("WARC-Profile", F.when(is_revisit, PROFILE)),
        _line("Content-Type", F.when(~is_revisit, "text/html; charset=utf-8")),
        _line("Content-Length", F.when(is_revisit, "0").otherwise(n.cast("string"))),
        F.lit(CRLF),
    ).cast("binary")


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = DATE) -> None:
    """Writes the tables `records` and `payloads` below `folder`."""
    spark = pages.sparkSession
    rows = pick(pages, page_id="page_id", url="url", html="html")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = rows.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    slim = stored(rows.select("page_id", "url", "digest", "n"), "pages")
    check = F.struct("n", F.xxhash64("payload"))
    found = rows.groupBy("digest").agg(
        F.first("payload").alias("payload"),
        F.min("page_id").alias("first_id"),
        (F.min(check) == F.max(check)).alias("same"),
    )
    clash = F.raise_error(F.concat(F.lit("two payloads have the digest "), F.col("digest")))
    found = found.withColumn("payload", F.when(F.col("same"), F.col("payload")).otherwise(clash.cast("binary")))
    compact = {
        "spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true",
        "spark__sql__parquet__compression__codec": "zstd",
    }
    with settings(spark, **compact):
        found.drop("same").write.parquet(f"{folder}/payloads")
    firsts = spark.read.parquet(f"{folder}/payloads").select("digest", "first_id")
    joined = slim.join(firsts, "digest")
    other = F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull())
    refers_to = F.when((F.col("n") >= min_revisit_bytes) & other, F.col("first_id"))
    line = header(F.col("page_id"), F.col("url"), F.col("digest"), F.col("n"), refers_to, date)
    with settings(spark, **compact):
        joined.select(line.alias("header"), "digest").write.parquet(f"{folder}/records")


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    """header, digest and verified payload of every record."""
    records = spark.read.parquet(f"{folder}/records")
    payloads = spark.read.parquet(f"{folder}/payloads").select("digest", "payload")
    return records.join(payloads, "digest")


def field(header_: Column, name: str) -> Column:
    """The value of a header line; NULL if there is none."""
    found = F.regexp_extract(header_.cast("string"), f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record as bytes: header, block (empty for a revisit), two line ends."""
    block = F.when(field(F.col("header"), "WARC-Type") == "response", F.col("payload"))
    block = F.coalesce(block, F.lit(b""))
    tail = F.lit((CRLF + CRLF).encode())
    return _joined(spark, folder).select(F.concat("header", block, tail).alias("record"))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type and refers_to of every record, from its
    header and payload; fails if a payload does not have the digest of its record."""
    head = F.col("header")
    digest = F.sha2("payload", 256)
    number = lambda name: F.regexp_extract(field(head, name), r":(-?\d+)>$", 1)
    id_ = number("WARC-Record-ID")
    wrong = F.raise_error(F.concat(F.lit("damaged payload of "), F.col("digest")))
    wanted = F.concat(F.lit("sha256:"), digest) == field(head, "WARC-Payload-Digest")
    return _joined(spark, folder).select(
        F.when(id_ != "", id_).cast("long").alias("page_id"),
        field(head, "WARC-Target-URI").alias("url"),
        "payload",
        F.when(wanted, digest).otherwise(wrong.cast("string")).alias("payload_digest"),
        field(head, "WARC-Type").alias("record_type"),
        number("WARC-Refers-To").cast("long").alias("refers_to"),
    )
