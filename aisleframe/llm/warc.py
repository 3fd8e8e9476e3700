"""Content-addressed archive of web records.

A payload is stored once, under its SHA-256; the exact header of every record
is kept in a table of its own. A record is put together again by joining the
two. Of records with equal payloads one is the response, the others are
revisits that name it. A record's block is an HTTP response: a fixed head, and
behind it the payload, which a revisit leaves out. Line breaks in a value are
percent-encoded, so a header line stays one.

Nulls: a null payload is an empty one; a null id or address gives an empty
header value. Equal rows are one header row with a number of copies; of those
copies the first is the response if the group's response is among them. An
empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleframe.llm.common import shared_folder

CRLF = "\r\n"
#: Fixed values of the format.
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are four times eight digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def utc_now() -> Column:
    """The time of the query, in the form of WARC-Date; one value for all its rows."""
    return F.expr("date_format(to_utc_timestamp(current_timestamp(), current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")


def header_of(page_id: Column, url: Column, kind: Column, refers_to: Column, digest: Column, n: Column, date: Column) -> Column:
    """The bytes of a record's header, with the empty line that ends it."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    def plain(value: Column) -> Column:
        one_line = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
        return F.coalesce(one_line, F.lit(""))

    return F.encode(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"),
            line("WARC-Type", kind),
            line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), plain(page_id), F.lit(">"))),
            line("WARC-Date", date),
            line("WARC-Target-URI", plain(url)),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
            F.when(
                kind == "revisit",
                F.concat(
                    line("WARC-Profile", F.lit(IDENTICAL_PAYLOAD)),
                    line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), plain(refers_to), F.lit(">"))),
                ),
            ).otherwise(""),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", (F.when(kind == "revisit", F.lit(0)).otherwise(n) + len(HTTP_HEAD)).cast("string")),
            F.lit(CRLF),
        ),
        "UTF-8",
    )


def write_archive(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> None:
    """Write ``folder``/payloads and ``folder``/headers, both Parquet.

    Needs page_id, url and html; other columns are left out. Payloads shorter
    than ``min_revisit_bytes`` are all responses. A group of payloads under one
    SHA-256 must agree in length and SHA-1, else the write fails.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"content_id": F.sha2("payload", 256), "digest": base32_sha1(F.col("payload")), "n": F.octet_length("payload").cast("long")}
    )
    records = rows.groupBy("content_id", "digest", "n", "page_id", "url").agg(F.count("*").alias("copies"))
    owners = records.groupBy("content_id").agg(
        F.max(F.struct("page_id", "url")).alias("owner"),
        (F.min("digest") == F.max("digest")).alias("_one_digest"),
        (F.min("n") == F.max("n")).alias("_one_length"),
    )
    clash = F.raise_error(F.concat(F.lit("different payloads under SHA-256 "), F.col("content_id")))
    owners = owners.select(
        "content_id", F.when(F.col("_one_digest") & F.col("_one_length"), F.col("owner")).otherwise(clash).alias("owner")
    )
    first = F.struct("page_id", "url").eqNullSafe(F.col("owner")) & (F.col("copy") == 1)
    kind = F.when((F.col("n") < min_revisit_bytes) | first, "response").otherwise("revisit")
    (
        records.join(owners, "content_id")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .withColumn("record_type", kind)
        .select(
            "page_id",
            "content_id",
            F.when(F.col("record_type") == "revisit", F.col("owner.page_id")).alias("refers_to"),
            header_of(
                F.col("page_id"), F.col("url"), F.col("record_type"), F.col("owner.page_id"), F.col("digest"), F.col("n"), utc_now()
            ).alias("header"),
        )
        .write.parquet(f"{folder}/headers")
    )
    rows.groupBy("content_id").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record, parsed from its header and checked against its payload.

    ``payload_bytes`` and ``payload_digest`` are those of the stored bytes. A
    header that names another digest, or a payload that does not hash to its
    content id, makes the read fail.
    """
    stored = spark.read.parquet(f"{folder}/payloads").select(
        "content_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        (F.sha2("payload", 256) == F.col("content_id")).alias("_sound"),
    )
    text = F.decode("header", "UTF-8")
    heads = spark.read.parquet(f"{folder}/headers").select(
        "page_id",
        "content_id",
        "refers_to",
        F.regexp_extract(text, r"\r\nWARC-Type: ([a-z]+)\r\n", 1).alias("record_type"),
        F.regexp_extract(text, r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]+)\r\n", 1).alias("_digest"),
        F.regexp_extract(text, r"\r\nContent-Length: (\d+)\r\n", 1).cast("long").alias("_length"),
    )
    length = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes")) + len(HTTP_HEAD)
    sound = F.col("_sound") & (F.col("_digest") == F.col("payload_digest")) & (F.col("_length") == length)
    # A left join: a header without its payload must be seen, not lost.
    return heads.join(stored, "content_id", "left").select(
        "page_id",
        "payload_bytes",
        F.when(F.coalesce(sound, F.lit(False)), F.col("payload_digest"))
        .otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))))
        .alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record): the bytes of every record as they stand in a WARC file."""
    heads = spark.read.parquet(f"{folder}/headers")
    stored = spark.read.parquet(f"{folder}/payloads")
    revisit = F.decode("header", "UTF-8").contains(f"{CRLF}WARC-Type: revisit{CRLF}")
    head = F.encode(F.lit(HTTP_HEAD), "UTF-8")
    body = F.when(~revisit, F.concat(head, F.col("payload"))).otherwise(head)
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    return heads.join(stored, "content_id", "left").select("page_id", F.concat("header", body, end).alias("record"))


def archive(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archive(pages, folder, min_revisit_bytes)
    return read_records(spark, folder)
