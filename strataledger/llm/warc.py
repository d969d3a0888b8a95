"""A content-addressed WARC archive.

``payloads`` holds the bytes of each distinct payload once, under a SHA-256 that is checked against length and a
second hash of every row that gives it. ``headers`` holds the exact header block of every record, and the address
of its payload. Joining the two gives the records back, byte for byte.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataledger.llm.storage import new_path

CRLF = "\r\n"
#: Block that precedes the payload in a response record.
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    payloads: str
    headers: str


def _uri(url: Column) -> Column:
    """The URL without line ends or other controls, which would end a header line."""
    return F.coalesce(F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20"), F.lit(""))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(
    pages: DataFrame, date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 1000
) -> Archive:
    """Write one record per row of ``pages`` (``page_id, url, html``; other columns are ignored).

    The payload is the html in UTF-8, empty for null. Of records with equal payloads of ``min_revisit_bytes`` or
    more, that of the largest page_id is the response and the others are revisits of it; rows that repeat that
    page_id with that payload are responses too. Smaller payloads always make responses. A null page_id counts as
    smaller than any other; if all are null, all are responses. An empty table gives an empty archive.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"address": F.sha2("payload", 256), "length": F.octet_length("payload").cast("long")}
    )
    groups = rows.groupBy("address").agg(
        F.max("page_id").alias("first_id"),
        F.max("payload").alias("payload"),
        F.min("length").alias("__short"),
        F.max("length").alias("__long"),
        F.min(F.xxhash64("payload")).alias("__low"),
        F.max(F.xxhash64("payload")).alias("__high"),
    )
    same = (F.col("__short") == F.col("__long")) & (F.col("__low") == F.col("__high"))
    checked = groups.withColumn(
        "payload", F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256")))
    )
    out = Archive(new_path(spark, "warc-payloads"), new_path(spark, "warc-headers"))
    checked.select("address", "first_id", F.col("payload").alias("bytes")).write.parquet(out.payloads)

    stored = spark.read.parquet(out.payloads).select("address", "first_id")
    facts = rows.select("page_id", "url", "address", "length", F.sha1("payload").alias("sha1"))
    revisit = (F.col("length") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    block = F.lit(len(HTTP_HEAD)) + F.when(revisit, 0).otherwise(F.col("length"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.lit(date)),
        F.concat(F.lit("WARC-Target-URI: "), _uri(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        # null lines are left out by concat_ws
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first_id")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    header = F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)), "UTF-8")
    facts.join(stored, "address").select("page_id", "address", header.alias("header")).write.parquet(out.headers)
    return out


def _sound_payloads(spark, archive: Archive) -> DataFrame:
    """``address, payload``; a payload whose bytes no longer give its address raises."""
    sound = F.sha2("bytes", 256) == F.col("address")
    payload = F.when(sound, F.col("bytes")).otherwise(F.raise_error(F.lit("damaged payload")))
    return spark.read.parquet(archive.payloads).select("address", payload.alias("payload"))


def header_field(header: Column, name: str) -> Column:
    """Value of a header line, null if there is none."""
    found = F.regexp_extract(F.decode(header, "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.nullif(found, F.lit(""))


def read_records(spark, archive: Archive, most: int = 50_000) -> DataFrame:
    """``page_id, address, record, header, fields, payload``: the records as they stand in a WARC file, put together by a
    join of headers and payloads; the header and what it says; and the full payload of each.

    The record of a revisit ends after its HTTP head. A payload that more than ``most`` records share is dealt to several
    tasks.
    """
    headers, payloads = spark.read.parquet(archive.headers), _sound_payloads(spark, archive)
    shared = headers.groupBy("address").agg(F.ceil(F.count("*") / most).alias("parts")).where("parts > 1")
    shared = F.broadcast(shared)  # each stands for more than ``most`` rows of headers
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    headers = headers.join(shared, "address", "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), parts)).drop("parts")
    # headers are short: what they say is read before the join
    headers = headers.withColumn("fields", header_fields(F.col("header")))
    payloads = payloads.join(shared, "address", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    records = headers.join(payloads, ["address", "part"])
    body = F.when(F.col("fields.kind") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.col("header"), F.lit(HTTP_HEAD.encode()), body, F.lit((CRLF + CRLF).encode()))
    return records.select("page_id", "address", record.alias("record"), "header", "fields", "payload")


def header_fields(header: Column) -> Column:
    """``kind, length, digest, refers_to`` as a header says them."""
    target = F.regexp_extract(header_field(header, "WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1)
    return F.struct(
        header_field(header, "WARC-Type").alias("kind"),
        header_field(header, "Content-Length").cast("int").alias("length"),
        header_field(header, "WARC-Payload-Digest").alias("digest"),
        F.nullif(target, F.lit("")).cast("long").alias("refers_to"),
    )


def record_index(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record that was read back.

    ``records``: as ``read_records`` gives them. Each is verified: it begins with its header and the HTTP head, its block is
    as long as the header says, and its payload, a response's taken from the record itself, has the digest of the header
    and the one it is filed under. A record that does not fails the job. Rows that repeat a page_id are records of their
    own, an archive of an empty table has none, and very long payloads are taken whole.
    """
    at, length, head = F.octet_length("header"), F.col("fields.length"), len(HTTP_HEAD)
    inside = F.substring(F.col("record"), at + head + 1, length - head)
    payload = F.when(F.col("fields.kind") == "revisit", F.col("payload")).otherwise(inside)
    start = F.substring(F.col("record"), F.lit(1), at + head) == F.concat(F.col("header"), F.lit(HTTP_HEAD.encode()))
    whole = start & (F.octet_length("record") == at + length + 4)
    cut = records.select("page_id", "fields", "address", whole.alias("whole"), payload.alias("payload"))
    facts = cut.select("page_id", "fields", "address", "whole", F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"))
    same = F.col("whole") & (F.col("fields.digest") == F.concat(F.lit("sha1:"), F.col("sha1"))) & (F.col("sha256") == F.col("address"))
    digest = F.when(same, F.col("sha1")).otherwise(F.raise_error(F.lit("a record does not hold what its header says")))
    return facts.select(
        "page_id", F.col("n").cast("long").alias("payload_bytes"), digest.alias("payload_digest"),
        F.col("fields.kind").alias("record_type"), F.col("fields.refers_to").alias("refers_to"),
    )
