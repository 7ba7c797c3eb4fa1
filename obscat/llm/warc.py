"""Content-addressed WARC archive: payloads once, exact record headers apart, records by join.

``write_archive`` stores every different payload once, under its SHA-256 digest, in one table
and the header bytes of every record in another. ``read_archive`` recomputes the digests of the
stored payloads, refuses a payload that does not give its own address, and joins headers and
payloads on the digest back to records. Everything is DataFrame functions.

Cases: a null or empty payload is a payload of 0 bytes like any other. Of records with equal
payloads the one with the largest id is the response, the others are revisits that refer to it.
A repeated row repeats its record: of equal ids with equal payloads each row gives the same
record, and all rows of the largest id are responses. A null id sorts before all others; a null
or empty target leaves its header line out; line ends inside a target are percent-encoded. An
empty table gives an empty archive; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obscat.llm.registry import query, table
from obscat.llm.store import shared_folder

BASE32_OF_HEX = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: 160 bits as four groups of 40."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), *BASE32_OF_HEX)


def header(kind: Column, record: Column, target: Column, digest: Column, refers: Column, length: Column) -> Column:
    """Header bytes of one record, closed by an empty line."""
    safe = F.replace(F.replace(target, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    optional = lambda there, text: F.when(there, text).otherwise("")
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(record.cast("string"), F.lit("")), F.lit(">"))),
        optional(F.coalesce(target, F.lit("")) != "", line("WARC-Target-URI", safe)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        optional(refers.isNotNull(), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">")))),
        optional(kind == "revisit", line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(END),
    )


def write_archive(pages: DataFrame, path: str, id_column: str = "page_id", target: str = "url", payload: str = "html") -> str:
    """Write the archive of ``pages`` below ``path``: tables ``payloads`` and ``headers``.

    Payloads meet by digest in one aggregation with map-side combine, so a group of copies sends
    one payload per task and not one per copy.
    """
    records = pages.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(target).cast("string").alias("target"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("address", F.unhex(F.sha2("payload", 256)))
    (
        records.groupBy("address")
        .agg(F.max("id").alias("response_id"), F.any_value("payload").alias("payload"))
        .write.option("compression", "zstd").parquet(f"{path}/payloads")
    )
    stored = records.sparkSession.read.parquet(f"{path}/payloads")
    owners = stored.select(
        "address", "response_id", base32_sha1(F.col("payload")).alias("digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    owned = records.drop("payload").join(owners, "address")
    kind = F.when(F.col("id").eqNullSafe(F.col("response_id")), "response").otherwise("revisit")
    body = F.when(kind == "response", F.col("payload_bytes")).otherwise(0) + len(HTTP_HEAD)
    refers = F.when(kind == "revisit", F.col("response_id"))
    text = header(kind, F.col("id"), F.col("target"), F.col("digest"), refers, body)
    (
        owned.select("address", text.cast("binary").alias("header"))
        .write.option("compression", "zstd").parquet(f"{path}/headers")
    )
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: what the header says, the full payload and the record's bytes."""
    payloads = spark.read.parquet(f"{path}/payloads").select(
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("address"), F.col("address"))
        .otherwise(F.raise_error(F.lit("payload differs from its digest")).cast("binary")).alias("address"),
        "payload",
        base32_sha1(F.col("payload")).alias("stored_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    text = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(text, rf"(?m)^{name}: ([^\r]*)\r\n", 1)
    number = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1)
    headers = spark.read.parquet(f"{path}/headers").select(
        "address", "header",
        F.nullif(number("WARC-Record-ID"), F.lit("")).cast("long").alias("id"),
        field("WARC-Type").alias("record_type"),
        F.nullif(field("WARC-Target-URI"), F.lit("")).alias("target"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("payload_digest"),
        F.nullif(number("WARC-Refers-To"), F.lit("")).cast("long").alias("refers_to"),
    )
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return headers.join(payloads, "address").select(
        "id", "target", "record_type", "refers_to", "payload_bytes", "payload",
        F.when(F.col("payload_digest") == F.col("stored_digest"), F.col("payload_digest"))
        .otherwise(F.raise_error(F.lit("header and payload have different digests"))).alias("payload_digest"),
        F.concat("header", F.lit(HTTP_HEAD.encode()), block, F.lit(b"\r\n\r\n")).alias("record"),
    )


_BITS = "list_transform(range(1, 41), lambda i: ('0000000100100011010001010110011110001001101010111100110111101111')[(1 + 4 * (instr('0123456789abcdef', hex[i]) - 1)):(4 + 4 * (instr('0123456789abcdef', hex[i]) - 1))])"

ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT page_id, body, array_to_string({_BITS}, '') AS bits, max(page_id) OVER (PARTITION BY body) AS owner FROM p
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5 * j + 1] AS INT) + 8 * CAST(bits[5 * j + 2] AS INT)
      + 4 * CAST(bits[5 * j + 3] AS INT) + 2 * CAST(bits[5 * j + 4] AS INT) + CAST(bits[5 * j + 5] AS INT)]), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM b
"""


@query("op8_warc", ORACLE)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write an archive of all pages, read it back, one row per record."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
