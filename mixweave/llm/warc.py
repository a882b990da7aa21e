"""A content-addressed WARC archive as two Parquet tables.

payloads: each distinct payload once, under its SHA-256, with its length and SHA-1. headers: the exact header block of
every record, and the digests of its payload. Of the pages with equal payloads the one with the largest id is a
response; the others are revisits that refer to it. Reading back joins headers to payloads by digest, which rebuilds whole
records, byte for byte, and verifies length and both digests of each rebuilt body. A revisit has no body; it takes its
length from what was proven of its payload.

Only digests and ids are shuffled to choose the responses. A payload is stored where it was read unless the pages whose
payloads another one has are more than BROADCAST_LOSERS, and moves once, to meet its header. The join of revisits to what was proven
carries a few numbers per payload, and adaptive execution splits the partition of a digest that many records share.

Defined cases. Null html: an empty payload, which takes part like any other. Empty table: empty archive. Rows with
equal page ids: each has its own record; among rows with the largest id of a payload, all are responses (their bytes
are the same). A null page id sorts before all others; it is a response only if its payload has no other. Payloads
shorter than min_revisit bytes are always responses. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixweave.llm.shared import materialize

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed values
MIN_REVISIT = 0
BROADCAST_LOSERS = 500_000  # rows of an id and a digest


def base32(hex_digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: each 5 hex digits are 4 characters of 5 bits."""
    chars = []
    for group in range(8):
        value = F.conv(F.substring(hex_digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            chars.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*chars)


def with_digests(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    return rows.withColumns({"sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})


def header_block(url: Column, page_id: Column, kind: Column, digest: Column, size: Column, refers_to: Column, date: str) -> Column:
    """The header of a WARC/1.1 record, up to and with its empty line."""
    uri = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("none")), F.lit(">"))
    revisit = kind == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), uri(page_id)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.regexp_replace(url, r"[\r\n]", ""), F.lit(""))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), uri(refers_to))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(size).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes the tables path/payloads and path/headers. date is the records' WARC-Date, as pages carry none."""
    rows = with_digests(pages, id_col, url_col, html_col)
    narrow = materialize(rows.drop("payload"), "pages")
    winners = narrow.groupBy("sha256").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
    # payloads: all but those of rows that lose, by a join on the id, so that no digest gathers payloads
    losers = materialize(narrow.join(winners.where("n > 1"), "sha256").where("not page_id <=> response_id").select(F.col("page_id").alias("lost_id"), F.col("sha256").alias("digest")).distinct(), "losers")
    if losers.count() <= BROADCAST_LOSERS:
        losers = F.broadcast(losers)
    stored = rows.join(losers, F.col("page_id").eqNullSafe(F.col("lost_id")) & (F.col("sha256") == F.col("digest")), "left_anti").select("sha256", "sha1", "payload_bytes", "payload")
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    records = narrow.join(winners.drop("n"), "sha256")
    own = (F.col("payload_bytes") < min_revisit) | F.col("page_id").eqNullSafe(F.col("response_id"))
    kind = F.when(own, F.lit("response")).otherwise(F.lit("revisit"))
    records = records.withColumns({"kind": kind, "refers": F.when(~own, F.col("response_id"))})
    header = header_block(F.col("url"), F.col("page_id"), F.col("kind"), base32(F.col("sha1")), F.col("payload_bytes"), F.col("refers"), date)
    records.select("page_id", "sha256", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """The records' headers, parsed: page_id, sha256, header, record_type, refers_to, payload_digest."""
    field = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    number = lambda name: F.nullif(F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")
    return spark.read.parquet(f"{path}/headers").select(
        number("WARC-Record-ID").alias("page_id"),
        "sha256",
        "header",
        field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record in full: page_id, sha256, record_type, refers_to, header and record, which is the header, a response's payload and the closing empty lines; null if the payload is missing."""
    stored = spark.read.parquet(f"{path}/payloads").dropDuplicates(["sha256"]).select("sha256", "payload")
    parsed = headers(spark, path)
    whole = lambda body: F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n")).alias("record")
    named = ["page_id", "sha256", "record_type", "refers_to", "payload_digest", "header"]
    # only responses meet payloads, so a payload that many revisits share moves once
    responses = parsed.where("record_type = 'response'").join(stored, "sha256", "left").select(*named, whole(F.col("payload")))
    return responses.unionByName(parsed.where("record_type <> 'response'").select(*named, whole(F.lit(b""))))


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record with what was read from the rebuilt records; a payload that is missing or fails its length or digests raises an error."""
    head, size = F.octet_length("header"), F.regexp_extract("header", r"\r\nContent-Length: (\d+)\r\n", 1).cast("int")
    body = F.substring(F.col("record"), head + 1, size)
    sound = (F.octet_length("record") == head + size + 4) & (base32(F.sha1("body")) == F.col("payload_digest")) & ((F.col("record_type") == "revisit") | (F.sha2("body", 256) == F.col("sha256")))
    rebuilt = records(spark, path).withColumn("body", body)
    read = rebuilt.where("record_type = 'response'").select("page_id", "sha256", "record_type", "refers_to", "payload_digest", F.octet_length("body").cast("long").alias("bytes"), F.coalesce(sound, F.lit(False)).alias("whole"))
    read = materialize(read, "responses")  # a few numbers for each payload
    facts = read.groupBy("sha256").agg(F.max("bytes").alias("bytes"), F.min("whole").alias("whole"), F.max("payload_digest").alias("own_digest"))
    revisits = rebuilt.where("record_type = 'revisit'").select("page_id", "sha256", "record_type", "refers_to", "payload_digest", (F.octet_length("record") == head + size + 4).alias("closed"))
    again = revisits.alias("r").join(facts.alias("f"), "sha256", "left").select("r.page_id", "sha256", "r.record_type", "r.refers_to", "r.payload_digest", "f.bytes", F.coalesce(F.col("f.whole") & F.col("r.closed") & (F.col("f.own_digest") == F.col("r.payload_digest")), F.lit(False)).alias("whole"))
    proven = F.when(F.col("whole"), F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("payload fails its digest: "), F.col("sha256"))))
    return read.unionByName(again).select("page_id", proven.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
