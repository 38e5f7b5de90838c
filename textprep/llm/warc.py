"""Content-addressed WARC archive: payloads once by digest, record headers apart.

An archive is a folder with two tables. ``payloads`` holds every different payload once under
its SHA-256; ``records`` holds the exact header of every record, WARC and HTTP part, and the
digest of the payload that belongs behind it. A record is its header followed by its payload;
reading joins the two and checks every payload against its digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textprep.llm.common import attach, write_once

SHARED = 1_000  # records that share one copy of a payload when they are put together
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LINE = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: eight groups of five hex digits, four letters each."""
    digest = F.sha1(data)
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int"),
    )

    def letters(group: Column) -> Column:
        return F.concat(*(
            F.substring(
                F.lit(BASE32), F.shiftright(group, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)
            )
            for shift in (15, 10, 5, 0)
        ))

    return F.array_join(F.transform(groups, letters), "")


def _line(name: str, value: Column) -> Column:
    """A header line, nothing for a null value; line breaks in a value become spaces."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(LINE)), F.lit(""))


def write_archive(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> None:
    """Write one record per row into a new archive.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest
    id (null ids last; of rows with that id the one with the smallest url) is a response and
    the others revisit it; smaller payloads are always responses. A null payload is an empty
    one. Rows equal in everything get records of their own. A frame without rows gives an
    empty archive. Other columns are not read.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    )
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    # partial aggregation: a payload shared by many rows leaves each task once
    keyed.groupBy("digest").agg(F.min("payload").alias("payload")).select(
        "digest", F.col("payload").cast("binary").alias("payload")
    ).write.option("compression", "zstd").parquet(f"{folder}/payloads")

    small = keyed.select(
        "page_id", "url", "digest",
        F.octet_length("payload").cast("long").alias("bytes"),
        base32_sha1(F.col("payload")).alias("sha1"),
    )
    # a number a row tells equal rows apart; written, since two readers have to see the same
    numbered = write_once(small.withColumn("copy", F.monotonically_increasing_id()))
    order = F.struct(F.col("page_id").isNull(), "page_id", "url", "copy")
    first = numbered.groupBy("digest").agg(F.min(order).alias("first"))
    placed = numbered.join(first.select("digest", F.col("first.copy").alias("first_copy")), "digest")
    response = (F.col("bytes") < min_bytes) | (F.col("copy") == F.col("first_copy"))

    def urn(copy: Column) -> Column:
        name = F.md5(F.concat_ws("|", "digest", copy.cast("string")))
        dashed = F.regexp_replace(name, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
        return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))

    typed = placed.withColumn("type", F.when(response, "response").otherwise("revisit"))
    revisit = F.col("type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}"),
        _line("Content-Length", F.col("bytes")), F.lit(LINE),
    )
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{LINE}"),
        _line("WARC-Type", F.col("type")),
        _line("WARC-Record-ID", urn(F.col("copy"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, _line("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        F.when(revisit, _line("WARC-Refers-To", urn(F.col("first_copy")))).otherwise(""),
        _line("X-Page-Id", F.col("page_id")),
        F.lit(f"Content-Type: application/http; msgtype=response{LINE}"),
        _line("Content-Length", block), F.lit(LINE),
    )
    typed.select(F.concat(header, http).alias("header"), "digest").write.option(
        "compression", "zstd"
    ).parquet(f"{folder}/records")


def _field(name: str) -> Column:
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/records").select(
        "header", "digest",
        _field("WARC-Type").alias("type"),
        _field("WARC-Record-ID").alias("record_id"),
        _field("WARC-Refers-To").alias("refers_to_record"),
        F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("sha1"),
        _field("X-Page-Id").cast("long").alias("page_id"),
    )


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads that hold what their digest says; others end the job."""
    rows = spark.read.parquet(f"{folder}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest")))
    same = F.sha2("payload", 256) == F.col("digest")
    return rows.withColumn("payload", F.when(same, F.col("payload")).otherwise(wrong))


def _rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Every header with the payload of its digest, and ``record``, its bytes as they were.

    The payload of a digest that many records name is repeated under several salts, a share
    of the records each.
    """
    headers = _headers(spark, folder)
    many = headers.groupBy("digest").agg(F.ceil(F.count(F.lit(1)) / SHARED).alias("salts"))
    many = write_once(many.filter("salts > 1"))
    salted = headers.withColumn("turn", F.monotonically_increasing_id())
    salted = attach(salted, many, ["digest"]).withColumn(
        "salt", F.pmod("turn", F.coalesce("salts", F.lit(1)))
    )
    salts = F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)
    payloads = attach(_payloads(spark, folder), many, ["digest"])
    payloads = payloads.select("digest", "payload", F.explode(salts).alias("salt"))
    own = F.when(F.col("type") == "response", F.col("payload")).otherwise(F.lit(b""))
    joined = salted.drop("turn", "salts").join(payloads, ["digest", "salt"])
    return joined.withColumn("record", F.concat(F.col("header").cast("binary"), own))


def read_records(spark: SparkSession, folder: str, resolve: bool = False) -> DataFrame:
    """``page_id, type, record``: the whole bytes of every record, without its closing empty
    lines. A response is its header and payload; a revisit has no payload of its own. With
    ``resolve`` also ``payload``, for a revisit that of the record it revisits."""
    columns = ["page_id", "type", "record"] + (["payload"] if resolve else [])
    return _rebuilt(spark, folder).select(*columns)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record.

    Records are put together from header and payload and measured in the same stage. Their
    length has to be what the header says, and so has the SHA-1. ``refers_to`` is the page of
    the record that a revisit names.
    """
    block = F.octet_length("record") - F.octet_length(F.substring_index("header", LINE + LINE, 1)) - 4
    sha1 = base32_sha1(F.col("payload"))
    wrong = F.raise_error(F.concat(F.lit("header differs from its record "), F.col("record_id")))
    holds = (block == _field("Content-Length").cast("long")) & (F.col("sha1") == sha1)
    measured = write_once(_rebuilt(spark, folder).select(
        "page_id", "type", "refers_to_record",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(holds, F.col("sha1")).otherwise(wrong).alias("payload_digest"),
    ))
    named = _headers(spark, folder).filter("type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to")
    )
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"]
    # only revisits look for a page: responses name none, and would meet under one null key
    first = measured.filter("refers_to_record is null").withColumn("refers_to", F.lit(None).cast("long"))
    again = measured.filter("refers_to_record is not null").join(named, "refers_to_record", "left")
    return first.select(*columns).unionAll(again.select(*columns))
