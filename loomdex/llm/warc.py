"""Content-addressed WARC archive.

Two Parquet tables make an archive. ``payloads`` holds the bytes of each distinct payload once, under its SHA-256, in
buckets of that digest; ``records`` holds, for each record, its exact header block and the digest of its payload. The
original records come back by a join of the two: each payload is verified against its digest, and each record's block
against the length and the digest in its header.

Defined results: a null html is an empty payload, and all empty payloads are equal. A null url leaves the target
URI out of the header. Of equal payloads, the record with the smallest page_id is the response; rows that repeat
that page_id with that payload are responses too. A null page_id is never the smallest while another exists; where
a group has none, its records are responses. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import bucket_count, work_dir

#: Fixed value: the base32 alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Fixed value: the profile URI of WARC 1.1 for a revisit with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are 32 characters, four from each five hex digits."""
    digits = F.sha1(payload)
    parts = []
    for k in range(8):
        group = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(group, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def with_payload(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))


def header(date: str) -> Column:
    """The header block of a record, up to and with the empty line."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    record = lambda c: F.concat(F.lit("<urn:page:"), number(c), F.lit(">"))
    uri = F.regexp_replace("url", r"[\r\n]", " ")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record("page_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record("refers_to")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", **names: str) -> None:
    """Write the archive of pages to path.

    The payloads cross the network once, to meet their copies; equal payloads of one map task are merged before. They
    are written in the buckets in which they met, so that a reader's join doesn't move them again. Headers never carry
    the payload, so a payload shared by a third of all pages costs only short rows.
    """
    spark = pages.sparkSession
    rows = with_payload(pages, **names)
    buckets = bucket_count(pages)
    sha1, size = base32_sha1(F.col("payload")).alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes")
    met = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("page_id").alias("first_page")).select("digest", "payload", size, sha1, "first_page")
    table = f"loomdex_payloads_{uuid.uuid4().hex}"
    met.write.option("compression", "zstd").option("path", f"{path}/payloads-{buckets}").bucketBy(buckets, "digest").saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay
    heads = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads-{buckets}").drop("payload")
    same = F.col("page_id").eqNullSafe(F.col("first_page"))
    records = rows.drop("payload").join(heads, "digest").withColumn("record_type", F.when(same, "response").otherwise("revisit")).withColumn("refers_to", F.when(~same, F.col("first_page")))
    records.select("digest", "record_type", F.encode(header(date), "UTF-8").alias("header")).write.option("compression", "zstd").partitionBy("record_type").parquet(f"{path}/records")


PAYLOADS = "digest string, payload binary, payload_bytes long, payload_digest string, first_page long"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload, payload_bytes, payload_digest, in the buckets of the writer; a payload that differs from its
    digest raises when it is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    name = next(n for n in found if n.startswith("payloads-"))
    table = f"loomdex_payloads_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {table} ({PAYLOADS}) USING parquet CLUSTERED BY (digest) INTO {int(name.split('-')[1])} BUCKETS LOCATION '{path}/{name}'")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), "digest")).cast("binary"))
    found = spark.table(table).select("digest", sound.alias("payload"), "payload_bytes", "payload_digest")
    spark.sql(f"DROP TABLE {table}")  # found keeps what it has learnt from it, and the files stay
    return found


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (the bytes as written: header, block and the two line ends), payload_bytes, payload_digest,
    record_type, refers_to: the original records, put together again and then read as a WARC reader would.

    Only responses have a block, one for each payload; they join the payloads where those lie. Revisits, of which one
    payload may have any number, join the short columns alone, which Spark can split. A record whose block isn't as
    long, or whose payload not of the digest, as its header says raises.
    """
    stored = spark.read.schema("digest string, header binary, record_type string").parquet(f"{path}/records")
    payloads = read_payloads(spark, path)
    short = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads-*").select("digest", F.lit(None).cast("binary").alias("payload"), "payload_bytes", "payload_digest")
    whole = stored.filter("record_type = 'response'").join(payloads, "digest").unionByName(stored.filter("record_type = 'revisit'").join(short, "digest"))
    built = whole.select("payload_bytes", "payload_digest", F.length("header").alias("at"), F.concat("header", F.coalesce("payload", F.lit(b"")), F.lit(b"\r\n\r\n")).alias("record"))
    text = F.decode(F.substring(F.col("record"), F.lit(1), F.col("at")), "UTF-8")
    field = lambda name: F.regexp_extract("text", rf"\n{name}: ([^\r\n]*)\r\n", 1)
    page = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1)
    number = lambda name: F.when(page(name) != "", page(name).cast("long"))
    size = F.try_to_number(field("Content-Length"), F.lit("9" * 18)).cast("long")
    block = F.substring(F.col("record"), F.col("at") + 1, F.col("size").cast("int"))
    parsed = built.withColumn("text", text).withColumn("size", size).withColumn("kind", field("WARC-Type")).withColumn("said", F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1))
    response = F.col("kind") == "response"
    seen = F.when(response, base32_sha1(block)).otherwise(F.col("payload_digest"))
    sound = (F.length("record") == F.col("at") + F.col("size") + 4) & (F.col("size") == F.when(response, F.col("payload_bytes")).otherwise(0)) & (seen == F.col("said"))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("a record differs from its header: "), "text")).cast("long"))
    return parsed.select(number("WARC-Record-ID").alias("page_id"), "record", checked.alias("payload_bytes"), F.col("said").alias("payload_digest"), F.col("kind").alias("record_type"), number("WARC-Refers-To").alias("refers_to"))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages to an archive, read it back."""
    path = path or f"{work_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
