"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing.  Each page is one record in uncompressed WARC/1.0 files made by Spark's text writer, so any store that
Spark writes to will do.  Of equal payloads of at least ``REVISIT_BYTES`` bytes the page with the largest id is
the response, the others are revisits that refer to it; smaller payloads are always responses.

Reading.  The archive is cut at every occurrence of the magic line, wherever file splits fall; prefix sums
of the segment lengths give each segment's offset.  Every segment that parses as a header is a candidate record
and names its successor's offset.  Pointer jumping from offset 0 of each file (doubling the jump each
round, so logarithmically many rounds) keeps only the reachable candidates: a magic line or even
a whole record inside a payload is never reached.  Payloads that were cut by a magic line inside
them are put together again from their segments.

Files whose names end in .gz are read as streams of gzip members (one per record, as archives have them, or one per file); their
offsets are those of the unpacked bytes, and such a file is one split.

Defined cases: null html is an empty payload, null url an empty one; line breaks in an url become blanks; a null
page_id is always a response; rows with equal id and payload are both responses if their id is the largest; an
empty table gives an empty archive; further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, shared_dir, stored

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
REVISIT_BYTES, RECORDS_PER_FILE = 1000, 50_000


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " ").alias("url"), html.alias("html"), F.octet_length(html).alias("size"), F.sha2(html, 256).alias("key"))
    same = pages.where(F.col("size") >= revisit_bytes).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("kept")).where("n > 1").select("key", "kept")
    same = stored(same, "warc-same")  # its size is known then: a short list is broadcast and no html is shuffled
    pages = pages.join(same, "key", "left").withColumn("revisit", F.coalesce(F.col("page_id") != F.col("kept"), F.lit(False)))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), line("WARC-Target-URI", F.col("url")), line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        F.when(F.col("revisit"), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("kept").cast("string"), F.lit(">")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("html"))), line("X-Payload-Length", F.col("size").cast("string")), line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("size").cast("string"))), F.lit("\r\n"), F.when(F.col("revisit"), "").otherwise(F.col("html")),
    )
    pages.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magic lines: file, block (split start), at (order inside a scan), size, value."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.substring_index("_metadata.file_path", "/", -1).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.octet_length("value").cast("long").alias("size"), "value")


def _placed(segments: DataFrame) -> DataFrame:
    """Replace (block, at) by the offset of the magic line before each segment.

    Segments are summed inside each file split, and a file's splits (one row each) by prefix sums.  Offsets rest on one scan
    only: two scans whose splits differ agree on them.
    """
    whole = F.col("size") + len(MAGIC)
    start = F.coalesce(F.sum("_all").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = segments.groupBy("file", "block").agg(F.sum(whole).alias("_all")).select("file", "block", start.alias("_start"))
    inside = F.coalesce(F.sum(whole).over(Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = segments.withColumn("_inside", inside).join(blocks, ["file", "block"])
    return out.withColumn("offset", F.col("_start") + F.col("_inside") - len(MAGIC)).drop("block", "at", "_start", "_inside")


def _reachable(candidates: DataFrame) -> DataFrame:
    """(file, offset) of the records on the chain from each file's start, by pointer jumping."""
    nodes = candidates.select("file", "offset")
    jumps = checkpointed(candidates.select("file", "offset", F.col("next").alias("to")).join(nodes.withColumnRenamed("offset", "to"), ["file", "to"], "left_semi"))
    found = nodes.where("offset = 0")
    while not jumps.isEmpty():
        found = checkpointed(found.unionByName(found.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))).distinct())
        step = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("beyond"))
        jumps = checkpointed(jumps.join(step, ["file", "to"]).select("file", "offset", F.col("beyond").alias("to")))
    return found


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: file, offset, record_type, record_id, refers_to, declared (digest), payload_length (header), payload_bytes and payload_sha1 (of the bytes read)."""
    segments = _segments(spark, path)
    head = F.substring_index("value", END, 1)
    field = lambda name: F.regexp_extract("head", rf"(?m)^{name}:[ \t]*([^\r\n]*)", 1)
    parsed = segments.select("file", "block", "at", "size", head.alias("head"), "value")
    parsed = parsed.withColumn("length", F.expr("try_cast(nullif(regexp_extract(head, '(?m)^Content-Length:[ \\\\t]*([0-9]+)', 1), '') as bigint)"))
    parsed = parsed.withColumn("head_size", F.octet_length("head")).withColumn("whole", F.coalesce(F.col("size") == F.col("head_size") + F.col("length") + 8, F.lit(False)))
    payload = F.expr("substring(value, length(head) + 5, greatest(length(value) - length(head) - 8, 0))")
    parsed = parsed.select("file", "block", "at", "size", "head_size", "length", "whole", field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Refers-To").alias("refers_to"), field("WARC-Payload-Digest").alias("declared"), field("X-Payload-Length").alias("payload_length"), F.when(F.col("whole"), F.sha1(payload)).alias("payload_sha1"))
    parsed = stored(_placed(stored(parsed, "warc-heads")), "warc-segments")
    candidates = parsed.where(f"offset >= 0 and record_type <> '' and length is not null").withColumn("next", F.col("offset") + len(MAGIC) + F.col("head_size") + F.col("length") + 8)
    records = stored(candidates.join(_reachable(candidates), ["file", "offset"], "left_semi"), "warc-records")
    cut = records.where("not whole").select("file", F.col("offset").alias("record"), "next", F.col("length").alias("want"))
    if not cut.isEmpty():  # payloads with magic lines inside: fetch their segments
        cut = stored(cut, "warc-cut")  # its size is known then: a short list is broadcast and other files are not shuffled
        inner = _placed(segments.join(cut.select("file").distinct(), "file", "left_semi")).join(cut, "file").where("offset >= record and offset < next")
        inner = inner.groupBy("file", "record", "want").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
        inner = inner.select("file", F.col("record").alias("offset"), "value", F.substring_index("value", END, 1).alias("head"), "want")
        inner = inner.where("octet_length(value) = octet_length(head) + want + 8").select("file", "offset", F.sha1(payload).alias("whole_sha1"))
        records = records.join(inner, ["file", "offset"], "left").withColumn("payload_sha1", F.coalesce("payload_sha1", "whole_sha1"))
    return records.select("file", "offset", "record_type", "record_id", "refers_to", "declared", F.expr("try_cast(nullif(payload_length, '') as bigint)").alias("payload_length"), F.col("length").alias("payload_bytes"), "payload_sha1")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the pages as WARC, read them back, and return one row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:page:(-?[0-9]*)>$', 1), '') as bigint)")
    revisit = F.col("record_type") == "revisit"
    return read_warc(spark, path).select(
        number("record_id").alias("page_id"), F.when(revisit, F.col("payload_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("declared", "^sha1:", "")).otherwise(F.col("payload_sha1")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS kept FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= {REVISIT_BYTES} AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id <> kept THEN kept END AS refers_to FROM m
"""
