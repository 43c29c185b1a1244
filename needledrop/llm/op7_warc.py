"""WARC archives as chunked record tables.

Pages are written as WARC/1.1 records by Spark's text sink. A payload over ``chunk_bytes`` is
segmented: its first chunk is a response record, each further one a continuation record, as
the format provides, so no record is larger than a chunk. Reading gives one row for each
record identifier and chunk number. The chunks of a segmented payload are streamed in order
past a running SHA-1, so a payload is never put together in memory. Equal payloads are
written once; the others are revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.scratch import scratch_folder

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Where texts are parted before chunks are cut: no chunk holds the version line, which parts records on reading.
INSIDE_VERSION = r"(?<=WARC/)(?=1\.1\r\n)"
DATE = "2024-01-01T00:00:00Z"
CHUNKS = "record_id string, page_id bigint, chunk_no int, bytes_so_far bigint, digest_so_far string, last boolean, declared string"


def base32_digest(data: Column) -> Column:
    """SHA-1 in upper-case base32: four groups of ten hexadecimal digits, eight base32 digits each."""
    code = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(code, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def plan_records(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html with payload_digest, payload_bytes, record_id, and refers_to for a revisit.

    A record's identifier names the page, the payload and the row, so that rows of one id, or of
    none, are different records even where their payloads are equal. The payloads meet the largest
    page_id of their digest, one row a digest, so a payload of many pages is split by adaptive joins.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.select("*", base32_digest(F.col("html").cast("binary")).alias("payload_digest"), F.octet_length("html").cast("bigint").alias("payload_bytes"))
    # digests are computed on their own for the groups: payloads do not enter that shuffle
    first = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("response_id"), F.count("*").alias("pages")).filter("pages > 1").drop("pages")
    rows = rows.join(first, ["payload_digest", "payload_bytes"], "left")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    return rows.select(
        "page_id", "url", "html", "payload_digest", "payload_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id")).alias("refers_to"),
        F.concat(F.lit("<urn:page:"), page, F.lit(":"), F.col("payload_digest"), F.lit(":"), F.uuid(), F.lit(">")).alias("record_id"),
    )


def record_texts(records: DataFrame, chunk_bytes: int) -> DataFrame:
    """The text of every WARC record, one row each, without the two line ends that close it."""
    pieces = F.when(F.contains("html", F.lit(VERSION)), F.filter(F.split("html", INSIDE_VERSION, -1), lambda x: x != "")).otherwise(F.array("html"))
    chunks = F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(p) - 1) / chunk_bytes).cast("int")), lambda i: F.substring(p.cast("binary"), i * chunk_bytes + 1, F.lit(chunk_bytes)))))
    empty = F.array(F.lit(b""))
    parts = records.select("url", "payload_digest", "payload_bytes", "refers_to", "record_id", F.when(F.col("refers_to").isNotNull() | (F.col("payload_bytes") == 0), empty).otherwise(chunks).alias("chunks"))
    rows = parts.withColumn("n", F.size("chunks")).select("*", F.posexplode("chunks").alias("at", "chunk")).drop("chunks")
    first, many, revisit = F.col("at") == 0, F.col("n") > 1, F.col("refers_to").isNotNull()
    http = F.when(first, F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))).otherwise("")
    url = F.regexp_replace("url", r"[\r\n]", "")
    identifier = F.when(first, F.col("record_id")).otherwise(F.concat(F.rtrim("record_id", F.lit(">")), F.lit(":segment:"), (F.col("at") + 1).cast("string"), F.lit(">")))
    kind = F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")
    header = F.concat(
        F.lit(VERSION),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", identifier),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.when(F.trim(url) != "", url)),
        _line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("payload_digest")))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(":"), F.col("payload_digest"), F.lit(">"))),
        _line("WARC-Segment-Number", F.when(many, (F.col("at") + 1).cast("string"))),
        _line("WARC-Segment-Origin-ID", F.when(~first, F.col("record_id"))),
        _line("WARC-Segment-Total-Length", F.when(many & (F.col("at") + 1 == F.col("n")), F.col("payload_bytes").cast("string"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.octet_length("chunk")).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(header, http, F.col("chunk").cast("string")).alias("value"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, chunk_bytes: int = 1 << 20, compression: str = "gzip") -> None:
    """Write every row of ``pages`` (page_id, url, html) to WARC files in a new folder."""
    record_texts(plan_records(pages, min_bytes), chunk_bytes).write.option("lineSep", END).option("compression", compression).text(folder)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Record identifier and chunk number rows of an archive folder, with their payload bytes and headers."""
    lines = spark.read.option("lineSep", END + VERSION).text(folder)
    value = F.when(F.startswith("value", F.lit(VERSION)), F.substring(F.col("value").cast("binary"), F.lit(len(VERSION) + 1), F.octet_length("value"))).otherwise(F.col("value").cast("binary"))
    df = lines.select(value.alias("record")).select("record", F.substring_index(F.col("record").cast("string"), END, 1).alias("head"))
    df = df.select("record", F.octet_length("head").alias("n"), F.str_to_map("head", F.lit("\r\n"), F.lit(": ")).alias("h"))
    block = F.substring(F.col("record"), F.col("n") + len(END) + 1, F.col("h")["Content-Length"].cast("int"))
    df = df.select("h", block.alias("block")).select("h", "block", F.when(F.col("h")["WARC-Type"] != "continuation", F.substring_index(F.col("block").cast("string"), END, 1)).alias("http"))
    skip = F.coalesce(F.octet_length("http") + len(END), F.lit(0))
    number = lambda c: F.regexp_extract(c, "<urn:page:([0-9-]+)", 1)
    origin = F.coalesce(F.col("h")["WARC-Segment-Origin-ID"], F.col("h")["WARC-Record-ID"])
    return df.select(
        origin.alias("record_id"),
        F.nullif(number(origin), F.lit("")).cast("bigint").alias("page_id"),
        F.col("h")["WARC-Type"].alias("record_type"),
        F.col("h")["WARC-Segment-Number"].cast("int").alias("chunk_no"),
        F.col("h")["WARC-Segment-Total-Length"].cast("bigint").alias("total"),
        F.substring(F.col("h")["WARC-Payload-Digest"], 6, 32).alias("declared"),
        F.nullif(number(F.coalesce(F.col("h")["WARC-Refers-To"], F.lit(""))), F.lit("")).cast("bigint").alias("refers_to"),
        F.nullif(F.regexp_extract(F.coalesce("http", F.lit("")), "Content-Length: ([0-9]+)", 1), F.lit("")).cast("bigint").alias("http_length"),
        F.substring(F.col("block"), skip + 1, F.octet_length("block")).alias("chunk"),
    )


def running_digests(chunks: DataFrame) -> DataFrame:
    """Per chunk of a segmented payload: bytes and digest up to it. Chunks stream by in order; only the hash state is carried."""
    import pyarrow as pa

    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, state, length, declared = None, None, 0, None
        for batch in batches:
            out = []
            for record, page, no, total, said, chunk in zip(*(batch.column(i) for i in range(6)), strict=True):
                record, no = record.as_py(), no.as_py()
                if record != owner:
                    owner, state, length, declared = record, hashlib.sha1(), 0, said.as_py()
                data = chunk.as_buffer()
                state.update(data)
                length += data.size
                out.append((record, page.as_py(), no, length, base64.b32encode(state.digest()).decode(), total.as_py() is not None, declared))
            types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    rows = chunks.select("record_id", "page_id", "chunk_no", "total", "declared", "chunk")
    return rows.repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = 1 << 20, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC archives, read them back, and give one row per record.

    Columns: page_id, payload_bytes, payload_digest (recomputed from what was read, for a revisit as
    declared), record_type, refers_to, intact. Null html is an empty payload and null urls are left
    out of the header. Every row is a record of its own: rows that repeat a page_id with the same
    payload are all responses if they have the largest id. A null id is less than any other, so
    rows with a null id are responses only where no other page has their payload. An empty table
    gives none; further columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or f"{scratch_folder(spark)}/warc/{uuid.uuid4().hex}"
    write_archives(pages, folder, min_bytes, chunk_bytes)
    chunks = read_chunks(spark, folder)
    whole = chunks.filter("chunk_no is null")
    digest = base32_digest(F.col("chunk"))
    revisit = F.col("record_type") == "revisit"
    single = whole.select(
        "page_id", F.when(revisit, F.col("http_length")).otherwise(F.octet_length("chunk").cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.col("declared")).otherwise(digest).alias("payload_digest"), "record_type", "refers_to",
        (revisit | ((digest == F.col("declared")) & (F.octet_length("chunk") == F.col("http_length")))).alias("intact"),
    )
    long = running_digests(chunks.filter("chunk_no is not null")).filter("last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), F.lit("response").alias("record_type"),
        F.lit(None).cast("bigint").alias("refers_to"), (F.col("digest_so_far") == F.col("declared")).alias("intact"),
    )
    return single.unionByName(long)
