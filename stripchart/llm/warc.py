"""Content-addressed WARC archive: payload bytes are stored once under their SHA-256, record
headers are kept exactly and apart, and records are put together again by a join on the digest.

The archive is two Parquet tables in one folder, `payloads` (digest, stored bytes) and `headers`
(page_id, digest, header bytes). Payloads are compressed before they are shuffled.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripchart.llm.common import new_path, over_partitions, stored, table

#: Records of one payload that are put together in one task: so many, or this share of all, of
#: which there are as many payloads with more at most.
TOGETHER, SHARES = 1024, 8192
#: Shorter payloads are always stored as responses.
REVISIT_FROM = 100
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Only headers of revisits hold this.
REVISIT = b"\r\nWARC-Profile: "
END = b"\r\n\r\n"
EPOCH = "1970-01-01T00:00:00Z"


def _payload(html: str) -> Column:
    return F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")


def record_types(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """row, page_id, url, digest, payload_bytes, record_type, refers_to for each page.

    Of the pages with equal payloads of at least 100 bytes the smallest page_id is the response.
    Rows that repeat that page_id are responses as well; a null page_id is never the smallest,
    and where all of a group's ids are null, all its rows are responses. A null html is an empty
    payload. Rows are numbered in a stored copy, without the payloads, and `response_row` is the
    number of the row that a revisit refers to.
    """
    found = stored(
        pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.sha2(_payload(html), 256).alias("digest"), F.octet_length(_payload(html)).cast("long").alias("payload_bytes"))
        .withColumn("row", F.monotonically_increasing_id()),
        "pages",
    )
    owners = (
        found.where(F.col("payload_bytes") >= REVISIT_FROM)
        .groupBy("digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("owner"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and owner is not null")
        .select("digest", "owner")
    )
    joined = found.join(owners, "digest", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("owner.page_id").eqNullSafe(F.col("page_id"))
    return joined.select(
        "row", "page_id", "url", "digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("owner.page_id")).alias("refers_to"),
        F.when(revisit, F.col("owner.row")).alias("response_row"),
    )


def record_id(page_id: Column, row: Column) -> Column:
    """A UUID made from the page's id and the row's number, so that rows which repeat an id have
    records of their own."""
    h = F.md5(F.concat_ws(" ", F.lit("stripchart page"), F.coalesce(page_id.cast("string"), F.lit("null")), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def headers_of(types: DataFrame) -> DataFrame:
    """page_id, digest, header: the exact bytes before each record's block. A target address
    with line breaks, or none, is written as far as a header line can hold it."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    none = F.lit("")
    header = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("row"))),
        line("WARC-Date", F.lit(EPOCH)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("refers_to"), F.col("response_row"))), line("WARC-Refers-To-Page", F.col("refers_to").cast("string")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(none),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return types.select("page_id", "digest", F.encode(header, "UTF-8").alias("header"))


def payloads_of(pages: DataFrame, html: str = "html", level: int = 6) -> DataFrame:
    """digest, stored: each distinct payload once, deflated where it is read. A task deflates a
    payload at its first copy and leaves out the others, so a hot one is shuffled once a task."""

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            digests, data = [], []
            for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (known := bytes.fromhex(digest)) not in met:
                    met.add(known)
                    digests.append(digest)
                    data.append(zlib.compress(payload.as_buffer(), level))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(data, pa.binary())], names=["digest", "stored"])

    source = pages.select(F.sha2(_payload(html), 256).alias("digest"), _payload(html).alias("payload"))
    return over_partitions(source, deflate, "digest string, stored binary").groupBy("digest").agg(F.first("stored").alias("stored"))


def write_archive(pages: DataFrame, path: str) -> str:
    """Write both tables of the archive in the folder `path`; no pages give two empty tables."""
    payloads_of(pages).write.option("compression", "none").parquet(f"{path}/payloads")
    headers_of(record_types(pages)).write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def _inflated(digest: str, data: bytes | None) -> bytes:
    if data is None:
        raise ValueError(f"payload {digest} is missing: the archive is damaged")
    payload = zlib.decompress(data)
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload {digest} is damaged")
    return payload


def _parts_of(headers: DataFrame) -> DataFrame:
    """digest, parts: into how many parts the records of a payload with very many are dealt. No
    more than SHARES payloads have so many."""
    together = max(TOGETHER, -(-headers.count() // SHARES))
    return headers.groupBy("digest").agg(F.ceil(F.count(F.lit(1)) / together).cast("int").alias("parts")).where("parts > 1")


def _joined(spark: SparkSession, path: str) -> DataFrame:
    """page_id, digest, header, stored: the join. Records with one payload follow each other."""
    headers = spark.read.schema("page_id long, digest string, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, stored binary").parquet(f"{path}/payloads")
    parts = F.broadcast(stored(_parts_of(headers), "parts"))
    dealt = headers.join(parts, "digest", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "header"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = payloads.join(parts, "digest", "left").withColumn("part", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))).drop("parts")
    return dealt.hint("merge").join(copies, ["digest", "part"], "left").select("page_id", "digest", "header", "stored")


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(page_id, record, payload) of the rows of each batch of _joined."""
    last, payload = None, b""
    for batch in batches:
        rows = []
        for page_id, digest, header, data in zip(*(c.to_pylist() for c in batch.columns)):
            if digest != last:
                last, payload = digest, _inflated(digest, data)
            rows.append((page_id, header + (b"" if REVISIT in header else payload) + END, payload))
        if rows:
            yield rows


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (the exact WARC record: header, block, two line ends) and payload (the
    full one, also of a revisit). A payload that does not hash to its digest stops the job: the
    archive is damaged."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rebuilt(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["page_id", "record", "payload"])

    return over_partitions(_joined(spark, path), build, "page_id long, record binary, payload binary")


FIELD = re.compile(rb"^(WARC-Type|WARC-Payload-Digest|WARC-Refers-To-Page|Content-Length): (.*)$", re.M)


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """(some fields of the header, block) of one record; ValueError where the block is not as
    long as the header says or the record does not end with it."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.decode(): v.rstrip(b"\r").decode() for k, v in FIELD.findall(head)}
    size = int(fields["Content-Length"])
    if len(rest) != size + len(END) or rest[size:] != END:
        raise ValueError("the record's length is not that of its block")
    return fields, rest[:size]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, payload_digest, payload_bytes, refers_to of each record, taken from
    the record that is put together again: the payload of a response is its block, that of a
    revisit the one its digest leads to, and both are hashed again."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        for rows in _rebuilt(batches):
            out = []
            for page_id, record, payload in rows:
                fields, block = parsed(record)
                whole = payload if fields["WARC-Type"] == "revisit" else block
                found = hashlib.sha256(whole).hexdigest()
                if fields["WARC-Payload-Digest"] != f"sha256:{found}":
                    raise ValueError(f"a record with payload {found} names another digest")
                to = fields.get("WARC-Refers-To-Page")
                out.append((page_id, fields["WARC-Type"], found, len(whole), None if to is None else int(to)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to"])

    return over_partitions(_joined(spark, path), read, "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long")


def op3_content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from records
    put together again out of an archive of all pages. Null html is an empty payload; repeated
    rows are records of their own; no pages give no rows; other columns are not looked at."""
    path = write_archive(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL for op3.
OP3_SQL = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages),
     o as (select page_id, n, html, min(page_id) over (partition by html) as owner from p)
select page_id, cast(n as bigint) as payload_bytes, sha256(html) as payload_digest,
       case when n >= 100 and owner <> page_id then 'revisit' else 'response' end as record_type,
       case when n >= 100 and owner <> page_id then owner end as refers_to
from o
"""
