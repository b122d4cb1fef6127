"""WARC archives: records, readers, and revisit resolution over payload digests.

Every record is its own gzip member. Rows of a partition become one file through Spark's text
writer, whose row separator here is an empty gzip member, which decompresses to nothing.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from casegrid.llm.binfiles import read_files, write_records
from casegrid.llm.bytetext import chunks
from casegrid.session import scratch_path

# The gzip member of no bytes.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
LEVEL = 3  # of compression
MIN_PAYLOAD = 100  # bytes from which equal payloads are stored once
RECORDS_PER_FILE = 20_000
BATCH_BYTES = 8 << 20
# Fixed value: the profile of a revisit with an identical payload (WARC 1.1, section 6.7.2).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # of records whose source has no capture time

HEADERS = (
    "record_id string, warc_type string, uri string, warc_date string, page_id bigint, payload_digest string,"
    " payload_bytes bigint, refers_to_id string"
)


def _packed(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _record(fields: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    data = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return _packed(data, level)


def _line(value: str | None) -> str | None:
    """A header value has to be one line."""
    return None if value is None else " ".join(value.split())


def _response(record_id, uri, date, page_id, digest, payload: bytes, level: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record([
        ("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", page_id),
    ], http + payload, level)


def _revisit(record_id, uri, date, page_id, digest, to_id, to_uri, to_date, level: int) -> bytes:
    return _record([
        ("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Profile", PROFILE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Refers-To", f"<{to_id}>"),
        ("WARC-Refers-To-Target-URI", to_uri), ("WARC-Refers-To-Date", to_date),
        ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", page_id),
    ], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", level)


def write_pages(pages: DataFrame, path: str, level: int = LEVEL) -> None:
    """A response record for every row of ``pages(page_id, url, html)``; a null html is an empty payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, partition = 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in chunks(batch, "html", BATCH_BYTES):
                values = []
                for page_id, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    payload, number = html or b"", number + 1
                    digest = hashlib.sha256(payload).hexdigest()
                    record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{partition}/{number}/{page_id}/{digest}").urn
                    values.append(_response(record_id, _line(url), DATE, page_id, digest, payload, level))
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").cast("binary").alias("html"))
    write_records(rows.mapInArrow(run, "value binary"), path, EMPTY_MEMBER, RECORDS_PER_FILE)


def _members(data: memoryview, step: int = 1 << 15) -> Iterator[tuple[bytes, bytes]]:
    """The records of a file: their contents, and the gzip members that hold them."""
    at = 0
    if bytes(data[:5]) == b"WARC/":
        while at < len(data):
            near = bytes(data[at : at + (1 << 16)])
            head = near.index(b"\r\n\r\n") + 4
            size = next(int(x.split(b":")[1]) for x in near[:head].split(b"\r\n") if x.lower().startswith(b"content-length:"))
            whole = bytes(data[at : at + head + size])
            yield whole, _packed(whole, 1)
            at += head + size + 4
        return
    while at < len(data):
        member, out, begin = zlib.decompressobj(31), [], at
        while not member.eof:
            if at >= len(data):
                raise ValueError("an archive ends inside a record")
            out.append(member.decompress(data[at : at + step]))
            at = min(len(data), at + step)
        at -= len(member.unused_data)
        whole = b"".join(out)
        if whole:
            yield whole, bytes(data[begin:at])


def _parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the payload (the block without its HTTP head)."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return fields, block


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def read_archives(spark: SparkSession, path: str, members: bool = False) -> DataFrame:
    """Headers of the response, resource and revisit records below ``path``, and their gzip members if asked for.

    ``payload_digest`` of a record with a payload is computed from it; a revisit's is the one in its
    header. ``payload_bytes`` of a revisit is null: it is that of the response it refers to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for whole, member in _members(memoryview(content.as_buffer())):
                    fields, payload = _parse(whole)
                    kind = fields.get("warc-type")
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    full = kind != "revisit"
                    stated = fields.get("warc-payload-digest", "").partition(":")[2] or None
                    page = fields.get("x-page-id")
                    row = (
                        _bare(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), fields.get("warc-date"),
                        int(page) if page is not None else None, hashlib.sha256(payload).hexdigest() if full else stated,
                        len(payload) if full else None, _bare(fields.get("warc-refers-to")),
                    )
                    rows.append(row + (member,) if members else row)
                    size += len(payload)
                    if size > BATCH_BYTES or len(rows) >= 5000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = HEADERS + ", member binary" * members
    names = [c.split()[0] for c in schema.split(",")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(",")]
    return read_files(spark, path).select("content").mapInArrow(run, schema)


def resolve(headers: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """The records that become revisits: ``record_id, to_id, to_uri, to_date``.

    Among responses with one payload digest of at least ``min_payload`` bytes the one with the smallest
    page id stays (null last, then by record id); an input revisit joins the response of its digest
    likewise. Only headers are shuffled. Originals are combined before the shuffle, so that a payload
    that fills a third of the archives is one row per task; the join back splits skewed digests.
    """
    rank = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "record_id", "uri", "warc_date")
    stored = F.when(F.col("warc_type") != "revisit", rank)
    originals = (
        headers.groupBy("payload_digest")
        .agg(F.min(stored).alias("first"), F.max("payload_bytes").alias("size"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & (F.col("size") >= min_payload))
        .select("payload_digest", *(F.col(f"first.{a}").alias(b) for a, b in (("record_id", "to_id"), ("uri", "to_uri"), ("warc_date", "to_date"))))
    )
    return (
        headers.select("payload_digest", "record_id").join(originals, "payload_digest")
        .where("record_id <> to_id").select("record_id", "to_id", "to_uri", "to_date")
    )


def deduplicate(spark: SparkSession, source: str, target: str, min_payload: int = MIN_PAYLOAD, level: int = LEVEL) -> None:
    """Rewrite the archives below ``source`` to ``target`` with every repeated payload as a revisit.

    Records travel once at most and compressed, by record id, which no two records share.
    """
    # Written first, so that its size is known: few revisits are broadcast and the records stay in place.
    decisions = scratch_path(spark, "revisits")
    resolve(read_archives(spark, source), min_payload).write.parquet(decisions)
    decided = spark.read.parquet(decisions)
    records = read_archives(spark, source, members=True).join(decided, "record_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "member", BATCH_BYTES):
                values = []
                for r in part.to_pylist():
                    to = (r["to_id"], r["to_uri"], r["to_date"]) if r["to_id"] else (r["refers_to_id"], None, None)
                    common = (r["record_id"], r["uri"], r["warc_date"], r["page_id"], r["payload_digest"])
                    if r["to_id"] or r["warc_type"] == "revisit":
                        values.append(_revisit(*common, *to, level))
                    else:
                        payload = _parse(zlib.decompress(r["member"], 31))[1]
                        values.append(_response(*common, payload, level))
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])

    write_records(records.mapInArrow(run, "value binary"), target, EMPTY_MEMBER, RECORDS_PER_FILE)


def resolved_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per record of deduplicated archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Revisits are joined to the responses they refer to. Repeated rows of a page are records of their
    own: one is the response, the others refer to the same page id. A revisit whose response is in
    none of the archives keeps a null size and ``refers_to``.
    """
    headers = read_archives(spark, path)
    responses = headers.where("warc_type <> 'revisit'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes")
    )
    revisits = headers.where("warc_type = 'revisit'").drop("payload_bytes").join(responses, "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        headers.where("warc_type <> 'revisit'").withColumn("record_type", F.lit("response"))
        .withColumn("refers_to", F.lit(None).cast("bigint")).select(*columns)
        .unionByName(
            revisits.select("page_id", F.col("to_bytes").alias("payload_bytes"), "payload_digest",
                            F.lit("revisit").alias("record_type"), F.col("to_page").alias("refers_to"))
        )
    )
