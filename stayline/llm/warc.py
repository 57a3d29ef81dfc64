"""WARC archives of pages: one gzip member per record, written and read record by record.

``write`` makes one archive per task, in the shared folder, through Arrow's file systems; an archive is
written under a name of its own attempt and only those of attempts that succeeded are listed, so retried
tasks leave no duplicate.  Of records with equal payloads of at least ``revisit_bytes`` bytes, the one with
the largest id is the response, the others are revisits that refer to it; the choice needs digests and
ids only.  ``read`` goes through each archive from its start: zlib inflates members as blocks come,
Content-Length frames the record, and the digests of block and payload are verified.

Defined cases: a null page is an empty payload; a null id is written as an empty name and counts as the
smallest; rows with equal ids and payloads are all written and all alike; a null url is left out; other columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES = 1000
#: Bytes read from an archive at a time.
CHUNK = 1 << 16
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:page:"


class Damaged(ValueError):
    """An archive that does not hold what it says."""


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member.  A revisit holds the headers of the response without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{NAME}{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else "".join(url.split())),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", f"<{NAME}{refers_to}>" if revisit else None),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + END) + squeeze.flush()


def members(source) -> Iterator[bytes]:
    """The inflated members of a gzip stream, each as it ends; ``source`` has read(n)."""
    inflate, parts, begun = zlib.decompressobj(31), [], False
    while data := source.read(CHUNK):
        while data:
            begun = True
            try:
                parts.append(inflate.decompress(data))
            except zlib.error as error:
                raise Damaged(str(error)) from error
            data = b""
            if inflate.eof:
                yield b"".join(parts)
                data, begun = inflate.unused_data, False
                inflate, parts = zlib.decompressobj(31), []
    if begun:
        raise Damaged("the last member is cut off")


def _headers(data: bytes) -> tuple[str, dict[str, str], int]:
    end = data.find(END)
    if end < 0:
        raise Damaged("headers without an end")
    first, *lines = data[:end].decode().split("\r\n")
    pairs = (line.partition(":") for line in lines)
    return first, {k.strip().lower(): v.strip() for k, _, v in pairs}, end + len(END)


def parse(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """A record's headers, its payload (none for a revisit) and the full payload's length, all verified."""
    version, fields, at = _headers(member)
    if not version.startswith("WARC/"):
        raise Damaged(f"not a record: {version[:20]}")
    block, rest = member[at : at + int(fields["content-length"])], member[at + int(fields["content-length"]) :]
    if len(block) != int(fields["content-length"]) or rest != END:
        raise Damaged("the length of the block is wrong")
    if _sha1(block) != fields["warc-block-digest"]:
        raise Damaged("the block's digest is wrong")
    _, http, begin = _headers(block)
    payload = block[begin:]
    if fields["warc-type"] == "response" and (
        len(payload) != int(http["content-length"]) or _sha1(payload) != fields["warc-payload-digest"]
    ):
        raise Damaged("the payload is not what its length and digest say")
    return fields, payload, int(http["content-length"])


def _responses(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """``pages`` (page_id, url, payload, digest) with refers_to, null for responses.

    Only digests of payloads that come twice or more are joined back, each once, so a payload that a
    third of all pages share is counted by partial aggregates and split by adaptive joins.
    """
    long = pages.filter(F.length("payload") >= revisit_bytes)
    best = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    best = best.filter("n > 1").drop("n")
    out = pages.join(best, "digest", "left")
    revisit = (F.length("payload") >= revisit_bytes) & F.col("refers_to").isNotNull()
    revisit = revisit & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return out.withColumn("refers_to", F.when(revisit, F.col("refers_to")))


def write(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, date: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in ``folder``; returns their list (file, records), written too."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload)
    rows = _responses(rows.withColumn("digest", F.sha1("payload")), revisit_bytes)
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, where = fs.FileSystem.from_uri(folder)
        name, out, n = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for page_id, url, payload, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or own.open_output_stream(f"{where}/{name}", compression=None)
                out.write(record(page_id, url, payload, to, to is not None, date))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "records"])

    listed = rows.select("page_id", "url", "payload", "refers_to").mapInArrow(archive, "file string, records long")
    listed.write.parquet(f"{folder}/list")
    return pages.sparkSession.read.schema(listed.schema).parquet(f"{folder}/list")


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all listed archives, each archive read by one task from start to end.

    ``payload_digest`` is hexadecimal; ``payload`` is null for revisits, or without ``payloads``.
    """

    def named(field: str | None) -> int | None:
        text = (field or "").removeprefix(f"<{NAME}").removesuffix(">")
        return int(text) if text else None

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, where = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in RECORDS.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for file, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                with own.open_input_stream(f"{where}/{file}", compression=None) as source:
                    for member in members(source):
                        fields, payload, length = parse(member)
                        kind = fields["warc-type"]
                        digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                        kept = payload if payloads and kind == "response" else None
                        to, url = named(fields.get("warc-refers-to")), fields.get("warc-target-uri")
                        rows.append((named(fields["warc-record-id"]), url, kind, to, length, digest, kept))
                        n, size = n - 1, size + len(kept or b"")
                        if len(rows) >= 1000 or size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)
                if n:
                    raise Damaged(f"{file} does not hold the records listed")

    files = spark.read.parquet(f"{folder}/list").select("file", "records")
    many = max(1, files.count())
    return files.repartition(many, "file").mapInArrow(records, RECORDS)
