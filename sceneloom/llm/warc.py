"""WARC archives: deduplicated records, one gzip member a record, and an index of offsets.

Archives are first written as one gzip stream each (monolithic, as `gzip` makes them of a whole file);
nothing in such a file can be reached without inflating all before it. The normaliser inflates a stream
once, from start to end, holding one record at a time, rewrites every record as a gzip member of its
own, and writes beside the archive an index with the offset, length, record id and URI of each member. Readers
then reach any record alone.

Payloads that are equal are stored once, as a `response` of the record with the largest id; the others
are `revisit` records that refer to it. Equality is found by digest in Spark; only digests and ids,
not payloads, are grouped.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import files
from .common import checkpointed, if_few, whole_number_ids

#: Bytes read from an archive at a time, and rows turned into records at a time.
READ_BYTES, ROWS = 1 << 18, 64
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def with_types(pages: DataFrame, least_bytes: int = 0, id_column: str = "page_id", payload_column: str = "html", url_column: str = "url") -> DataFrame:
    """Rows (page_id, url, payload, refers_to): refers_to is the record that holds the payload, null for a response.

    Of rows with equal payloads of at least least_bytes bytes, the largest id is the response. A null payload
    is an empty one. Rows of one id and equal payloads are all responses if theirs is the largest id. A null id is smaller than
    none and refers to nothing. Ids have to be whole numbers.
    """
    whole_number_ids(pages, id_column)
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit(""))
    pages = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    digest = F.sha2("payload", 256)
    ids = checkpointed(pages.filter(F.octet_length("payload") >= least_bytes).select("page_id", digest.alias("digest")))
    # Payloads that repeat, and the rows that refer to them: a row an id, of a digest and two numbers.
    largest = ids.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    refers = if_few(checkpointed(largest.select("digest", "largest")))
    # The id is part of the key, so that many copies of one page don't meet in one task.
    revisits = ids.join(refers, "digest").filter("page_id < largest").select(F.col("page_id").alias("id"), F.col("digest").alias("of"), F.col("largest").alias("refers_to")).distinct()
    revisits = if_few(checkpointed(revisits))
    return pages.join(revisits, (F.col("page_id") == F.col("id")) & (digest == F.col("of")), "left").select("page_id", "url", "payload", "refers_to")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head of its payload, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    url = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[-2:-2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + END + block + END


class Records:
    """Splits inflated bytes, as they come, into whole records."""

    def __init__(self):
        self.rest = bytearray()
        self.needed = 0
        self.number, self.offset = 0, 0

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.rest += data
        while len(self.rest) >= max(self.needed, 1):
            if not self.needed:
                at = self.rest.find(END)
                if at < 0:
                    return
                size = self.named(header(bytes(self.rest[:at])), "content-length")
                if not (size.isascii() and size.isdigit()):
                    raise ValueError(f"{self}: the Content-Length is {size!r}")
                self.needed = at + len(END) + int(size) + len(END)
                continue
            found = bytes(self.rest[: self.needed])
            yield found
            self.number, self.offset = self.number + 1, self.offset + self.needed
            del self.rest[: self.needed]
            self.needed = 0

    def __str__(self) -> str:
        return f"record {self.number} at byte {self.offset}"

    def named(self, fields: dict[str, str], name: str) -> str:
        """A field of the present record's head; one without it is an error."""
        if name not in fields:
            raise ValueError(f"{self} has no {name.title()}")
        return fields[name]


def header(head: bytes) -> dict[str, str]:
    """The named fields of a WARC or HTTP head, names in lower case."""
    lines = head.decode().split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parsed(found: bytes) -> dict[str, object]:
    """What a record says of itself: page_id, payload_bytes, payload_digest, record_type and refers_to, and its payload."""
    head, _, rest = found.partition(END)
    fields = header(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(END)
    number = lambda name: None if (x := fields.get(name, "<urn:page:null>")[10:-1]) == "null" else int(x)
    return {
        "page_id": number("warc-record-id"),
        "payload_bytes": int(header(http)["content-length"]),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": fields["warc-type"],
        "refers_to": number("warc-refers-to"),
        "payload": payload,
    }


def normalise(monolith: BinaryIO, out: BinaryIO) -> list[dict[str, object]]:
    """Rewrites a gzip stream of records with a member for each; for each its offset, length, record id and URI.

    The input is inflated once. It may itself be of several members, with zero bytes after the last one. A stream that ends
    before its last member does, or inside a record, is a ValueError, and so is a record without a Content-Length or a WARC-Record-ID, or
    with a length that is no number; the error has the record's number and its place in the inflated bytes.
    """
    index, at, records, inflate = [], 0, Records(), zlib.decompressobj(31)
    begun = False  # whether a member has begun that has not ended

    def rewrite(data: bytes) -> None:
        nonlocal at
        for found in records.feed(data):
            deflate = zlib.compressobj(LEVEL, wbits=31)
            member = deflate.compress(found) + deflate.flush()
            out.write(member)
            fields = header(found.partition(END)[0])
            index.append({"offset": at, "length": len(member), "id": records.named(fields, "warc-record-id"), "uri": fields.get("warc-target-uri", "")})
            at += len(member)

    while data := monolith.read(READ_BYTES):
        while data := data if begun else data.lstrip(b"\0"):
            begun = True
            rewrite(inflate.decompress(data, READ_BYTES))
            while inflate.unconsumed_tail and not inflate.eof:
                rewrite(inflate.decompress(inflate.unconsumed_tail, READ_BYTES))
            data = inflate.unused_data
            if inflate.eof:
                inflate, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("the archive ends inside a gzip member")
    if records.rest:
        raise ValueError("the archive ends inside a record")
    return index


def write(pages: DataFrame, folder: str, **columns) -> list[tuple[str, int]]:
    """Writes normalised archives with their indices; the archives, with the number of records in each.

    Each task writes its rows as a monolithic archive, normalises that and deletes it. Beside
    part-N.warc.gz stands part-N.index.json, a line {"offset", "length", "id", "uri"} for each record.
    """
    files.make_folder(folder)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        name, monolith = f"{folder}/part-{part:06d}", f"{folder}/part-{part:06d}-{attempt}.whole.gz"
        deflate = zlib.compressobj(LEVEL, wbits=31)
        with files.writing(monolith) as out:
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    for row in zip(*(c.slice(start, ROWS).to_pylist() for c in batch.columns), strict=True):
                        page_id, url, payload, refers_to = row
                        out.write(deflate.compress(record(page_id, url, payload.encode(), refers_to)))
            out.write(deflate.flush())
        with files.reading(monolith) as found, files.writing(f"{name}.warc.gz") as out:
            index = normalise(found, out)
        with files.writing(f"{name}.index.json") as out:
            for entry in index:
                out.write(json.dumps(entry).encode() + b"\n")
        files.delete(monolith)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64())], names=["file", "n"])

    made = with_types(pages, **columns).mapInArrow(of, "file string, n long").collect()  # one row a file
    return [(row.file, row.n) for row in sorted(made) if row.n]


def read(spark: SparkSession, written: list[tuple[str, int]]) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to, payload), each read by its index entry.

    A revisit has an empty payload here; its bytes and digest are those of the full one.
    """
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()], names=list(kinds))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.reading(f"{name}.index.json") as found:
                    index = [json.loads(line) for line in found.read().splitlines()]
                with files.reading(f"{name}.warc.gz") as found:
                    rows = []
                    for entry in index:
                        found.seek(entry["offset"])
                        rows.append(parsed(zlib.decompress(found.read(entry["length"]), 31)))
                        if len(rows) == ROWS:
                            yield batch_of(rows)
                            rows = []
                    yield batch_of(rows)

    parts = spark.createDataFrame([(name,) for name, _ in written], "file string").repartition(max(1, len(written)))
    return parts.mapInArrow(of, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
