"""WARC (6): a chunked record table.

Each record is a gzip member holding a WARC/1.1 record, cut into rows (record_id, chunk_no,
is_last, data, running_digest): the rows of an archive, joined in order, are a valid .warc.gz
file. Payloads are encoded, hashed and compressed piece by piece, so that no task holds a whole
compressed record, and readers hold one chunk and the running digest.

running_digest is the SHA-256 of the record's bytes up to the end of the chunk. The reader keeps
the same digest: a chunk that is missing, out of order, of another record or changed raises an
error, and so does a record that its partition doesn't finish.

Of records with equal payloads of at least min_revisit bytes, the one with the smallest id is a
response and the others are revisits without a body that refer to it. The table of revisits is
written; Spark broadcasts it where its size allows that and shuffles the payloads otherwise.

Cases: a null payload is empty; a null URL has no target header; control characters and spaces
in URLs are percent-encoded in the header. Rows that repeat id and payload are responses alike.
A row without an id revisits the smallest id of its payload, if there is one. Ids are longs.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CHUNK_SCHEMA = "record_id string, chunk_no int, is_last boolean, data binary, running_digest string"
CHUNK_COLUMNS = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Characters of payload taken at a time, bytes of a chunk row, and bytes of rows given on at once.
PIECE, CHUNK, BATCH = 1 << 16, 1 << 18, 1 << 22
CRLF = b"\r\n"


def record_header(page_id, url, payload_bytes: int, digest: str, refers_to, when: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    fields = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {when}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    fields += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {payload_bytes}"]
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    fields.append(f"Content-Length: {payload_bytes if refers_to is None else 0}")
    return "\r\n".join(fields).encode() + CRLF * 2


def member_chunks(header: bytes, payload: str, chunk: int = CHUNK) -> Iterator[tuple[int, bool, bytes, str]]:
    """The gzip member of one record as (chunk_no, is_last, data, digest of the member so far)."""
    packer, digest, held, number = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha256(), bytearray(), 0

    def cut(last: bool) -> tuple[int, bool, bytes, str]:
        nonlocal number
        data = bytes(held[:chunk])
        del held[:chunk]
        digest.update(data)
        number += 1
        return number - 1, last, data, digest.hexdigest()

    held += packer.compress(header)
    for at in range(0, len(payload), PIECE):
        held += packer.compress(payload[at : at + PIECE].encode("utf-8", "surrogatepass"))
        while len(held) > chunk:
            yield cut(False)
    held += packer.compress(CRLF * 2) + packer.flush()
    while len(held) > chunk:
        yield cut(False)
    yield cut(True)


def _missing(x) -> bool:
    return x is None or x != x or x is pd.NA


def write_chunks(when: str, chunk: int = CHUNK):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        part, row, rows, size = context.partitionId() if context else 0, 0, [], 0
        for batch in batches:
            for page_id, url, html, length, digest, refers_to in batch.itertuples(index=False):
                number = lambda x: None if _missing(x) else int(x)
                header = record_header(number(page_id), None if _missing(url) else url, int(length), digest, number(refers_to), when)
                for chunk_no, last, data, so_far in member_chunks(header, html if _missing(refers_to) else "", chunk):
                    rows.append((f"{part}-{row}", chunk_no, last, data, so_far))
                    size += len(data)
                    if size > BATCH:
                        yield pd.DataFrame(rows, columns=CHUNK_COLUMNS)
                        rows, size = [], 0
                row += 1
        yield pd.DataFrame(rows, columns=CHUNK_COLUMNS)

    return run


class RecordReader:
    """One record, chunk by chunk: header, then the payload's digest and length as they pass."""

    def __init__(self, record_id: str) -> None:
        self.record_id, self.next_chunk, self.member = record_id, 0, hashlib.sha256()
        self.unpack, self.head, self.fields, self.digest, self.seen, self.tail = zlib.decompressobj(31), b"", None, hashlib.sha256(), 0, b""

    def add(self, record_id: str, chunk_no: int, data: bytes, running_digest: str) -> None:
        if record_id != self.record_id or chunk_no != self.next_chunk:
            raise ValueError(f"WARC record {self.record_id}: chunk {self.next_chunk} is missing, chunk {chunk_no} of {record_id} follows")
        self.member.update(data)
        if self.member.hexdigest() != running_digest:
            raise ValueError(f"WARC record {record_id}: chunk {chunk_no} does not match its digest")
        self.next_chunk += 1
        while data:
            plain = self.unpack.decompress(data, PIECE)
            data = self.unpack.unconsumed_tail
            if not plain and not data:
                break
            self._plain(plain)

    def _plain(self, plain: bytes) -> None:
        if self.fields is None:
            self.head += plain
            head, mark, rest = self.head.partition(CRLF * 2)
            if not mark:
                return
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            self.fields, self.head, plain = dict(x.split(": ", 1) for x in lines[1:]), b"", rest
        body = plain[: max(0, int(self.fields["Content-Length"]) - self.seen)]
        self.digest.update(body)
        self.seen += len(body)
        self.tail += plain[len(body) :]

    def row(self) -> tuple:
        if self.fields is None or not self.unpack.eof or self.seen != int(self.fields["Content-Length"]) or self.tail != CRLF * 2:
            raise ValueError("a truncated WARC record")
        f = self.fields
        digest, number = f["WARC-Payload-Digest"].removeprefix("sha256:"), lambda k: int(m[1]) if (m := re.search(r":(-?\d+)>", f.get(k, ""))) else None
        if f["WARC-Type"] == "response" and digest != self.digest.hexdigest():
            raise ValueError("a payload does not match its digest")
        return number("WARC-Record-ID"), f.get("WARC-Target-URI"), int(f["X-Payload-Length"]), digest, f["WARC-Type"], number("WARC-Refers-To")


def read_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a record follow each other in the order of chunk_no; a partition holds whole records."""
    columns = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    reader = None
    for batch in batches:
        rows = []
        for record_id, chunk_no, last, data, digest in batch[CHUNK_COLUMNS].itertuples(index=False):
            reader = reader or RecordReader(record_id)
            reader.add(record_id, chunk_no, data, digest)
            if last:
                rows.append(reader.row())
                reader = None
        yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})
    if reader:
        raise ValueError(f"WARC record {reader.record_id}: chunk {reader.next_chunk} is missing, nothing follows")


def to_chunks(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 100, when: str = "1970-01-01T00:00:00Z", chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of the pages' records."""
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("length"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))
    large = rows.where(F.col("length") >= min_revisit).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").select("digest", "refers_to")
    again = large.join(first, "digest").where("page_id is null or page_id > refers_to").distinct()
    again = written(again, "revisits").select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to")
    marked = rows.join(again, rows.page_id.eqNullSafe(again.again_id) & (rows.digest == again.again_digest), "left")
    return marked.select("page_id", "url", "html", "length", "digest", "refers_to").mapInPandas(write_chunks(when, chunk), CHUNK_SCHEMA)


def read_records(chunks: DataFrame) -> DataFrame:
    """Records of one chunk are read where they are; only the chunks of longer ones are shuffled."""
    whole = chunks.where("chunk_no = 0 and is_last").select(CHUNK_COLUMNS)
    parts = chunks.where("not (chunk_no = 0 and is_last)").repartition("record_id").sortWithinPartitions("record_id", "chunk_no").select(CHUNK_COLUMNS)
    return whole.mapInPandas(read_chunks, RECORD_SCHEMA).unionByName(parts.mapInPandas(read_chunks, RECORD_SCHEMA))


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages' archive to the shared folder and reads it back."""
    return read_records(written(to_chunks(pages, **options), "warc"))
