"""WARC archives of pages: one gzip member per record, and a sequential reader that verifies what it reads.

A record of equal payload to another's (1000 bytes or more; the page with the largest id is the response) is a revisit
that names it. The reader decompresses members one after another with a fixed-size buffer, frames records by their
content length and checks the digests of block and payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_with_hot_keys, shuffle_partitions
from .token_output import open_shared

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    name = (record_id or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(name) if re.fullmatch(r"-?\d+", name) else None


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """The gzip member of one record; ``refers_to`` makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


class WarcReader:
    """Records of one archive in order: (headers, block). Raises ValueError where framing or a digest is wrong."""

    def __init__(self, stream, chunk: int = 1 << 16):
        self.stream, self.chunk, self.waiting = stream, chunk, b""

    def _members(self) -> Iterator["_Member"]:
        while True:
            if not self.waiting:
                self.waiting = self.stream.read(self.chunk)
            if not self.waiting:
                return
            yield _Member(self)

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for member in self._members():
            head = member.until(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise ValueError("no WARC record where one should begin")
            headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            if not re.fullmatch(r"\d+", headers.get("content-length", "")):
                raise ValueError("record without a content length")
            block = member.take(int(headers["content-length"]))
            if member.take(4) != b"\r\n\r\n" or member.more():
                raise ValueError("record does not end where its content length says")
            if headers.get("warc-block-digest", _sha1(block)) != _sha1(block):
                raise ValueError(f"block digest differs in {headers.get('warc-record-id')}")
            yield headers, block


class _Member:
    """One gzip member, decompressed as far as asked for."""

    def __init__(self, reader: WarcReader):
        self.reader, self.inflate, self.data = reader, zlib.decompressobj(31), bytearray()

    def _grow(self) -> bool:
        if self.inflate.eof:
            return False
        r = self.reader
        raw = self.inflate.unconsumed_tail or r.waiting or r.stream.read(r.chunk)
        if not raw:
            raise ValueError("archive ends inside a record")
        try:
            self.data += self.inflate.decompress(raw, r.chunk * 4)
        except zlib.error as e:
            raise ValueError(f"damaged gzip member: {e}") from e
        r.waiting = self.inflate.unused_data if self.inflate.eof else b""
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.data.find(mark)) < 0:
            if not self._grow():
                raise ValueError("record head does not end")
        out = bytes(self.data[:at])
        del self.data[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) < n and self._grow():
            pass
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def more(self) -> bool:
        while not self.data and self._grow():
            pass
        return bool(self.data)


def write_warc(pages: DataFrame, least_bytes: int = 1000, most_file_bytes: int = 256 << 20, level: int = 6) -> DataFrame:
    """Archives of ``pages(page_id, url, html)``; returns their manifest (path, n_records, bytes).

    A null html is an empty payload; a null url has no target; a null page_id is kept as such and is never the response
    that others name, unless all of its equals have null ids. Rows that repeat the largest page_id of their payload are
    each the response. Other columns are not read. An empty table has no files.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc", keep=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= least_bytes, F.sha1(F.col("html").cast("binary")))
    equal = rows.select("page_id", digest.alias("digest")).filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keep"))
    equal = scratch.table("equal", equal.filter("n > 1 and keep is not null"))
    marked = join_with_hot_keys(rows.withColumn("digest", digest), equal, "digest", "n", "page_id")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("keep")), F.col("keep"))
    folder = f"{scratch.path}/files"

    def write(batches):
        out = path = None
        count = 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    path, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0  # of one attempt; the manifest names the ones that count
                    out = open_shared(path, "w")
                out.write(make_record(page_id, url, html.encode(), refers_to, level))
                count += 1
                if out.tell() >= most_file_bytes:
                    yield pa.record_batch([[path], [count], [out.tell()]], ["path", "n_records", "bytes"])
                    out.close()
                    out = None
        if out is not None:
            yield pa.record_batch([[path], [count], [out.tell()]], ["path", "n_records", "bytes"])
            out.close()

    return scratch.table("manifest", marked.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(write, "path string, n_records long, bytes long"))


def read_warc(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the archives: page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to, and the payload of responses if asked for."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_shared(path, "r") as stream:
                    held: list[tuple] = []
                    size = 0
                    for head, block in WarcReader(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind = head["warc-type"]
                        length = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
                        if kind == "response" and (length != len(payload) or head["warc-payload-digest"] != _sha1(payload)):
                            raise ValueError(f"payload differs from its digest in {head['warc-record-id']}")
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        row = (_page_id(head["warc-record-id"]), head.get("warc-target-uri"), length, digest, kind, _page_id(head.get("warc-refers-to")))
                        held.append((*row, payload if kind == "response" else None) if with_payload else row)
                        size += len(payload)
                        if len(held) >= 5000 or with_payload and size > 32 << 20:
                            yield _rows(held, with_payload)
                            held, size = [], 0
                    if held:
                        yield _rows(held, with_payload)

    n = max(1, min(manifest.count(), 8 * shuffle_partitions(manifest.sparkSession)))
    return manifest.select("path").repartition(n, "path").mapInArrow(read, schema)


def _rows(held: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    n = 6 + with_payload
    return pa.record_batch([pa.array([r[k] for r in held], kinds[k]) for k in range(n)], names[:n])
