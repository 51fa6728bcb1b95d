"""WARC archives: a writer that finds equal payloads and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batched, rows, saved, shared_dir
from ._files import opened, replacing

#: First bytes of a gzip member that is deflated.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id, url: str | None, payload: bytes, sha: str, refers_to, date: str) -> bytes:
    """A response with its payload or, given ``refers_to``, a revisit with the payload's headers only."""
    revisit = refers_to is not None
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return member(headers, http if revisit else http + payload)


def write_warc(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row and return the archives: path, bytes, records.

    Of rows with equal payloads (SHA-1 and length) of at least ``revisit_from``
    bytes, that with the smallest id is a response and the others revisit it;
    rows that repeat the smallest id are responses too. Null html is an empty
    payload, null url an empty target; a null id revisits unless no row with its
    payload has an id. Each task writes one file, under its final name only when
    complete. No rows give no records.
    """
    path = path or shared_dir(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("payload"), F.sha1(html).alias("sha"), F.length(html).alias("n"))
    # Narrow keys are grouped and saved by themselves: the payloads then meet a saved table, so that a payload of very many rows is split.
    repeats = keyed.groupBy("sha", "n").agg(F.min("id").alias("first"), F.count("*").alias("times")).where((F.col("times") > 1) & (F.col("n") >= revisit_from))
    repeats = saved(repeats.select("sha", "n", "first"), "warc-repeats")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    linked = keyed.join(repeats, ["sha", "n"], "left").select("id", "url", "payload", refers.alias("refers_to"))
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{path}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        size = count = 0
        with replacing(name) as out:
            for page_id, url, payload, refers_to in rows(batches):
                record = page_record(page_id, url, payload, digest(payload), refers_to, date)
                out.write(record)
                size, count = size + len(record), count + 1
        yield from batched(iter([(name, size, count)]), schema)

    return saved(linked.mapInArrow(run, "path string, bytes long, records long"), "warc-files")


def parse_headers(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class _Range:
    """Bytes of a file from ``start`` on, read ahead as asked for."""

    def __init__(self, file, start: int, end: int, size: int):
        self.file, self.base, self.size = file, start, size
        self.data = bytearray(file.read_at(min(end, size) - start, start))

    def upto(self, n: int) -> bool:
        """Have n more bytes, or all there are; False if there are none."""
        at = self.base + len(self.data)
        more = self.file.read_at(min(n, self.size - at), at) if at < self.size else b""
        self.data += more
        return bool(more)

    def inflate(self, at: int, header_only: bool = False) -> tuple[bytes, int] | None:
        """(content, end) of the member at ``at``, or of its WARC header only; None if no such member begins there."""
        unpack, out = zlib.decompressobj(31), b""
        parts = []
        try:
            while not unpack.eof:
                if at >= len(self.data) and not self.upto(1 << 16):
                    return None
                chunk = bytes(self.data[at : at + (512 if header_only else 1 << 16)])
                at += len(chunk)
                parts.append(unpack.decompress(chunk))
                if header_only:
                    out += parts[-1]
                    if not out.startswith(VERSION[: len(out)]):
                        return None
                    if b"\r\n\r\n" in out:
                        break
        except zlib.error:
            return None
        if header_only:
            fields = parse_headers(out.partition(b"\r\n\r\n")[0])
            return (out, at) if {"warc-type", "warc-record-id", "content-length"} <= fields.keys() else None
        return b"".join(parts), at - len(unpack.unused_data)


def members(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """Whole contents of the records that begin in [start, end).

    The gzip magic is looked for from ``start`` on; a place counts once the bytes
    there inflate to a WARC header with its fields. From then on a record begins
    where the one before ends. A record whose rest is damaged raises.
    """
    held = _Range(file, start, end, size)
    at, known = 0, False
    while start + at < end:
        if not known:
            at = held.data.find(MAGIC, at)
            while at < 0 or at + len(MAGIC) > len(held.data):
                at = max(0, len(held.data) - len(MAGIC) + 1) if at < 0 else at
                if start + at >= end or not held.upto(len(MAGIC)):
                    return
                at = held.data.find(MAGIC, at)
            if start + at >= end:
                return
        if held.inflate(at, header_only=True) is None:
            at, known = at + 1, False
            continue
        whole = held.inflate(at)
        if whole is None:
            raise ValueError(f"damaged record at byte {start + at}")
        content, at = whole
        known = True
        yield content


def read_warc(spark: SparkSession, archives: DataFrame, split_bytes: int = 4 << 20, with_payload: bool = True) -> DataFrame:
    """The records of ``archives`` (path, bytes), read in parallel within files too.

    Returns record_id, record_type, refers_to (ids as written, or null),
    target_uri, payload_bytes, payload_digest and, if asked for, payload (null
    for revisits). A response's length and digest are of the payload read, and
    must be what its headers say; a revisit's are those it was written with.
    """
    last = F.greatest(F.col("bytes") - 1, F.lit(0))
    splits = archives.where("bytes > 0").select("path", F.col("bytes").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(split_bytes).cast("long"))).alias("start"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splits = splits.repartition(n, "path", "start")
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), *([("payload", pa.binary())] if with_payload else [])])

    def bare(x: str | None) -> str | None:
        return x and x.removeprefix("<urn:page:").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for path, size, start in rows(batches):
                system, name = opened(path)
                with system.open_input_file(name) as file:
                    for content in members(file, size, start, min(size, start + split_bytes)):
                        head, _, rest = content.partition(b"\r\n\r\n")
                        fields = parse_headers(head)
                        block = rest[: int(fields["content-length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said, sha = int(parse_headers(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "response" and (len(payload), digest(payload)) != (said, sha):
                            raise ValueError(f"payload of {fields['warc-record-id']} is not what its headers say")
                        row = (bare(fields["warc-record-id"]), fields["warc-type"], bare(fields.get("warc-refers-to")), fields.get("warc-target-uri"), said, sha)
                        yield (*row, payload if fields["warc-type"] == "response" else None) if with_payload else row

        yield from batched(each(), schema, 256)

    ddl = "record_id string, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    return splits.mapInArrow(run, ddl)
