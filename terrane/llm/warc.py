"""WARC archives: records are written with an index of their places, and read by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, fresh_path, lean

INDEX = "file string, at long, length long, url string, payload_digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = "2000-01-01T00:00:00Z"  # the tables have no time of their own


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, whose Content-Length is the full payload's, and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """(page_id, url, payload or None, payload_bytes, digest, type, refers_to); a damaged record raises."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"] or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, body = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    ident = lambda urn: None if urn == "<urn:page:none>" else int(urn[len("<urn:page:") : -1])
    response = fields["WARC-Type"] == "response"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if response and (len(body) != n or base32_sha1(body) != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    refers_to = ident(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return ident(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], body if response else None, n, digest, fields["WARC-Type"], refers_to


def with_revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id with an equal payload, null for that page itself.

    Digests meet in an aggregate that combines before its shuffle; html is shuffled once, in a join that Spark can
    split where one payload has many pages.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("first"))
    other = (F.octet_length("html") >= min_payload) & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return keyed.join(first, "digest", "left").select("page_id", "url", "html", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0, compress: bool = True) -> DataFrame:
    """Writes an archive for each task into folder (a URI of shared storage) and returns the index (INDEX).

    A record is one gzip member, so any can be read alone. Names hold the attempt: a task that runs again writes
    a file of its own, and only the attempt that counts is in the index. Null html: an empty payload. Null url:
    empty. Rows with the smallest page_id of their payload, repeated ones too, are responses. An empty table
    writes no archive.
    """

    @lean
    def write(batches):
        where, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc" + ".gz" * compress
        out, at = None, 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                digest = base32_sha1(payload)
                raw = record(page_id, url, payload, digest, refers_to)
                if compress:
                    z = zlib.compressobj(6, wbits=31)
                    raw = z.compress(raw) + z.flush()
                if out is None:
                    where.create_dir(base, recursive=True)
                    out = where.open_output_stream(f"{base}/{name}", compression=None)
                out.write(raw)
                rows.append((name, at, len(raw), url, digest, page_id, "response" if refers_to is None else "revisit"))
                at += len(raw)
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "at", "length", "url", "payload_digest", "page_id", "record_type"])
        if out is not None:
            out.close()

    return Written(with_revisits(pages, min_payload).mapInArrow(write, INDEX), "warc-index").df


def coalesced(places: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Reads (start, end, records) that join sorted records at most gap bytes apart, up to about most bytes."""
    out: list = []
    for at, length in places:
        if out and at - out[-1][1] <= gap and at + length - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], at + length)
            out[-1][2].append((at, length))
        else:
            out.append([at, at + length, [(at, length)]])
    return [tuple(x) for x in out]


def read_records(index: DataFrame, folder: str, gap: int = 65_536, most: int = 8_388_608, payloads: bool = False) -> DataFrame:
    """The records that the (perhaps filtered) index selects: RECORD, and with payloads also payload (binary).

    Places are dealt by file and stretch of most bytes, sorted, and coalesced into single reads.
    """

    @lean
    def read(batches):
        where, base = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            files, ats, lengths = (batch.column(i).to_pylist() for i in range(3))
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                if files[i] != name:
                    name, source = files[i], where.open_input_file(f"{base}/{files[i]}")
                for start, end, records in coalesced(list(zip(ats[i:j], lengths[i:j], strict=True)), gap, most):
                    source.seek(start)
                    raw, rows = source.read(end - start), []
                    for at, length in records:
                        one = raw[at - start : at - start + length]
                        page_id, url, payload, n, digest, kind, refers_to = parse(zlib.decompress(one, wbits=31) if one[:2] == b"\x1f\x8b" else one)
                        rows.append((page_id, url, n, digest, kind, refers_to, payload)[: 7 if payloads else 6])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)
                i = j

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 7 if payloads else 6]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    places = index.select("file", "at", "length")
    tasks = -(-(places.agg(F.sum("length")).first()[0] or 0) // most) or 1  # the index is too small to show how much is to be read
    dealt = places.repartition(tasks, "file", F.floor(F.col("at") / most)).sortWithinPartitions("file", "at")
    return dealt.mapInArrow(read, RECORD + ", payload binary" * payloads)


def archive_and_read(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    folder = fresh_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, min_payload), folder)
