"""WARC archives: one gzip member for each record, revisit records for repeated payloads, sequential reading.

Writers run on the executors and put files with names of their own attempt into the shared folder; the
manifest lists the files of finished tasks only, so lost executors leave nothing but unlisted files. The
reader feeds blocks to an incremental zlib decompressor, frames records by their content lengths and
verifies both digests.

Defined cases: null html is an empty payload; equal payloads, the empty one among them, have one response,
that of the largest page_id (null is smaller than any), and others refer to it; rows that repeat the
largest page_id are all responses; further columns are dropped; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, map_arrow, new_path

READ_BYTES = 1 << 16
#: A file is closed and another begun beyond so many compressed bytes.
FILE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def field(value: str) -> str:
    """A header value on one line: control characters and spaces at the ends are escaped."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def encode_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, and so the payload's length, without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {field(url or f'urn:page:{page}')}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        lines[6:6] = [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    raw = ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


@dataclass
class Record:
    """One record as read: ``payload`` is None for a revisit, whose length and digest are those of the full payload."""

    kind: str
    page_id: int | None
    url: str
    payload: bytes | None
    payload_bytes: int
    payload_digest: str
    refers_to: int | None


def members(stream, size: int = READ_BYTES) -> Iterator[Iterator[bytes]]:
    """The decompressed blocks of one gzip member after another; each must be used up before the next."""
    pending = stream.read(size)

    def blocks() -> Iterator[bytes]:
        nonlocal pending
        machine = zlib.decompressobj(31)
        while not machine.eof:
            if not pending:
                raise ValueError("the archive ends inside a record")
            data = machine.decompress(pending)
            pending = machine.unused_data if machine.eof else stream.read(size)
            if data:
                yield data
        pending = pending or stream.read(size)

    while pending:
        yield blocks()


def headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def read_records(stream) -> Iterator[Record]:
    """All records of an archive in order; framing or digests that do not hold raise ValueError."""
    for blocks in members(stream):
        data = bytearray()
        for block in blocks:  # up to the end of the header
            data += block
            if (end := data.find(b"\r\n\r\n")) >= 0:
                break
        else:
            raise ValueError("a record has no header")
        first, head = headers(bytes(data[:end]))
        if not first.startswith("WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        length = int(head["content-length"])
        for block in blocks:
            data += block
        body = bytes(data[end + 4 : end + 4 + length])
        if len(body) != length or bytes(data[end + 4 + length :]) != b"\r\n\r\n":
            raise ValueError("the content length does not frame the record")
        if head["warc-block-digest"] != f"sha1:{sha1_base32(body)}":
            raise ValueError("block digest differs")
        http, _, payload = body.partition(b"\r\n\r\n")
        said = head["warc-payload-digest"].removeprefix("sha1:")
        size = int(headers(http)[1]["content-length"])
        kind = head["warc-type"]
        if kind == "response" and (len(payload) != size or sha1_base32(payload) != said):
            raise ValueError("payload digest or length differs")
        yield Record(kind, page_of(head["warc-record-id"]), head["warc-target-uri"], payload if kind == "response" else None, size, said, page_of(head.get("warc-refers-to")))


def plan_revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, url, payload, keep, revisit): ``keep`` is the largest page with the same payload.

    Payloads are equal when their SHA-256 and length are. Only groups of two or more are joined back, so
    the join's right side is small, and a very large group is the left side of a join that can be split.
    """
    html = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("payload")).withColumn("key", F.concat_ws(":", F.sha2("payload", 256), F.length("payload")))
    groups = rows.where(F.length("payload") >= least_bytes).groupBy("key").agg(F.max("page").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(groups.withColumn("grouped", F.lit(True)), "key", "left")
    return joined.select("page", "url", "payload", "keep", (F.coalesce("grouped", F.lit(False)) & ~F.col("page").eqNullSafe(F.col("keep"))).alias("revisit"))


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Writes records as ``*.warc.gz`` under ``folder``, a URI of a store that executors reach; returns the manifest (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        done, out, n, size, path = [], None, 0, 0, ""
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out, n, size = store.open_output_stream(path, compression=None), 0, 0
                raw = encode_record(row["page"], row["url"], row["payload"] or b"", row["keep"], row["revisit"])
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "records"])

    return cut(map_arrow(plan, run, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of every record, a task for each few files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [name for name, _ in kinds])

        for listed in batches:
            for path, expected in zip(listed.column(0).to_pylist(), listed.column(1).to_pylist(), strict=True):
                rows, held, seen = [], 0, 0
                with store.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream):
                        rows.append((r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to, r.url, r.payload))
                        held, seen = held + len(r.payload or b""), seen + 1
                        if held > 1 << 22 or len(rows) >= 4096:
                            yield batch(rows)
                            rows, held = [], 0
                if seen != expected:
                    raise ValueError(f"{path} has {seen} of {expected} records")
                yield batch(rows)

    files = manifest.count()
    spread = manifest.repartition(max(1, files))
    return map_arrow(spread, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def round_trip(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` as archives and reads them back."""
    folder = folder or new_path(pages.sparkSession, "warc")
    manifest = write_archives(plan_revisits(pages, least_bytes), folder)
    return read_archives(manifest, folder)
