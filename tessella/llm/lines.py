"""Line deduplication by content-defined chunks of lines.

Lines are hashed; a rolling hash over the last two line hashes decides where chunks end, so the same lines
are cut the same way wherever they stand in a text. Chunks have two to ``MOST`` lines; a last chunk of one
line joins the one before. A chunk that also occurs in a document of smaller id is removed, as
is a second occurrence within a document.

Documents of few lines share passages of few lines, which chunks that hold foreign lines at both ends mostly miss. With ``every``
the chunks are therefore all pairs of adjacent lines: a run of two or more lines goes, wherever it begins
and ends, if each of its pairs also occurs in a document of smaller id, or before within the document without overlap.

Chunks that share a digest are compared by their bytes, through grouping by the bytes themselves. Only chunks
whose digest occurs in two documents take part, flagged by a bitmap of fixed size in the scan. Groups are pre-aggregated.

Defined cases: null texts stay null and empty ones empty, with no line; texts of one line have no chunk and
are kept; no single line is removed; very long texts are held whole in memory, one at a time, with a digest for each chunk; of chunks that stand in several
documents that of the smallest id stays; an empty table gives an empty result; rows that repeat the smallest id keep their chunks, all of them; rows without an id are only
deduplicated within themselves; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.blobs import flag_slots, flags
from tessella.llm.common import cut, free_names, map_arrow, quoted
from tessella.llm.flagging import flag_parts

MOST = 16
#: A chunk ends where these bits of the rolling hash are zero.
MASK = 0x1


def boundaries(hashes: list[int]) -> list[int]:
    """Ends of the chunks of a text with these line hashes; none where there are fewer than two lines."""
    ends, start, before = [], 0, 0
    for i, h in enumerate(hashes):
        rolled = (h + 0x9E3779B97F4A7C15 * before) & 0xFFFFFFFFFFFFFFFF
        before = h
        if i - start + 1 >= 2 and (not (rolled >> 17) & MASK or i - start + 1 >= MOST):
            ends.append(i + 1)
            start = i + 1
    if start < len(hashes):
        if len(hashes) - start == 1 and ends:
            ends[-1] = len(hashes)
        elif len(hashes) - start >= 2:
            ends.append(len(hashes))
    return ends


def chunk(text: str | None) -> tuple[list[bytes], list[int]]:
    """The lines of a text, and the ends of its chunks."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n") if text else []
    return lines, boundaries([xxhash.xxh3_64_intdigest(x) for x in lines])


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def chunks_of(text: str | None, every: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(first line, end, bytes) of each chunk; with ``every`` of each pair of adjacent lines."""
    if every:
        lines = text.encode("utf-8", "surrogatepass").split(b"\n") if text else []
        for k in range(len(lines) - 1):
            yield k, k + 2, lines[k] + b"\n" + lines[k + 1]
        return
    lines, ends = chunk(text)
    start = 0
    for end in ends:
        yield start, end, b"\n".join(lines[start:end])
        start = end


def slot_id(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def strip(text: str | None, gone: set[bytes], every: bool = False) -> tuple[str | None, int, int]:
    """(kept text, lines, removed lines): chunks in ``gone`` and repeats within the text are removed."""
    if not text:
        return text, 0, 0
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    keep = [True] * len(lines)
    seen: dict[bytes, tuple[bytes, int]] = {}
    for start, end, raw in chunks_of(text, every):
        d = digest(raw)
        before, over = seen.setdefault(d, (raw, end))
        if d in gone or (over <= start and before == raw):
            keep[start:end] = [False] * (end - start)
    removed = keep.count(False)
    return (b"\n".join(x for x, k in zip(lines, keep, strict=True) if k).decode("utf-8", "surrogatepass") if removed else text), len(lines), removed


def _digests(rows: DataFrame, every: bool) -> DataFrame:
    """(id, slot, digest): each distinct chunk of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {digest(raw) for _, _, raw in chunks_of(text.as_py(), every)}
                ids += [i] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([slot_id(d) for d in out], pa.int64()), pa.array(out, pa.binary())], ["id", "slot", "digest"])

    return map_arrow(rows, run, "id long, slot long, digest binary")


def _bytes(rows: DataFrame, marked, every: bool) -> DataFrame:
    """(id, digest, raw) of chunks whose digest is flagged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = flags([marked.value])
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {digest(raw): raw for _, _, raw in chunks_of(text.as_py(), every)}
                if own:
                    hit = mark[flag_slots(np.array([slot_id(d) for d in own]))]
                    out += [(i, d, raw) for (d, raw), h in zip(own.items(), hit, strict=True) if h]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["id", "digest", "raw"])

    return map_arrow(rows, run, "id long, digest binary, raw binary")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """(id, gone): for each document, the digests of its chunks that a document of smaller id holds too."""
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text")).where("id is not null")
    held = cut(_digests(rows, every), "line-chunks")
    shared = held.groupBy("digest", "slot").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    marked = flag_parts(shared.select("slot"), docs.sparkSession.sparkContext)
    # chunks are the same only if their bytes are
    equal = _bytes(rows, marked, every).groupBy("digest", "raw").agg(F.min("id").alias("first"), F.max("id").alias("b")).where("first < b").select("digest", "first")
    # bytes that share a digest and differ would stand here twice; neither is then removed
    sure = cut(equal.groupBy("digest").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n"), "line-repeats", held)
    return held.join(sure, "digest").where("id > first").groupBy("id").agg(F.collect_set("digest").alias("gone"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stats: bool = False, every: bool = False, counts: tuple[str, str] = ("__lines", "__removed")) -> DataFrame:
    """``docs`` with repeated chunks taken out of the text, and two further columns of ``counts``, lines and removed lines; with ``stats`` (id, n_lines, n_removed, kept) instead."""
    ident, gone = free_names(docs, 2)
    found = removals(docs, id_col, text_col, every).select(F.col("id").alias(ident), F.col("gone").alias(gone))
    if stats:
        docs = docs.select(F.col(quoted(id_col)).cast("long").alias(id_col), F.col(quoted(text_col)).cast("string").alias(text_col))
    place, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [strip(t.as_py(), set(g.as_py() or ()), every) for t, g in zip(batch.column(place), batch.column(len(names)), strict=True)]
            columns = [batch.column(k) for k in range(len(names))]
            columns[place] = pa.array([x[0] for x in out], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2))], [*names, *counts])

    joined = docs.join(found, F.col(quoted(id_col)).cast("long") == F.col(ident), "left").select(*map(quoted, names), gone)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])
    done = map_arrow(joined, run, schema)
    if stats:
        return done.select(F.col(quoted(id_col)), F.col(counts[0]).alias("n_lines"), F.col(counts[1]).alias("n_removed"), F.col(quoted(text_col)).alias("kept"))
    return done
