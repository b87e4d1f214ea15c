"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Unit vectors go through fast Hadamard pseudo-rotations (three rounds of random signs and the Hadamard
transform) and are assigned to the nearest signed axis, which names a bucket of a table. A
query probes the nearest buckets of each table; every vector found there is a candidate and is reranked by
the cosine of the original vectors in double precision.

Every vector is indexed. Vectors that are equal in all components are one class: of each class only the
``top + 1`` smallest ids can be among anyone's nearest, so only those are indexed, and equal queries are
searched once; a group of copies, however large, costs no more than a few rows. The number of probes
follows the number of indexed vectors, such that a query meets about ``CANDIDATES`` candidates; at
small numbers all buckets are probed and the search is exact, and at no number are fewer than ``LEAST_PROBES``
probed. Beyond ``PER_PART`` vectors buckets are split by the digest of a vector, and queries go to all parts: tasks stay
small, and candidates are the same as without.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id; vectors of different lengths do not meet; repeated ids are one candidate for each
distinct vector, of which the nearer counts; with fewer candidates than ``top``, all are returned; further
columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import cut, map_arrow

TABLES = 14
CANDIDATES = 24_000
#: Buckets probed at any size; fewer lose neighbours, and so do two rotations a bucket with as few candidates.
LEAST_PROBES = 6
#: Vectors for each part of the buckets.
PER_PART = 1 << 21
#: Places of vectors in buckets that are packed at once.
DEAL = 1 << 18
BLOCK = 512


def transform(x: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


class Rotations:
    """The pseudo-rotations of all tables for vectors of one length; the same for every worker."""

    def __init__(self, dim: int, k: int, tables: int = TABLES):
        self.size = 1 << max(1, int(np.ceil(np.log2(max(2, dim)))))
        self.k, self.tables = k, tables
        self.signs = np.random.default_rng([17, dim]).choice(np.array([-1.0, 1.0]), (tables, k, 3, self.size))

    def rotated(self, unit: np.ndarray, table: int, part: int) -> np.ndarray:
        y = np.zeros((len(unit), self.size))
        y[:, : unit.shape[1]] = unit
        for signs in self.signs[table, part]:
            y = transform(y * signs)
        return y

    def probes(self, unit: np.ndarray, table: int, n: int) -> np.ndarray:
        """The ``n`` nearest buckets of each vector, nearest first: by the sum over rotations of how far each axis is behind the best."""
        axes = 2 * self.size
        code, loss = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for part in range(self.k):
            y = self.rotated(unit, table, part)
            signed = np.concatenate([y, -y], axis=1)
            width = min(n, axes)
            near = np.argsort(-signed, axis=1, kind="stable")[:, :width]
            behind = signed.max(axis=1)[:, None] - np.take_along_axis(signed, near, 1)
            code = (code[:, :, None] * axes + near[:, None, :]).reshape(len(unit), -1)
            loss = (loss[:, :, None] + behind[:, None, :] ** 2).reshape(len(unit), -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :n]
            code, loss = np.take_along_axis(code, best, 1), np.take_along_axis(loss, best, 1)
        return code


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, components added one after another as SQL engines add them."""

    def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for part in np.ascontiguousarray((x * y).T):  # numpy's own sum takes the components of a single row in another order
            total += part
        return total

    return dot(q, c) / (np.sqrt(dot(q, q)) * np.sqrt(dot(c, c)))


def kind_of(rows: DataFrame, vector_col: str) -> type:
    """The number type in which vectors travel without loss: single precision where the column has it."""
    element = getattr(rows.schema[vector_col].dataType, "elementType", None)
    return np.float32 if isinstance(element, T.FloatType) else np.float64


def _vectors(rows: DataFrame, kind: type) -> DataFrame:
    """(id, dim, vec, cls) of the vectors that take part: numbers as bytes, and a digest that equal vectors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            out = []
            for i in range(batch.num_rows):
                v = lists[i]
                if not ids[i].is_valid or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # one zero
                if np.isfinite(x).all() and x.any():
                    raw = x.astype(kind).tobytes()
                    out.append((ids[i].as_py(), len(x), raw, hashlib.blake2b(raw, digest_size=16).digest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["id", "dim", "vec", "cls"])

    return map_arrow(rows, run, "id long, dim int, vec binary, cls binary")


def probes_of(axes: int, n: int) -> int:
    """So many of the buckets of a table are probed among ``n`` vectors; ``LEAST_PROBES`` is for 128 buckets."""
    return int(min(axes, max(np.ceil(LEAST_PROBES * axes / 128), np.ceil(CANDIDATES * axes / (TABLES * n)))))


BLOB = "dim int, bucket long, role int, ids binary, cls binary, vecs binary"
BLOB_ARROW = pa.schema([("dim", pa.int32()), ("bucket", pa.int64()), ("role", pa.int32()), ("ids", pa.binary()), ("cls", pa.binary()), ("vecs", pa.binary())])


def _deal(rows: DataFrame, role: int, counts: dict[int, int], kind: type) -> DataFrame:
    """Packs vectors by the buckets they are in (role 0, one part of one a table) or that they probe (role 1, all parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Rotations] = {}
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            vecs, classes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for dim in np.unique(dims).tolist():
                where = np.flatnonzero(dims == dim)
                n = counts.get(dim, 1)
                rotations, parts = made.setdefault(dim, Rotations(dim, 1)), -(-n // PER_PART)
                probes = probes_of(2 * rotations.size, n) if role else 1
                step = max(1, min(4096, DEAL // (TABLES * probes * (parts if role else 1))))
                for at in range(0, len(where), step):
                    w = where[at : at + step]
                    sent = np.frombuffer(b"".join(vecs[i] for i in w), kind).reshape(len(w), dim)
                    x = sent.astype(np.float64)
                    scale = np.abs(x).max(axis=1, keepdims=True)
                    unit = x / scale
                    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                    part = np.arange(parts)[None] if role else np.array([int.from_bytes(classes[i][:8], "little") % parts for i in w])[:, None]
                    out = []
                    for table in range(TABLES):
                        code = rotations.probes(unit, table, probes)
                        code = (code[:, :, None] * parts + part[:, None, :]).reshape(len(w), -1)
                        row = np.repeat(np.arange(len(w)), code.shape[1])
                        flat = code.ravel()
                        order = np.argsort(flat, kind="stable")
                        edges = np.concatenate([[0], np.flatnonzero(np.diff(flat[order])) + 1, [len(order)]])
                        for a, b in zip(edges[:-1], edges[1:], strict=True):
                            mine = row[order[a:b]]
                            out.append((dim, int(flat[order[a]]) * TABLES + table, role, ids[w[mine]].astype(np.int64).tobytes(), b"".join(classes[i] for i in w[mine]), sent[mine].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(BLOB_ARROW.types)], schema=BLOB_ARROW)

    return map_arrow(rows, run, BLOB)


def _rerank(table: pa.Table, top: int, kind: type) -> pa.Table:
    """The ``top`` nearest candidates of each query of one bucket, by exact cosine."""
    dim = table["dim"][0].as_py()
    roles = table["role"].to_pylist()
    part = lambda name, role: b"".join(x for x, r in zip(table[name].to_pylist(), roles, strict=True) if r == role)
    numbers = lambda role: np.frombuffer(part("vecs", role), kind).reshape(-1, dim).astype(np.float64)
    ids, c = np.frombuffer(part("ids", 0), np.int64), numbers(0)
    classes, q = part("cls", 1), numbers(1)
    found: list[tuple] = []
    if len(ids) and len(q):
        order = np.argsort(ids, kind="stable")
        ids, c = ids[order], c[order]
        unit = c / np.sqrt((c * c).sum(axis=1, keepdims=True))
        for at in range(0, len(q), BLOCK):
            rough = (q[at : at + BLOCK] / np.sqrt((q[at : at + BLOCK] ** 2).sum(axis=1, keepdims=True))) @ unit.T
            if len(ids) > top:  # rounding moves rough scores by far less than this
                border = np.partition(rough, len(ids) - top, axis=1)[:, len(ids) - top] - 1e-9
            else:
                border = np.full(len(rough), -2.0)
            who, which = np.nonzero(rough >= border[:, None])
            score = cosines(q[at + who], c[which])
            order = np.lexsort((ids[which], -score, who))
            who, which, score = who[order], which[order], score[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            for i in np.flatnonzero(place < top):
                k = at + int(who[i])
                found.append((classes[16 * k : 16 * k + 16], int(ids[which[i]]), float(score[i])))
    return pa.table([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.float64()))], names=["cls", "vec_id", "score"])


def nearest(vectors: DataFrame, every: int = 50, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the ``top`` nearest found among all other rows."""
    kind = kind_of(vectors, vector_col)
    valid = cut(_vectors(vectors.select(F.col(id_col).cast("long"), F.col(vector_col)), kind), "vectors")
    smallest = Window.partitionBy("dim", "cls").orderBy("id")
    indexed = cut(valid.dropDuplicates(["id", "dim", "cls"]).withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= top + 1).drop("n"), "indexed")
    counts = {r["dim"]: r["n"] for r in indexed.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    queries = valid.where(F.col("id") % every == 0)
    asked = queries.groupBy("dim", "cls").agg(F.min("id").alias("id"), F.first("vec").alias("vec")).select("id", "dim", "vec", "cls")
    blobs = _deal(indexed, 0, counts, kind).unionByName(_deal(asked, 1, counts, kind))
    met = blobs.groupBy("dim", "bucket").applyInArrow(lambda t: _rerank(t, top + 1, kind), "cls binary, vec_id long, score double")
    each = met.groupBy("cls", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("cls").orderBy(F.col("score").desc(), "vec_id")
    few = each.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top + 1).drop("n")
    pairs = queries.select(F.col("id").alias("query_id"), "cls").distinct().join(few, "cls").where("query_id <> vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
