"""Exact join of documents by the Jaccard similarity of their word shingles, as a metric-space join.

Jaccard distance is a metric, and pivots divide its space into regions. Two kinds of pivots are needed, as
almost all pairs of documents are at distance 1 and a document says nothing of where those are:

1.  Single shingles. A document's cell is that of its first shingle in a global order. A document within
    the radius lacks at most ``n - ceil(0.8 n)`` of its shingles, so the boundary window of a document
    is its first ``n - ceil(0.8 n) + 1`` shingles: it is replicated to those regions, and every pair within
    the radius meets in one. Regions of few documents are joined at once.
2.  Documents, within regions of many. Common shingles come late in the order, so that what only shares a
    passage or a line does not meet: at first those that repeat within a task's share of documents, then those of crowded regions,
    whose documents are dealt out again. What is left are mostly near copies of one another, and what is known to be connected is not compared again.
    In each of ``ROUNDS`` rounds a region has one pivot, each document is measured to one of its regions' pivots, and what lies within the radius joins
    the pivot's component. Regions that then hold more than one component and are connected by shared documents to no more than ``PART`` are joined at once, many such
    to a task. In the others the distances of all documents to a document of each of ``PIVOTS`` components, chosen by a hash of documents, are measured, and again
    those within the radius join. Regions that chose the same pivots are one from then on. Those still mixed are divided: a document belongs to the Voronoi cell of its nearest pivot and is replicated to every cell whose pivot is at most
    two radii further (triangle inequality). Regions that chose the same pivot share its cell. A cell is joined exactly in parts
    of bounded size, each part of documents outside the largest component with each part.

The order only changes what work is done, never the result. Equal sets (128 bits of fingerprint and the size) are one class, represented by its smallest
id, and enter a region once. All pairs are verified on the words of whole texts, by comparison and not by hashes. Pairs
of small regions are first held against sketches of about a bit a shingle, which bound the difference of two sets from below: texts
travel only for those that may link.

Defined cases: null, empty and blank texts have no shingle and link with nothing; texts of fewer than five words
have one shingle, the whole; very long texts are hashed in pieces and hold in memory their words and 16 bytes a shingle; rows that repeat an id are one node, linked by each of their texts; rows without an
id get no component and link with nothing; pairs at exactly the threshold link; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.blobs import bucket_bits, flag_slots, flags, pack, split_sorted, unpack_all
from tessella.llm.common import cut, input_bytes, map_arrow
from tessella.llm.components import components
from tessella.llm.flagging import flag_parts
from tessella.llm.words import Hasher, chunks, exact_grams, mix, ngrams, rows_of, space_table, utf8

SHINGLE = 5
#: Similarity in hundredths.
LEAST = 80
#: Regions of more documents are joined recursively.
REGION = 16
#: Shingles that can come late in the order, the most common ones: a bound on what is broadcast.
LATE = 1 << 18
#: A shingle is common if so many different documents among those of one flush have it.
COMMON = 4
#: Shingles that are counted together.
FLUSH = 1 << 20
#: Replicas gathered in a task before they are dealt out.
DEAL = 1 << 18
#: Shingles and documents of a part of a cell, or of the documents that one task measures to a pivot.
BLOCK = 1 << 19
PART = 256
#: Documents of small cells that one task joins, on average.
BUNDLE = 64
#: Pivots of a region to which all its documents are measured, and rounds of one pivot before.
PIVOTS = 4
ROUNDS = 1
#: Bits of a sketch, at least and at most.
SKETCH = (64, 1 << 16)
#: Documents of a region, rows of a task and their shingles that are held against one another by sketches at once, and words of sketches.
SIFT = 1 << 10
SIFT_ROWS = 1 << 11
SIFT_SHINGLES = 1 << 22
SIFT_WORDS = 1 << 21
#: Documents of a region that tell whether one is like many.
PROBE = 256
#: Bytes of text whose shingles are numbered together.
TOGETHER = 1 << 20
LOW48 = np.uint64((1 << 48) - 1)


class Shingler:
    def __init__(self):
        self.hasher = Hasher(space_table(), True)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two lanes of hashes of the distinct shingles of all rows, sorted within each, and where each row's begin (one more entry than rows)."""
        words, first = self.hasher.words(data, offsets)
        rows = len(offsets) - 1
        grams, row = ngrams(words, SHINGLE), rows_of(first)
        inside = np.flatnonzero(row[: grams.shape[1]] == row[SHINGLE - 1 :]) if grams.shape[1] else np.zeros(0, np.int64)
        count = np.diff(first)
        parts, owners = [grams[:, inside]], [row[inside]]
        for k in range(1, SHINGLE):  # texts of fewer words
            short = np.flatnonzero(count == k)
            if len(short):
                parts.append(ngrams(words, k)[:, first[short]] ^ np.uint64(k * 0xA24BAED4963EE407 % (1 << 64)))
                owners.append(short)
        h, r = np.concatenate(parts, axis=1), np.concatenate(owners)
        order = np.lexsort((h[0], r))
        h, r = h[:, order], r[order]
        same = (h[0, 1:] == h[0, :-1]) & (r[1:] == r[:-1])
        if (same & (h[1, 1:] != h[1, :-1])).any():  # one lane does not tell them apart
            order = np.lexsort((h[1], h[0], r))
            h, r = h[:, order], r[order]
            same = (h[0, 1:] == h[0, :-1]) & (r[1:] == r[:-1])
        new = np.ones(len(r), bool)
        new[1:] = ~same | (h[1, 1:] != h[1, :-1])
        h, r = h[:, new], r[new]
        return h, np.searchsorted(r, np.arange(rows + 1))


def fingerprints(h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set, one of each lane."""
    out = []
    for lane, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h[lane] ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(total[start[1:]] - total[start[:-1]])
    return out[0], out[1]


def class_of(f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
    """One number of both fingerprints; it tells the sets of one region or one flush apart, not those of a corpus."""
    return f1 ^ mix(f2)


def sketches(h: np.ndarray, start: np.ndarray) -> list[bytes]:
    """For each set the parities of how many of its shingles fall on each bit: a power of two of bits, as many as shingles or more."""
    if len(start) < 2:
        return []
    n = np.diff(start)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), *SKETCH)
    first = np.concatenate([[0], np.cumsum(bits)])
    at = (mix(h[0] ^ np.uint64(0xA4093822299F31D0)) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(first[:-1], n)
    packed = np.packbits((np.bincount(at, minlength=first[-1]) & 1).astype(bool), bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip((first[:-1] >> 3).tolist(), (first[1:] >> 3).tolist(), strict=True)]


def difference(x: bytes, y: bytes) -> int:
    """So many shingles at least are in one of two sets only: a shingle of both changes no parity of their sum."""
    if len(x) < len(y):
        x, y = y, x
    size, a = len(x), int.from_bytes(x, "little")
    while size > len(y):  # folded, it is the sketch of half the bits
        size //= 2
        a = (a >> 8 * size) ^ (a & ((1 << 8 * size) - 1))
    return (a ^ int.from_bytes(y, "little")).bit_count()


def profiles(rows: DataFrame, bits: int) -> DataFrame:
    """(id, n, f1, f2, sketch, common): size, fingerprints and sketch of every document's set; with ``common``, region names (id) of shingles that are common in a task's share of documents, and in how many (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, count = Shingler(), [], 0
        names, kinds = ["id", "n", "f1", "f2", "sketch", "common"], (*[pa.int64()] * 4, pa.binary(), pa.bool_())

        def flush() -> pa.RecordBatch:
            h, classes = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((classes, h))
            h, classes = h[order], classes[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (classes[1:] != classes[:-1])
            h = h[new]
            edges = split_sorted(h)
            size = np.diff(edges)
            often = size >= COMMON
            none = pa.nulls(int(often.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(pivot_of(h[edges[:-1]][often], bits).view(np.int64)), pa.array(size[often], pa.int64()), none, none, pa.nulls(len(none), pa.binary()), pa.array(np.ones(len(none), bool))], names)

        for batch in batches:
            data, bounds = utf8(batch.column(1))
            parts, drawn = [], []
            for i, j in chunks(bounds):
                h, start = shingler.sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                n = np.diff(start)
                parts.append((n, *fingerprints(h, start)))
                drawn += sketches(h, start)
                held.append((h[0], np.repeat(class_of(*parts[-1][1:]), n)))
                count += h.shape[1]
                if count >= FLUSH:
                    yield flush()
                    held, count = [], 0
            n, a, b = (np.concatenate([p[k] for p in parts]) for k in range(3)) if parts else (np.zeros(0, np.int64),) * 3
            own = (batch.column(0), n, a.view(np.int64), b.view(np.int64), drawn, np.zeros(len(n), bool))
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(own, kinds, strict=True)], names)
        if held:
            yield flush()

    return map_arrow(rows, run, "id long, n long, f1 long, f2 long, sketch binary, common boolean")


def late_shingles(counted: DataFrame) -> bytes:
    """The ``LATE`` most common of (name, n), sorted by name, and how late each comes: a broadcast of bounded size."""
    most = counted.groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(LATE).toArrow()
    names, n = most["name"].to_numpy().astype(np.int64).view(np.uint64), most["n"].to_numpy()
    order = np.argsort(names)
    return names[order].tobytes() + np.log2(n[order] + 1).astype(np.uint8).tobytes()


def pivot_of(h: np.ndarray, bits: int) -> np.ndarray:
    """The name of a shingle's region: its bucket and 48 further bits."""
    return ((h >> np.uint64(64 - bits)) << np.uint64(48)) | (h & LOW48)


POSTING = "bucket int, crowded boolean, fps binary, ids binary, sizes binary, classes binary"
POSTING_ARROW = pa.schema([("bucket", pa.int32()), ("crowded", pa.bool_()), ("fps", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("classes", pa.binary())])


def replicate(rows: DataFrame, bits: int, late, only=None) -> DataFrame:
    """Replicates documents to the regions of their windows, packed by bucket. ``late``: a broadcast of shingles that come late in the order; ``only``: of flags for the documents that take part.

    Of a region that is crowded within a flush already, no more documents than show that go to its bucket; the others are
    dealt by document, as crowded. So a bucket gets a few documents of a region from each flush, however many are in it.
    """

    def packed(bucket: np.ndarray, crowded: bool, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(bucket, kind="stable")
        h, ids, sizes, classes, bucket = h[order], ids[order], sizes[order], classes[order], bucket[order]
        cuts = split_sorted(bucket)
        out = [(int(bucket[a]), crowded, pack(h[a:b], 8 if crowded else 6), pack(ids[a:b].astype(np.uint64)), pack(sizes[a:b], 4), pack(classes[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for k in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out[k : k + 256]], t) for c, t in enumerate(POSTING_ARROW.types)], schema=POSTING_ARROW)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, ids, sizes, classes = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, classes))  # of equal sets, only the smallest id of a flush goes on
        sorted_classes = classes[order]
        edges = split_sorted(sorted_classes)
        least = np.repeat(ids[order][edges[:-1]], np.diff(edges))
        keep = np.zeros(len(ids), bool)
        keep[order] = ids[order] == least
        h, ids, sizes, classes = h[keep], ids[keep], sizes[keep], classes[keep]
        name = pivot_of(h, bits)
        order = np.lexsort((classes, name))  # rows that repeat with their id are one: a region is crowded by different sets
        name, h, ids, sizes, classes = name[order], h[order], ids[order], sizes[order], classes[order]
        new = np.ones(len(h), bool)
        new[1:] = (name[1:] != name[:-1]) | (classes[1:] != classes[:-1])
        name, h, ids, sizes, classes = name[new], h[new], ids[new], sizes[new], classes[new]
        edges = split_sorted(name)
        beyond = np.arange(len(h)) - np.repeat(edges[:-1], np.diff(edges)) > REGION
        yield from packed(flag_slots(ids[beyond]) % (1 << bits), True, name[beyond], ids[beyond], sizes[beyond], classes[beyond])
        h, ids, sizes, classes = h[~beyond], ids[~beyond], sizes[~beyond], classes[~beyond]
        yield from packed((h >> np.uint64(64 - bits)).astype(np.int64), False, h, ids, sizes, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, count = Shingler(), [], 0
        known = len(late.value) // 9
        last, level = np.frombuffer(late.value, np.uint64, known), np.frombuffer(late.value, np.uint8, known, 8 * known)
        mark = flags([only.value]) if only is not None else None
        for batch in batches:
            wanted = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            if mark is not None:
                wanted = wanted & mark[flag_slots(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))]
            batch = batch.filter(pa.array(wanted))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, bounds = utf8(batch.column(1))
            for i, j in chunks(bounds):
                h, start = shingler.sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                n = np.diff(start)
                classes, h = class_of(*fingerprints(h, start)), h[0]
                row = np.repeat(np.arange(j - i), n)
                if len(last) and len(h):
                    name = pivot_of(h, bits)
                    at = np.searchsorted(last, name)
                    at[at == len(last)] = 0
                    order = np.lexsort((h, np.where(last[at] == name, level[at], 0), row))
                    h = h[order]
                window = n - (4 * n + 4) // 5 + 1
                inside = np.arange(len(h)) - start[row] < window[row]
                held.append((h[inside], ids[i:j][row[inside]], n[row[inside]].astype(np.uint64), classes[row[inside]]))
                count += int(inside.sum())
                if count >= DEAL:
                    yield from flush(held)
                    held, count = [], 0
        if count:
            yield from flush(held)

    return map_arrow(rows, run, POSTING)


FOUND = "a long, b long, na long, nb long, crowded boolean"


def join_bucket(table: pa.Table) -> pa.Table:
    """The regions of one bucket: pairs (a < b) of small ones whose sizes allow a link; of large ones, region (a), document (b) and its class (na)."""
    bucket = np.uint64(table["bucket"][0].as_py())
    apart = table.filter(table["crowded"])
    far = [unpack_all(apart[c].to_pylist(), w) for c, w in (("fps", 8), ("ids", 8), ("sizes", 4), ("classes", 8))]
    table = table.filter(pc.invert(table["crowded"]))
    key = unpack_all(table["fps"].to_pylist(), 6) | (bucket << np.uint64(48))
    ids, sizes = unpack_all(table["ids"].to_pylist()).view(np.int64), unpack_all(table["sizes"].to_pylist(), 4).astype(np.int64)
    classes = unpack_all(table["classes"].to_pylist())
    order = np.lexsort((ids, classes, key))
    key, ids, sizes, classes = key[order], ids[order], sizes[order], classes[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (classes[1:] != classes[:-1])
    key, ids, sizes, classes = key[new], ids[new], sizes[new], classes[new]
    edges = split_sorted(key)
    start, m = edges[:-1], np.diff(edges)
    pairs = []
    for size in range(2, REGION + 1):
        s = start[m == size]
        if len(s):
            left, right = np.triu_indices(size, 1)
            pairs.append(((s[:, None] + left).ravel(), (s[:, None] + right).ravel()))
    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1)) if pairs else (np.zeros(0, np.int64),) * 2
    fits = (100 * np.minimum(sizes[a], sizes[b]) >= LEAST * np.maximum(sizes[a], sizes[b])) & (ids[a] != ids[b])
    a, b = a[fits], b[fits]
    swap = ids[a] > ids[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    order = np.lexsort((ids[b], ids[a]))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (ids[a][1:] != ids[a][:-1]) | (ids[b][1:] != ids[b][:-1])
    a, b = a[new], b[new]
    big = np.repeat(m > REGION, m)
    crowd = [np.concatenate([x[big].astype(np.uint64), y]).view(np.int64) for x, y in zip((key, ids, sizes, classes), far, strict=True)]
    flag = np.arange(len(a) + len(crowd[0])) >= len(a)
    columns = [*(np.concatenate(x) for x in ((ids[a], crowd[0]), (ids[b], crowd[1]), (sizes[a], crowd[3]), (sizes[b], crowd[2]))), flag]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.bool_()), strict=True)], names=["a", "b", "na", "nb", "crowded"])


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of (a, b) that may link by the sketches of their sets (id, n, sketch); a pair that links is never lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = (pc.add(batch.column(2), batch.column(3))).to_pylist()
            # of the sum of sizes s and the difference d, the union is (s + d) / 2 and the intersection (s - d) / 2
            near = [(100 + LEAST) * difference(x, y) <= (100 - LEAST) * s for s, x, y in zip(total, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    both = right.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").select("a", "b", "na", "nb", "sa", "sb")
    return map_arrow(both, run, "a long, b long").distinct()


def may_link(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Which of sets of ``nx`` shingles may link with which of ``ny``, by sketches in words of 64 bits, those of ``y`` with half, as many or twice the bits."""
    if x.shape[1] != y.shape[1]:
        half = min(x.shape[1], y.shape[1])
        x, y = (w if w.shape[1] == half else w[:, :half] ^ w[:, half:] for w in (x, y))
    least = np.bitwise_count(x[:, None] ^ y).sum(-1, dtype=np.int64)
    return ((100 + LEAST) * least <= (100 - LEAST) * (nx[:, None] + ny)) & (100 * np.minimum(nx[:, None], ny) >= LEAST * np.maximum(nx[:, None], ny))


def sift_regions(table: pa.Table) -> pa.Table:
    """Documents (region, id, n, own, sketch) of many regions, or of two parts of one: pairs (a < b) that may link by their sketches; of documents
    that may link with more than ``REGION`` others, pairs among themselves are left out, and instead region (a), document (b) and its size (n) go on as crowded."""
    across = table["i"][0].as_py() != table["j"][0].as_py()
    regions, ids, sizes, own = (table[c].to_numpy() for c in ("region", "id", "n", "own"))
    drawn = table["sketch"].to_pylist()
    length = np.array([len(x) for x in drawn]) // 8
    order = np.lexsort((mix(ids.astype(np.uint64)), regions))
    edges = split_sorted(regions[order])
    pairs, dense = [], []

    def near(rows: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some of ``rows`` at a time, and which of ``others`` each may link with."""

        def by_length(of: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
            at = {int(k): np.flatnonzero(length[of] == k) for k in np.unique(length[of])}
            return {k: (x, np.frombuffer(b"".join([drawn[r] for r in of[x]]), np.uint64).reshape(-1, k)) for k, x in at.items()}

        columns = by_length(others)
        for k, (at, words) in by_length(rows).items():
            step = max(1, SIFT_WORDS // (len(others) * k))
            for low in range(0, len(at), step):
                some = rows[at[low : low + step]]
                out = np.zeros((len(some), len(others)), bool)
                for width in (k // 2, k, 2 * k):  # sets of other lengths differ too much in size
                    if width in columns:
                        to, sketch = columns[width]
                        out[:, to] = may_link(words[low : low + step], sizes[some], sketch, sizes[others[to]])
                out &= ids[some][:, None] != ids[others]
                yield some, out & (own[some][:, None] != own[others]) if across else out

    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows = every = order[a:b]
        if len(rows) > PROBE:  # what is like many of a few needs no look at the others, which look at it
            found = [(some[often], some[~often]) for some, out in near(rows, every[:PROBE]) for often in [out.sum(1) > REGION]]
            dense.append(np.concatenate([x for x, _ in found]))
            rows = np.concatenate([x for _, x in found])
        for some, out in near(rows, every):
            often = out.sum(1) > REGION
            dense.append(some[often])
            x, y = np.nonzero(out & ~often[:, None])
            x, y = ids[some[x]], ids[every[y]]
            pairs.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1))
    pairs = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1), axis=1)
    dense = np.concatenate([np.zeros(0, np.int64), *dense])
    flag = np.arange(pairs.shape[1] + len(dense)) >= pairs.shape[1]
    columns = [*(np.concatenate(x) for x in ((pairs[0], regions[dense]), (pairs[1], ids[dense]), (np.zeros(pairs.shape[1], np.int64), sizes[dense]))), flag]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 3, pa.bool_()), strict=True)], names=["a", "b", "n", "crowded"])


def sift(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n, crowded) of crowded regions (region, id, n), by the sketches of ``sets`` (id, n, sketch): every pair that may link is among the pairs, or both go on as crowded in a region."""
    total = crowded.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).first()
    bundles = max(1, -(-total["rows"] // SIFT_ROWS), -(-(total["n"] or 0) // SIFT_SHINGLES))
    load = crowded.groupBy("region").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SIFT), F.ceil(F.sum("n") / SIFT_SHINGLES), F.lit(1)).cast("int").alias("parts"))
    dealt = crowded.join(load, "region").withColumn("own", F.pmod(F.xxhash64(F.lit("sift"), F.col("id")), F.col("parts")).cast("int"))
    drawn = dealt.join(sets.select("id", "n", "sketch").distinct(), ["id", "n"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    whole = F.col("parts") == 1
    task = F.when(whole, F.pmod(F.xxhash64(F.lit("bundle"), F.col("region")), F.lit(bundles))).otherwise(F.col("region")).alias("task")
    i, j = (F.when(whole, -1).otherwise(of("own", "other")).alias(name) for name, of in (("i", F.least), ("j", F.greatest)))
    return drawn.select(task, i, j, "region", "id", "n", "own", "sketch").groupBy("task", "i", "j").applyInArrow(sift_regions, "a long, b long, n long, crowded boolean")


def packed_texts(rows: DataFrame, marked) -> DataFrame:
    """(id, packed): compressed texts of flagged documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, packer = flags([marked.value]), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            want = known & mark[flag_slots(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))]
            batch = batch.filter(pa.array(want))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packer.compress(x.as_py() or b"") for x in batch.column(1).cast(pa.large_binary())], pa.binary())], ["id", "packed"])

    return map_arrow(rows, run, "id long, packed binary")


def exact_sets(raws: list[bytes]) -> list[np.ndarray]:
    """Sorted numbers of the shingles of each text; equal numbers stand for equal words."""
    return exact_grams(Hasher(space_table(), True), raws, SHINGLE)


def overlap(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both, len(x) + len(y) - both


def measure(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, shared, total): sizes of intersection and union of the sets of each pair, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out, at = [], 0
            while at < len(left):
                number: dict[bytes, int] = {}
                raws, size, stop = [], 0, at
                while stop < len(left) and (size < TOGETHER or stop == at):
                    for packed in (left[stop], right[stop]):
                        if packed not in number:
                            number[packed] = len(raws)
                            raws.append(opener.decompress(packed))
                            size += len(raws[-1])
                    stop += 1
                sets = exact_sets(raws)
                out += [overlap(sets[number[x]], sets[number[y]]) for x, y in zip(left[at:stop], right[at:stop], strict=True)]
                at = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in out], pa.int64()) for k in (0, 1))], ["a", "b", "shared", "total"])

    right = pairs.join(texts.select(F.col("id").alias("b"), F.col("packed").alias("pb")), "b")
    both = right.join(texts.select(F.col("id").alias("a"), F.col("packed").alias("pa")), "a").select("a", "b", "pa", "pb")
    return map_arrow(both, run, "a long, b long, shared long, total long")


def linked(measured: DataFrame) -> DataFrame:
    return measured.where((100 * F.col("shared") >= LEAST * F.col("total")) & (F.col("total") > 0)).select("a", "b").distinct()


def parts_of(count, shingles):
    """So many parts have about ``PART`` documents and ``BLOCK`` shingles at most."""
    return F.greatest(F.ceil(count / PART), F.ceil(shingles / max(BLOCK, 1 << 12)), F.lit(1)).cast("int")


def measure_group(table: pa.Table) -> pa.Table:
    """Distances of documents to one pivot."""
    opener = zstandard.ZstdDecompressor()
    pivot, ids, packed = table["pivot"][0].as_py(), table["id"].to_pylist(), table["packed"].to_pylist()
    own = sorted(opener.decompress(x) for i, x in zip(ids, packed, strict=True) if i is None)
    others = [(i, x) for i, x in zip(ids, packed, strict=True) if i is not None]
    out, at = [], 0
    while at < len(others):
        raws, size, stop = [own[0]], 0, at
        while stop < len(others) and (size < TOGETHER or stop == at):
            raws.append(opener.decompress(others[stop][1]))
            size += len(raws[-1])
            stop += 1
        sets = exact_sets(raws)
        out += [(pivot, others[at + k][0], *overlap(sets[0], x)) for k, x in enumerate(sets[1:])]
        at = stop
    return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["a", "b", "shared", "total"])


def measure_to_pivots(met: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, shared, total) of (pivot, id, n): a pivot with many documents is measured in many tasks."""
    load = met.groupBy("pivot").agg(parts_of(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    dealt = met.join(load, "pivot").select("pivot", F.pmod(F.xxhash64(F.lit("measure"), F.col("id")), F.col("parts")).cast("int").alias("part"), "id").join(texts, "id").select("pivot", "part", "id", "packed")
    each = load.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pivots = each.join(texts.select(F.col("id").alias("pivot"), "packed"), "pivot").select("pivot", "part", F.lit(None).cast("long").alias("id"), "packed")
    return dealt.unionByName(pivots).groupBy("pivot", "part").applyInArrow(measure_group, "a long, b long, shared long, total long")


def renamed(frame: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """``frame`` with components replaced by what they have become part of."""
    return frame.join(changes.select(F.col("id").alias(column), F.col("component").alias("becomes")), column, "left").withColumn(column, F.coalesce("becomes", column)).drop("becomes")


def merged(links: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, component) of components that links between documents (region, id, n, component) connect with others."""
    names = placed.select("id", "component").distinct()
    ends = links.join(names.select(F.col("id").alias("a"), F.col("component").alias("x")), "a").join(names.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
    return components(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), placed)


def join_cell(table: pa.Table) -> pa.Table:
    """Links that connect documents (cell, id, component, packed) of two parts of a cell, or within each of many small cells, by their words; none within a component."""
    opener = zstandard.ZstdDecompressor()
    packed = dict(zip(table["id"].to_pylist(), table["packed"].to_pylist(), strict=True))
    ids = np.array(sorted(packed))
    every = exact_sets([opener.decompress(packed[i]) for i in ids.tolist()])
    cells, where, names = table["cell"].to_numpy(), np.searchsorted(ids, table["id"].to_numpy()), table["component"].to_numpy()
    order = np.lexsort((where, cells))
    edges = split_sorted(cells[order])
    links = set()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows = order[a:b]
        rows = rows[np.concatenate([[True], where[rows][1:] != where[rows][:-1]])]
        sets, own = [every[k] for k in where[rows]], ids[where[rows]].tolist()
        label = np.unique(names[rows], return_inverse=True)[1]
        size = np.array([len(x) for x in sets])
        known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)[np.argsort(flat, kind="stable")]
        first = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(known)))])
        start = np.concatenate([[0], np.cumsum(size)])
        for x in np.flatnonzero((label != np.bincount(label).argmax()) & (size > 0)).tolist():
            s = flat[start[x] : start[x + 1]]
            length = first[s + 1] - first[s]
            ends = np.cumsum(length)
            both = np.bincount(owner[np.arange(ends[-1]) + np.repeat(first[s] - ends + length, length)], minlength=len(sets))
            for y in np.flatnonzero((label != label[x]) & (100 * both >= LEAST * (size + size[x] - both))).tolist():
                if label[y] != label[x]:  # not yet connected by a link of this cell
                    links.add((min(own[x], own[y]), max(own[x], own[y])))
                    label[label == label[y]] = label[x]
    pairs = sorted(links)
    return pa.table([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def bundled(cells: DataFrame) -> DataFrame:
    """Small cells (cell, id, n, component) dealt out to tasks (pivot, i, j), many to one."""
    size = cells.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).first()
    bundles = max(1, -(-size["rows"] // BUNDLE), -(-(size["n"] or 0) // max(BLOCK, 1 << 12)))
    return cells.select(F.pmod(F.xxhash64(F.lit("bundle"), F.col("cell")), F.lit(bundles)).cast("long").alias("pivot"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "cell", "id", "component")


def mixed_regions(placed: DataFrame, seed: int) -> DataFrame:
    """(region, component, size, pivot, pivot_n) of regions with several components; the pivot is a document of the component, by a hash."""
    first = F.min(F.struct(F.xxhash64(F.lit(seed), F.col("id")), "id", "n")).alias("p")
    kinds = placed.groupBy("region", "component").agg(F.count(F.lit(1)).alias("size"), first)
    several = kinds.groupBy("region").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("region")
    return cut(kinds.join(several, "region").select("region", "component", "size", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n")), "kinds", placed)


def join_crowded(crowded: DataFrame, labels: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """What components of ``labels`` become by links within crowded regions (region, id, n), one change after another."""
    changes: list[DataFrame] = []
    if crowded.limit(1).count() == 0:
        return changes
    placed = cut(crowded.join(labels, "id", "left").select("region", "id", "n", F.coalesce("component", "id").alias("component")), "regions", crowded)

    def change(links: DataFrame) -> None:
        nonlocal placed
        changes.append(merged(links, placed))
        placed = cut(renamed(placed, changes[-1], "component").select("region", "id", "n", "component"), "regions", placed)

    by_hash = F.xxhash64(F.lit("pivot"), F.col("pivot"))
    for number in range(ROUNDS):
        kinds = mixed_regions(placed, number)
        if kinds.limit(1).count() == 0:
            return changes
        # one pivot a region, and of a document's regions the pivot that most of them are likely to share: its text travels once
        one = kinds.groupBy("region").agg(F.min(F.struct(by_hash.alias("h"), "pivot", "pivot_n", F.col("component").alias("other"))).alias("p")).select("region", "p.*")
        met = placed.join(one, "region").where((F.col("component") != F.col("other")) & (100 * F.least("n", "pivot_n") >= LEAST * F.greatest("n", "pivot_n")))
        met = met.groupBy("id").agg(F.min(F.struct("h", "pivot")).alias("p"), F.first("n").alias("n")).select("p.pivot", "id", "n")
        change(linked(cut(measure_to_pivots(cut(met, "met", placed), texts), "distances")))
    kinds = mixed_regions(placed, ROUNDS)
    if kinds.limit(1).count() == 0:
        return changes
    placed = cut(placed.join(kinds.select("region").distinct(), "region", "left_semi"), "regions", placed)
    hubs = placed.groupBy("region").agg(F.min("id").alias("hub"))
    edges = placed.join(hubs, "region").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    members = cut(placed.select("id", "n", "component").distinct().join(components(edges, placed).withColumnRenamed("component", "cell"), "id"), "members", placed)
    few = members.groupBy("cell").agg(parts_of(F.count(F.lit(1)), F.sum("n")).alias("parts")).where("parts = 1").select("cell")
    small = cut(members.join(few, "cell"), "small", members)
    change(cut(small.transform(bundled).join(texts, "id").groupBy("pivot", "i", "j").applyInArrow(join_cell, "a long, b long"), "links"))
    placed = placed.join(small.select("id"), "id", "left_anti")
    kinds = mixed_regions(placed, ROUNDS)
    if kinds.limit(1).count() == 0:
        return changes
    placed = placed.join(kinds.select("region").distinct(), "region", "left_semi")
    # the components of the first documents by a hash: large ones are likely, and regions of much the same documents choose the same; those are one region from here on
    order = Window.partitionBy("region").orderBy(F.xxhash64(F.lit(ROUNDS), F.col("pivot")), "pivot")
    first = kinds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS)
    pivots = first.groupBy("region").agg(F.sort_array(F.collect_list("pivot")).alias("pivots"))
    placed = cut(placed.join(pivots, "region").select(F.col("pivots").alias("region"), "id", "n", "component").distinct(), "regions", members)
    met = cut(placed.select(F.explode("region").alias("pivot"), "id", "n").distinct(), "met", placed)
    distances = cut(measure_to_pivots(met, texts), "distances")
    change(linked(distances).where("a <> b"))
    several = mixed_regions(placed, ROUNDS)
    if several.limit(1).count():
        placed = placed.join(several.select("region").distinct(), "region", "left_semi")
        changes.append(merged(join_cells(placed, distances, texts), placed))
    return changes


def join_cells(placed: DataFrame, distances: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect components within regions (region, id, n, component), named by their pivots, given distances to those."""
    radius = (100 - LEAST) / 100
    distance = 1 - F.col("shared") / F.greatest("total", F.lit(1))
    # an id of several texts has no one distance and goes to every cell
    far = distances.groupBy(F.col("a").alias("pivot"), F.col("b").alias("id")).agg(F.min(distance).alias("d"), (F.count(F.lit(1)) > 1).alias("several"))
    at = placed.select("region", "id", "n", "component", F.explode("region").alias("pivot")).join(far, ["pivot", "id"])
    near = at.groupBy("region", "id", "n", "component").agg(F.collect_list(F.struct("d", "pivot")).alias("at"), F.min("d").alias("least"), F.max("several").alias("several"))
    # a margin for rounding, on the safe side
    inside = F.filter("at", lambda x: F.col("several") | (x["d"] <= F.col("least") + 2 * radius + 1e-9))
    cells = cut(near.select(F.explode(inside).alias("of"), "id", "n", "component").select("of.pivot", "id", "n", "component").distinct(), "cells", distances)
    kinds = cells.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    main = kinds.groupBy("pivot").agg(F.max(F.struct("size", "component")).alias("m"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    sided = cells.join(main.select("pivot", F.col("m.component").alias("main")), "pivot").withColumn("rest", F.col("component") != F.col("main"))
    load = sided.groupBy("pivot").agg(
        parts_of(F.count(F.when(F.col("rest"), 1)), F.coalesce(F.sum(F.when(F.col("rest"), F.col("n"))), F.lit(0))).alias("rests"),
        parts_of(F.count(F.when(~F.col("rest"), 1)), F.coalesce(F.sum(F.when(~F.col("rest"), F.col("n"))), F.lit(0))).alias("mains"),
    )
    # parts 0 .. rests - 1 are of the rest, those after of the main component; tasks are pairs of parts of which one is of the rest
    own = F.when(F.col("rest"), F.pmod(F.xxhash64(F.lit("cell"), F.col("id")), F.col("rests"))).otherwise(F.col("rests") + F.pmod(F.xxhash64(F.lit("cell"), F.col("id")), F.col("mains")))
    dealt = cut(sided.join(load, "pivot").withColumn("own", own.cast("int")), "dealt", cells)
    with_part = F.when(F.col("rest"), F.sequence(F.lit(0), F.col("rests") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("rests") - 1))
    alone = (F.col("rests") == 1) & (F.col("mains") == 1)
    tasks = dealt.where(~alone).select("pivot", "id", "component", "own", F.explode(with_part).alias("other"))
    tasks = tasks.select("pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("pivot").alias("cell"), "id", "component")
    alike = dealt.where(alone).select(F.col("pivot").alias("cell"), "id", "n", "component").transform(bundled)
    return cut(tasks.unionByName(alike).join(texts, "id").groupBy("pivot", "i", "j").applyInArrow(join_cell, "a long, b long").distinct(), "links", dealt)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bits = bucket_bits(input_bytes(docs) / 15, 4e5)  # a posting for about thirty bytes of text
    scanned = cut(profiles(rows, bits), "sets")
    sets = scanned.where("not common").drop("common")
    common = scanned.where("common").select(F.col("id").alias("name"), "n")
    found = cut(replicate(rows, bits, context.broadcast(late_shingles(common))).groupBy("bucket").applyInArrow(join_bucket, FOUND), "regions")
    crowded, pairs = found.where("crowded"), found.where("not crowded").select("a", "b")
    if crowded.limit(1).count():
        met = crowded.groupBy(F.col("a").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        late = context.broadcast(late_shingles(common.unionByName(met)))
        again = cut(replicate(rows, bits, late, flag_parts(crowded.select("b"), context)).groupBy("bucket").applyInArrow(join_bucket, FOUND), "regions")
        pairs = pairs.unionByName(again.where("not crowded").select("a", "b"))
        crowded = again.where("crowded")
    pairs = cut(pairs.distinct(), "pairs", found)
    # equal sets of different flushes enter a region once
    once = crowded.groupBy("a", "na").agg(F.min(F.struct("b", "nb")).alias("m"))
    crowded = cut(once.select(F.col("a").alias("region"), F.col("m.b").alias("id"), F.col("m.nb").alias("n")), "crowded", found)
    named = sets.where("n > 0 and id is not null")
    near = likely(pairs, named)
    if crowded.limit(1).count():
        sifted = cut(sift(crowded, named), "sifted")
        near = near.unionByName(sifted.where("not crowded").select("a", "b")).distinct()
        crowded = cut(sifted.where("crowded").select(F.col("a").alias("region"), F.col("b").alias("id"), "n").distinct(), "dense", crowded)
    pairs = cut(near, "likely", pairs)
    wanted = flag_parts(pairs.select("a").union(pairs.select("b")).union(crowded.select("id")), context)
    texts = cut(packed_texts(rows, wanted), "texts")
    links = linked(measure(pairs, texts))
    # rows that repeat an id are one node: linked to the representatives of each of their sets
    classes = cut(named.groupBy("f1", "f2", "n").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members"), "classes", scanned)
    repeated = named.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id")
    bridges = named.join(repeated, "id").join(classes, ["f1", "f2", "n"]).where("id <> least").select(F.least("id", "least").alias("a"), F.greatest("id", "least").alias("b"))
    links = cut(links.unionByName(bridges).distinct(), "links", scanned)
    labels = components(links, links)
    changes = join_crowded(crowded, labels, texts)
    own = sets.join(classes.withColumnRenamed("least", "rep"), ["f1", "f2", "n"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")))
    joined = own.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    for change in changes:
        joined = renamed(joined, change, "component")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))
