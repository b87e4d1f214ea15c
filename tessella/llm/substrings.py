"""Substring deduplication with a log-structured index of window fingerprints.

Every window of ``WINDOW`` words has a fingerprint. The index holds immutable runs: for each bucket of
fingerprints, the sorted fingerprints of the documents taken in so far with the first document and
word in which each starts. A new batch is dealt into the same buckets, sorted, and merge-joined with the
runs and with itself; windows that also start in a document of smaller id are hits, those of one task's share before they are dealt. The batch then
becomes a run, and when there are ``FANOUT`` of them they are compacted into one. Runs and a manifest of them stand in a folder;
``FingerprintIndex.open`` takes an index up again in a later session, and only ``vacuum`` deletes what the manifest no longer lists.

Hits are verified: stretches of consecutive hits that meet the same stretch of one earlier document are
compared by the BLAKE2b digests of the words themselves, taken from both texts. A fingerprint is 56 bits of one lane of the window's hash and, by its bucket,
6 to 20 bits of the other. Where a stretch differs from what it met, its windows are looked up again by their words in all texts (``resolve``), so
equal fingerprints of different windows cost work and never a result.

Fingerprints travel packed, many to a row, so neither documents nor windows are rows of a shuffle; a window
that very many documents share comes to its bucket once from each task's share.

Defined cases: null and empty texts have no words; texts of fewer than 13 words are kept whole; very long texts are hashed in
pieces, and hold in memory their words and 24 bytes a word; rows that repeat a doc_id are not smaller than one another, also with different texts (told
apart by 64 bits of a hash of the text); of windows that start in several smaller documents any may be the one that is met; rows without an id are kept whole and remove
nothing; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.blobs import bucket_bits, flag_slots, flags, pack, split_sorted, unpack, unpack_all
from tessella.llm.common import cut, delete, input_bytes, list_folder, map_arrow, new_path, write_text
from tessella.llm.flagging import flag_parts
from tessella.llm.words import Hasher, chunks, mix, ngrams, rows_of, space_table, utf8

WINDOW = 13
FANOUT = 4
#: Bytes of the number of a word.
PLACE = 4
#: Windows gathered in a task before they are dealt out.
FLUSH = 1 << 19
BLOB = "kind int, bucket int, ids binary, counts binary, fps binary, pos binary, tags binary, other_tags binary"
BLOB_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("ids", "counts", "fps", "pos", "tags", "other_tags"))])
NEW, OLD, HIT, RUN = 0, 1, 2, 3


def tag(raw: bytes) -> int:
    """Tells texts of one id apart: 64 bits, never 0."""
    return xxhash.xxh3_64_intdigest(raw, 0x7A6) or 1


def _row(kind: int, bucket: int, ids=b"", counts=b"", fps=b"", pos=b"", tags=b"", other_tags=b"") -> tuple:
    return kind, bucket, ids, counts, fps, pos, tags, other_tags


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(BLOB_ARROW.types)], schema=BLOB_ARROW)


def pack_tags(tags: np.ndarray) -> bytes:
    """Nothing where no row needs one."""
    return pack(tags) if tags.any() else b""


def unpack_tags(rows: list[bytes], sizes: list[int]) -> np.ndarray:
    return np.concatenate([unpack(x) if x else np.zeros(n, np.uint64) for x, n in zip(rows, sizes, strict=True)]) if rows else np.zeros(0, np.uint64)


def hits_within(ids: np.ndarray, pos: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that also start in a document of smaller id among those given, and for each the first such window of the smallest id."""
    order = np.argsort(fps)
    same = fps[order[1:]] == fps[order[:-1]]
    member = np.zeros(len(fps), bool)
    member[order[1:][same]] = member[order[:-1][same]] = True
    some = np.flatnonzero(member)
    some = some[np.lexsort((pos[some], ids[some], fps[some]))]
    edges = split_sorted(fps[some])
    first = np.repeat(some[edges[:-1]], np.diff(edges))
    later = ids[some] > ids[first]
    return some[later], first[later]


def hit_rows(ids: np.ndarray, pos: np.ndarray, tags: np.ndarray, other: np.ndarray, other_pos: np.ndarray, other_tags: np.ndarray, parts: int) -> list[tuple]:
    """Packed hits, by part of the documents."""
    if not len(ids):
        return []
    part = flag_slots(ids) % parts
    order = np.lexsort((pos, tags, ids, part))
    ids, pos, tags, other, other_pos, other_tags, part = (x[order] for x in (ids, pos, tags, other, other_pos, other_tags, part))
    cuts = split_sorted(part)
    # the distance between the two places is mostly that of the entry before
    shift = (other_pos - pos).astype(np.int64).view(np.uint64)
    return [
        _row(HIT, int(part[a]), pack(ids[a:b].astype(np.uint64)), pack(other[a:b].astype(np.uint64)), pack(shift[a:b]), pack(pos[a:b], PLACE), pack_tags(tags[a:b]), pack_tags(other_tags[a:b]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True)
    ]


def row_tags(ids: np.ndarray, data: np.ndarray, bounds: np.ndarray, marked: np.ndarray | None) -> np.ndarray:
    """The tag of each row; 0 for ids that are not flagged as repeated."""
    tags = np.zeros(len(ids), np.uint64)
    for i in np.flatnonzero(marked[flag_slots(ids)]) if marked is not None else ():
        tags[i] = tag(data[bounds[i] : bounds[i + 1]].tobytes())
    return tags


def windows_of(hasher: Hasher, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, number of the first word, two lanes of hashes) of all windows of a batch of texts, a chunk of rows at a time."""
    for i, j in chunks(bounds):
        words, first = hasher.words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        fps = ngrams(words, WINDOW)
        if not fps.shape[1]:
            continue
        row = rows_of(first)
        start = np.flatnonzero(row[: fps.shape[1]] == row[WINDOW - 1 :])  # windows within one row
        yield row[start] + i, start - first[row[start]], fps[:, start]


def fingerprint_rows(docs: DataFrame, bits: int, width: int, seed: int, repeated=None) -> DataFrame:
    """Fingerprints of all windows of (id, text), dealt into 2^bits buckets, packed. Rows of ids flagged in ``repeated`` carry a tag of their text.

    Of a window that several documents of a flush share, only that of the smallest id goes to its bucket; the others are hits
    already, dealt by document. So a bucket gets a window once from each flush, however many documents hold it.
    """

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, pos, tags, fps, other = (np.concatenate(x) for x in zip(*held, strict=True))
        hit, first = hits_within(ids, pos, fps)
        known = hit_rows(ids[hit], pos[hit], tags[hit], ids[first], pos[first], tags[first], 1 << bits)
        for k in range(0, len(known), 256):
            yield _batch(known[k : k + 256])
        rest = np.ones(len(ids), bool)
        rest[hit] = False
        ids, pos, tags, fps, bucket = ids[rest], pos[rest], tags[rest], fps[rest], (other[rest] >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")  # within a bucket, rows stay as they came
        ids, pos, tags, fps, bucket = ids[order], pos[order], tags[order], fps[order], bucket[order]
        edges, rows = split_sorted(bucket), []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            runs = np.concatenate([[0], np.flatnonzero((ids[a + 1 : b] != ids[a : b - 1]) | (tags[a + 1 : b] != tags[a : b - 1])) + 1, [b - a]])
            rows.append(_row(NEW, int(bucket[a]), pack(ids[a:b][runs[:-1]].astype(np.uint64)), pack(np.diff(runs), 4), pack(fps[a:b], width), pack(pos[a:b], PLACE), pack_tags(tags[a:b][runs[:-1]])))
            if len(rows) == 256:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, n = Hasher(space_table(), False), [], 0
        marked = flags([repeated.value]) if repeated is not None else None
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, bounds = utf8(batch.column(1))
            tags = row_tags(ids, data, bounds, marked)
            for row, pos, lanes in windows_of(hasher, data, bounds):
                fps = lanes[0] if not seed else mix(lanes[0] ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
                held.append((ids[row], pos, tags[row], fps, lanes[1]))
                n += len(row)
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return map_arrow(docs, run, BLOB)


def merge_bucket(table: pa.Table, width: int, parts: int, keep: bool) -> pa.Table:
    """One bucket: merge-joins new windows with runs; gives packed hits by part of the documents, those found before too, and the batch's run if ``keep``."""
    kinds = table["kind"].to_numpy()
    bucket = int(table["bucket"][0].as_py())
    take = lambda name, which: [x for x, k in zip(table[name].to_pylist(), kinds, strict=True) if k == which]
    out = [_row(HIT, bucket, *x) for x in zip(*(take(c, HIT) for c in ("ids", "counts", "fps", "pos", "tags", "other_tags")), strict=True)]
    counts = unpack_all(take("counts", NEW), 4).astype(np.int64)
    row_ids = take("ids", NEW)
    ids = np.repeat(unpack_all(row_ids).view(np.int64), counts)
    tags = np.repeat(unpack_tags(take("tags", NEW), [len(x) // 8 for x in row_ids]), counts)
    fps, pos = unpack_all(take("fps", NEW), width), unpack_all(take("pos", NEW), PLACE).astype(np.int64)
    if len(fps):
        order = np.lexsort((pos, ids, fps))
        fps, ids, pos, tags = fps[order], ids[order], pos[order], tags[order]
        edges = split_sorted(fps)
        size, head = np.diff(edges), edges[:-1]
        unique, first_id, first_pos, first_tag = fps[head], ids[head], pos[head], tags[head]
        own = (first_id.copy(), first_pos.copy(), first_tag.copy())
        for old in zip(*(take(c, OLD) for c in ("fps", "ids", "pos", "tags")), strict=True):
            run = unpack(old[0], width)
            at = np.searchsorted(run, unique)
            at[at == len(run)] = 0
            known = run[at] == unique if len(run) else np.zeros(len(unique), bool)
            if not known.any():
                continue
            run_id, run_pos, run_tag = unpack(old[1]).view(np.int64)[at], unpack(old[2], PLACE).astype(np.int64)[at], unpack_tags([old[3]], [len(run)])[at]
            better = known & (run_id < first_id)
            first_id[better], first_pos[better], first_tag[better] = run_id[better], run_pos[better], run_tag[better]
        least, least_pos, least_tag = np.repeat(first_id, size), np.repeat(first_pos, size), np.repeat(first_tag, size)
        hit = np.flatnonzero(ids > least)
        out += hit_rows(ids[hit], pos[hit], tags[hit], least[hit], least_pos[hit], least_tag[hit], parts)
        if keep:
            out.append(_row(RUN, bucket, pack(own[0].astype(np.uint64)), b"", pack(unique, width), pack(own[1], PLACE), pack_tags(own[2])))
    return pa.Table.from_batches([_batch(out)], BLOB_ARROW)


def compact_bucket(table: pa.Table, width: int) -> pa.Table:
    """All runs of a bucket as one: each fingerprint with the smallest document and word."""
    packed = table["fps"].to_pylist()
    fps, ids, pos = unpack_all(packed, width), unpack_all(table["ids"].to_pylist()).view(np.int64), unpack_all(table["pos"].to_pylist(), PLACE)
    tags = unpack_tags(table["tags"].to_pylist(), [len(x) // width for x in packed])
    order = np.lexsort((pos, ids, fps))
    first = order[split_sorted(fps[order])[:-1]]
    row = _row(RUN, int(table["bucket"][0].as_py()), pack(ids[first].astype(np.uint64)), b"", pack(fps[first], width), pack(pos[first], PLACE), pack_tags(tags[first]))
    return pa.Table.from_batches([_batch([row])], BLOB_ARROW)


STRETCH = "id long, tag long, pos binary, len binary, other binary, other_pos binary, other_tag binary"
STRETCH_ARROW = pa.schema([("id", pa.int64()), ("tag", pa.int64()), *((c, pa.binary()) for c in ("pos", "len", "other", "other_pos", "other_tag"))])


def stretch_rows(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, other: np.ndarray, other_tags: np.ndarray, shift: np.ndarray) -> pa.Table:
    """Hits as stretches of consecutive windows that meet consecutive windows of one other text, a row for each text."""
    order = np.lexsort((pos, tags, ids))
    ids, tags, pos, other, other_tags, shift = (x[order] for x in (ids, tags, pos, other, other_tags, shift))
    text = np.ones(len(ids), bool)
    text[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
    new = text.copy()
    new[1:] |= (other[1:] != other[:-1]) | (other_tags[1:] != other_tags[:-1]) | (shift[1:] != shift[:-1]) | (pos[1:] != pos[:-1] + 1)
    start = np.flatnonzero(new)
    length = np.diff(np.concatenate([start, [len(ids)]]))
    docs = np.concatenate([np.flatnonzero(text[start]), [len(start)]])
    columns = (pos[start], length, other[start].astype(np.uint64), (pos + shift)[start], other_tags[start])
    rows = [(int(ids[start[a]]), int(tags[start[a]].astype(np.int64)), *(pack(x[a:b]) for x in columns)) for a, b in zip(docs[:-1], docs[1:], strict=True)]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(STRETCH_ARROW.types)], schema=STRETCH_ARROW)


def stretches(table: pa.Table) -> pa.Table:
    """The stretches of one part of the documents."""
    packed = table["ids"].to_pylist()
    sizes = [len(x) // 8 for x in packed]
    signed = lambda name: unpack_all(table[name].to_pylist()).view(np.int64)
    places = unpack_all(table["pos"].to_pylist(), PLACE).astype(np.int64)
    return stretch_rows(signed("ids"), unpack_tags(table["tags"].to_pylist(), sizes), places, signed("counts"), unpack_tags(table["other_tags"].to_pylist(), sizes), signed("fps"))


class FingerprintIndex:
    """Runs of window fingerprints in a folder; ``ingest`` takes batches in any order of ids, finding hits on what is there and in the batch itself.

    The folder holds the runs and numbered manifests, of which the last counts: the parameters of the index and the names of
    its runs. A manifest appears when its runs are whole, so a session that fails leaves the index as it was. Without a ``path`` the index is one for the session
    and goes with the driver.
    """

    def __init__(self, spark: SparkSession, bits: int, width: int = 7, seed: int = 0, repeated=None, path: str | None = None):
        self.spark, self.bits, self.width, self.seed, self.repeated = spark, bits, width, seed, repeated
        self.path = (path or new_path(spark, "index")).rstrip("/")
        self.runs: list[str] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, repeated=None) -> FingerprintIndex:
        """The index that an earlier session left in ``path``."""
        path = path.rstrip("/")
        names = [n for n in list_folder(spark, f"{path}/manifest") if n.endswith(".json")]
        if not names:
            raise FileNotFoundError(f"no index in {path}")
        state = json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest/{names[-1]}").collect()))
        if state["window"] != WINDOW or state["place"] != PLACE:
            raise ValueError(f"the index in {path} has windows of {state['window']} words")
        index = cls(spark, state["bits"], state["width"], state["seed"], repeated, path)
        index.runs, index.version = [f"{path}/{r}" for r in state["runs"]], int(names[-1].split(".")[0])
        return index

    def _commit(self, runs: list[str]) -> None:
        state = {"window": WINDOW, "place": PLACE, "bits": self.bits, "width": self.width, "seed": self.seed, "runs": [r.rsplit("/", 1)[1] for r in runs]}
        write_text(self.spark, f"{self.path}/manifest/{self.version + 1:09d}.json", json.dumps(state))
        self.version += 1
        self.runs = runs

    def _history(self) -> DataFrame | None:
        if not self.runs:
            return None
        return self.spark.read.schema(BLOB).parquet(*self.runs).where(F.col("kind") == RUN).withColumn("kind", F.lit(OLD))

    def ingest(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """Packed hits of (id, text). The batch becomes a run, unless it is the ``last``."""
        width, parts = self.width, 1 << self.bits
        rows, history = fingerprint_rows(docs, self.bits, width, self.seed, self.repeated), self._history()
        if history is not None:
            rows = rows.unionByName(history)
        merged = rows.groupBy("bucket").applyInArrow(lambda t: merge_bucket(t, width, parts, not last), BLOB)
        path = f"{self.path}/run-{uuid.uuid4().hex}"
        merged.write.parquet(path)
        if not last:
            self._commit([*self.runs, path])
            if len(self.runs) >= FANOUT:
                self.compact()
        return self.spark.read.schema(BLOB).parquet(path).where(F.col("kind") == HIT)

    def compact(self) -> None:
        """Merges all runs into one; runs are never changed in place, and those merged stay until ``vacuum``."""
        width = self.width
        runs = self.spark.read.schema(BLOB).parquet(*self.runs).where(F.col("kind") == RUN)
        path = f"{self.path}/run-{uuid.uuid4().hex}"
        runs.groupBy("bucket").applyInArrow(lambda t: compact_bucket(t, width), BLOB).write.parquet(path)
        self._commit([path])

    def vacuum(self) -> None:
        """Deletes runs that the manifest no longer lists, and with them hits that were given and not yet read."""
        for name in list_folder(self.spark, self.path):
            if name.startswith("run-") and f"{self.path}/{name}" not in self.runs:
                delete(self.spark, f"{self.path}/{name}")


CHECK = "array<struct<at:long,other:long,other_tag:long,pos:long,len:long,digest:binary>>"
DONE = f"id long, tag long, mine boolean, n_words long, n_removed long, kept_sha256 string, kept string, checks {CHECK}"
CHECK_ARROW = pa.list_(pa.struct([("at", pa.int64()), ("other", pa.int64()), ("other_tag", pa.int64()), ("pos", pa.int64()), ("len", pa.int64()), ("digest", pa.binary())]))
DONE_ARROW = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("mine", pa.bool_()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("checks", CHECK_ARROW)])


def finish_text(raw: bytes, ident: int | None, own_tag: int, own: tuple, asked: list[dict], with_text: bool) -> tuple:
    """Removes what stretches cover and takes the digests that verify them: of the own stretches (``at`` says where), and of those asked for.

    A stretch beyond the end of the text is not of this text: it removes nothing, and its digest, of nothing, equals no other's.
    """
    words = raw.split()
    gone = np.zeros(len(words) + 1, np.int64)
    checks = []

    def span(a: int, n: int) -> bytes:
        return hashlib.blake2b(b" ".join(words[a : a + n + WINDOW - 1]), digest_size=16).digest() if a + n + WINDOW - 1 <= len(words) else b""

    for a, n, other, pos, other_tag in zip(*own, strict=True):
        if a + n + WINDOW - 1 <= len(words):
            gone[a] += 1
            gone[a + n + WINDOW - 1] -= 1
        checks.append({"at": a, "other": other, "other_tag": other_tag, "pos": pos, "len": n, "digest": span(a, n)})
    for q in asked:
        checks.append({"at": None, "other": ident, "other_tag": own_tag, "pos": q["pos"], "len": q["len"], "digest": span(q["pos"], q["len"])})
    keep = np.cumsum(gone[:-1]) == 0
    kept = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k) if checks else b" ".join(words)
    return len(words), len(words) - int(keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None, checks


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def flag_repeated(rows: DataFrame):
    """A broadcast of flags for ids of several rows, or None."""
    several = cut(rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated")
    return flag_parts(several, rows.sparkSession.sparkContext) if several.limit(1).count() else None


def bits_for(docs: DataFrame) -> int:
    return bucket_bits(input_bytes(docs) / 3, 3.5e5)  # a window is about six bytes of text, which files hold in half of that


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history_share: float = 0.1, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of every row.

    The first ``history_share`` of the range of ids is ingested in ``FANOUT`` batches, whose runs are compacted into the history that the rest is joined with.
    """
    spark = docs.sparkSession
    rows = texts_of(docs, id_col, text_col)
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    if low is None:
        low = high = 0
    borders = sorted({int(low + (high - low) * history_share * k / FANOUT) for k in range(1, FANOUT + 1)})
    repeated = flag_repeated(rows)
    index = FingerprintIndex(spark, bits_for(docs), repeated=repeated)
    hits, before = [], None
    for border in borders:
        batch = rows.where(F.col("id") <= border)
        hits.append(index.ingest(batch if before is None else batch.where(F.col("id") > before)))
        before = border
    hits.append(index.ingest(rows.where(F.col("id") > before), last=True))
    done = _result(rows, hits, None, with_text, repeated)
    delete(spark, index.path)
    return _columns(done, id_col, with_text)


def deduplicate_against(index: FingerprintIndex, docs: DataFrame, history: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``deduplicate`` of a new batch against an index, which then holds the batch too.

    ``history`` are the texts that were ingested before: hits on them are verified by their words. Ids that stand in both are repeated ids.
    Documents taken in before are not judged again, so batches should come in order of ids where results shall be those of one batch.
    """
    rows, old = texts_of(docs, id_col, text_col), texts_of(history, id_col, text_col)
    index.repeated = flag_repeated(rows.unionByName(old))
    done = _result(rows, [index.ingest(rows)], old, with_text, index.repeated)
    return _columns(done, id_col, with_text)


def _columns(done: DataFrame, id_col: str, with_text: bool) -> DataFrame:
    return done.where("mine").select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else []))


def _result(rows: DataFrame, hits: list[DataFrame], history: DataFrame | None, with_text: bool, repeated) -> DataFrame:
    """The finished rows; stretches that differ from what they met are looked up again by their words."""
    met = hits[0]
    for more in hits[1:]:
        met = met.unionByName(more)
    found = cut(met.groupBy("bucket").applyInArrow(stretches, STRETCH), "stretches")
    rows = rows.withColumn("mine", F.lit(True))
    if history is not None:
        rows = rows.unionByName(history.withColumn("mine", F.lit(False)))
    done = _finish(rows, found, with_text, repeated)
    wrong = false_stretches(done)
    if wrong is None:
        return done
    return _finish(rows, mend(found, wrong, resolve(rows, wrong, repeated)), with_text, repeated)


def false_stretches(done: DataFrame) -> DataFrame | None:
    """(id, tag, pos, len) of stretches whose words are not those of the stretch they met; None where there are none."""
    place = ["other", "other_tag", "pos", "len"]
    checks = done.select("id", "tag", F.explode("checks").alias("c")).select("id", "tag", "c.*")
    one = checks.groupBy(*place).agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.max(F.col("at").isNull()).alias("known")).where("a <> b or not known")
    one = cut(one.select(*place), "false-places")
    if one.limit(1).count() == 0:
        return None
    # a stretch that several texts met is looked up again for all of them
    return cut(checks.where("at is not null").join(one, place).select("id", "tag", F.col("at").alias("pos"), "len"), "false-stretches")


def resolve(rows: DataFrame, wrong: DataFrame, repeated) -> DataFrame:
    """(id, tag, pos, other, other_tag, other_pos): for windows of the given stretches that really start in a smaller document too, by their words in all texts."""
    context = rows.sparkSession.sparkContext

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of false stretches: their hash, and their words."""
        hasher = Hasher(space_table(), False)
        marked = flags([repeated.value]) if repeated is not None else None
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, bounds = utf8(batch.column(1))
            tags = row_tags(ids, data, bounds, marked).view(np.int64)
            out = set()
            for r, asked in enumerate(batch.column(2).to_pylist()):
                words = data[bounds[r] : bounds[r + 1]].tobytes().split()
                for q in asked:
                    if q["tag"] == tags[r]:
                        out |= {b" ".join(words[k : k + WINDOW]) for k in range(q["pos"], min(q["pos"] + q["len"], len(words) - WINDOW + 1))}
            lanes = [ngrams(hasher.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0], WINDOW)[0, 0] for w in out]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(lanes, np.uint64).view(np.int64)), pa.array(list(out), pa.binary())], ["hash", "window"])

    stretch = F.struct("tag", "pos", "len")
    texts = rows.where("id is not null").select("id", "text").join(wrong.groupBy("id").agg(F.collect_set(stretch).alias("asked")), "id")
    wanted = cut(map_arrow(texts, each, "hash long, window binary").distinct(), "false-windows")
    mark = flag_parts(wanted.select("hash"), context)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, want = Hasher(space_table(), False), flags([mark.value])
        marked = flags([repeated.value]) if repeated is not None else None
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, bounds = utf8(batch.column(1))
            tags = row_tags(ids, data, bounds, marked).view(np.int64)
            for row, pos, lanes in windows_of(hasher, data, bounds):
                some = np.flatnonzero(want[flag_slots(lanes[0].view(np.int64))])
                texts, out = {}, []
                for k in some.tolist():
                    r = int(row[k])
                    words = texts.get(r)
                    if words is None:
                        texts.clear()  # rows come in order
                        words = texts[r] = data[bounds[r] : bounds[r + 1]].tobytes().split()
                    out.append(b" ".join(words[pos[k] : pos[k] + WINDOW]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[some]]), pa.array(tags[row[some]]), pa.array(pos[some], pa.int64()), pa.array(out, pa.binary())], ["id", "tag", "pos", "window"])

    known = rows.where("id is not null").select("id", "text")
    held = cut(map_arrow(known, places, "id long, tag long, pos long, window binary").join(wanted.select("window"), "window", "left_semi"), "window-places")
    first = held.groupBy("window").agg(F.min(F.struct("id", "tag", "pos")).alias("first"))
    return held.join(first, "window").where(F.col("id") > F.col("first.id")).select("id", "tag", "pos", F.col("first.id").alias("other"), F.col("first.tag").alias("other_tag"), F.col("first.pos").alias("other_pos"))


def mend(found: DataFrame, wrong: DataFrame, hits: DataFrame) -> DataFrame:
    """The stretches without those that are wrong, and with what their windows really met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                columns = [unpack(r[c] or b"").view(np.int64) for c in ("pos", "len", "other", "other_pos", "other_tag")]
                false = {(q["pos"], q["len"]) for q in r["wrong"] or ()}
                bad = {p + k for p, n in false for k in range(n)}
                keep = np.array([(p, n) not in false for p, n in zip(columns[0].tolist(), columns[1].tolist(), strict=True)], bool)
                pos, length, other, other_pos, other_tag = (c[keep] for c in columns)
                within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                new = [h for h in r["hits"] or () if h["pos"] in bad]
                get = lambda name, new=new: np.array([h[name] for h in new], np.int64)
                places = np.concatenate([np.repeat(pos, length) + within, get("pos")])
                shift = np.concatenate([np.repeat(other_pos - pos, length), get("other_pos") - get("pos")])
                others, tags = np.concatenate([np.repeat(other, length), get("other")]), np.concatenate([np.repeat(other_tag, length), get("other_tag")])
                ids, own = np.full(len(places), r["id"], np.int64), np.full(len(places), r["tag"], np.int64).view(np.uint64)
                yield from stretch_rows(ids, own, places, others, tags.view(np.uint64), shift).to_batches()

    key = ["id", "tag"]
    bad = wrong.groupBy(*key).agg(F.collect_set(F.struct("pos", "len")).alias("wrong"))
    new = hits.join(wrong.select(*key).distinct(), key).groupBy(*key).agg(F.collect_list(F.struct("pos", "other", "other_tag", "other_pos")).alias("hits"))
    return cut(map_arrow(found.join(bad, key, "left").join(new, key, "left"), run, STRETCH), "stretches")


def _ask(found: DataFrame) -> DataFrame:
    """(id, tag, asked): the stretches of each earlier text whose digests are needed, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [unpack_all(batch.column(k).to_pylist()).view(np.int64) for k in (4, 6, 5, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "tag", "pos", "len"])

    each = map_arrow(found, run, "id long, tag long, pos long, len long").distinct()
    return each.groupBy("id", "tag").agg(F.collect_list(F.struct("pos", "len")).alias("asked"))


def _finish(rows: DataFrame, found: DataFrame, with_text: bool, repeated) -> DataFrame:
    """Result rows with the digests that verify them. Texts that no stretch touches end in the scan; others travel compressed to their stretches."""
    context = rows.sparkSession.sparkContext
    asks = cut(_ask(found), "asks")
    touched = flag_parts(found.select("id").unionByName(asks.select("id")), context)
    scan_types = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("mine", pa.bool_()), ("packed", pa.binary()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, packer = flags([touched.value]), zstandard.ZstdCompressor(level=3)
        doubled = flags([repeated.value]) if repeated is not None else None
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            slots = flag_slots(ids.fill_null(0).to_numpy(zero_copy_only=False))
            mark, texts, out = marked[slots] & known, batch.column(1).cast(pa.large_binary()), []
            several = (doubled[slots] & known) if doubled is not None else np.zeros(len(known), bool)
            for i, (m, s) in enumerate(zip(mark.tolist(), several.tolist(), strict=True)):
                raw = texts[i].as_py() or b""
                out.append((np.uint64(tag(raw)).astype(np.int64).item() if s else 0, *((packer.compress(raw), None, None, None) if m else (None, *_plain(raw, with_text)))))
            columns = [ids, pa.array([x[0] for x in out], pa.int64()), batch.column(2), *(pa.array([x[k] for x in out], scan_types.types[k + 2]) for k in range(1, 5))]
            yield pa.RecordBatch.from_arrays(columns, schema=scan_types)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["packed"] is None:
                    out.append((r["id"], r["tag"], r["mine"], r["n_words"], 0, r["kept_sha256"], r["kept"], []))
                else:
                    own = tuple(unpack(r[c] or b"").view(np.int64).tolist() for c in ("pos", "len", "other", "other_pos", "other_tag"))
                    out.append((r["id"], r["tag"], r["mine"], *finish_text(opener.decompress(r["packed"]), r["id"], r["tag"], own, r["asked"] or [], with_text)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(DONE_ARROW.types)], schema=DONE_ARROW)

    scanned = map_arrow(rows.select("id", "text", "mine"), first, "id long, tag long, mine boolean, packed binary, n_words long, kept_sha256 string, kept string")
    joined = scanned.join(found, ["id", "tag"], "left").join(asks, ["id", "tag"], "left")
    return cut(map_arrow(joined, last, DONE), "deduplicated")


def _plain(raw: bytes, with_text: bool) -> tuple[int, str, str | None]:
    words = raw.split()
    kept = b" ".join(words)
    return len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None
