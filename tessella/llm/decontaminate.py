"""Benchmark decontamination with one Aho-Corasick automaton over normalised questions and answers.

Texts are normalised to lower-case words, and words of items are numbered; every window of ``n`` words of an
item (the whole item where it has fewer) is a key of the automaton, in which a word is the two digits of its number. A text is
scanned once, and the ends of occurrences are mapped back to words and so to bytes of the original text.

Defined cases: null, empty and punctuation-only texts have no words and are never contaminated; an
item without words has no window; repeated items count once by their id, an item without an id hits
words and is listed as an empty name; an empty benchmark leaves every document clean; further columns
of either table are dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_arrow
from tessella.llm.words import fold_table, punctuation_table

#: Bytes of item texts in one automaton; a larger benchmark is scanned in several passes.
AUTOMATON_BYTES = 16 << 20


def normal_table() -> bytes:
    """Translation of bytes: A-Z to a-z, separators to spaces."""
    table = fold_table()
    table[punctuation_table()[table]] = 0x20
    return table.tobytes()


def windows(words: list[str], n: int) -> list[str]:
    """All runs of ``n`` words, or the one run of fewer words."""
    return ["".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def digits(texts: list[list[bytes]]) -> dict[bytes, str]:
    """Two letters for each word, its number to the base of a root of all, so that no node has many edges; the first letter of a word is no word's second, and NUL is in none."""
    words = dict.fromkeys(w for text in texts for w in text)
    base = math.isqrt(len(words)) + 1
    return {w: chr(1 + k // base) + chr(1 + base + k % base) for k, w in enumerate(words)}


def build(items: list[tuple[str, bytes]], n: int) -> tuple[ahocorasick.Automaton | None, dict[bytes, str], list[tuple[int, tuple[str, ...]]]]:
    """The automaton, whose values number the keys; the letters of words; for each key its length in words and its items."""
    table, of = normal_table(), defaultdict(set)
    texts = [text.translate(table).split() for _, text in items]
    letters = digits(texts)
    for (name, _), words in zip(items, texts, strict=True):
        for w in windows([letters[x] for x in words], n):
            of[w].add(name)
    if not of:
        return None, letters, []
    automaton, keys = ahocorasick.Automaton(ahocorasick.STORE_INTS), []
    for w, names in of.items():
        automaton.add_word(w, len(keys))
        keys.append((len(w) // 2, tuple(sorted(names))))
    automaton.make_automaton()
    return automaton, letters, keys


class Scanner:
    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.table = normal_table()
        self.automaton, self.letters, self.keys = build(items, n)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, disjoint ranges of hit words in order, names of items that occur."""
        words = text.translate(self.table).split()
        if not words or self.automaton is None:
            return len(words), [], set()
        get = self.letters.get
        found = list(self.automaton.iter("".join([get(w, "\0\0") for w in words])))
        if not found:
            return len(words), [], set()
        names: set[str] = set()
        ranges: list[tuple[int, int]] = []
        for start, stop in sorted((end // 2 + 1 - self.keys[k][0], end // 2 + 1) for end, k in found):
            if ranges and start <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(stop, ranges[-1][1]))
            else:
                ranges.append((start, stop))
        for k in {k for _, k in found}:
            names.update(self.keys[k][1])
        return len(words), ranges, names

    def spans(self, text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Byte ranges of the original text that ranges of words cover."""
        separator = np.frombuffer(text.translate(self.table), np.uint8) == 0x20
        edge = np.flatnonzero(np.diff(np.concatenate([[True], separator, [True]]).astype(np.int8)))
        return [(int(edge[2 * a]), int(edge[2 * b - 1])) for a, b in ranges]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> list[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size, streamed to the driver a partition at a time."""
    blocks: list[list[tuple[str, bytes]]] = [[]]
    size = 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.encode(F.col(text_col), "UTF-8").alias("t")).where("t is not null")
    for row in rows.toLocalIterator():
        if size and size + len(row.t) > limit:
            blocks.append([])
            size = 0
        blocks[-1].append((row.i or "", bytes(row.t)))
        size += len(row.t)
    return blocks


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(id, n_words, words array<struct<start,stop>>, spans array<struct<start,stop>>, items array<string>) of every row.

    ``words`` are ranges of hit words, ``spans`` the bytes of the original UTF-8 text they cover. Items
    beyond ``block_bytes`` go to further automata, each scanned for in one pass; their ranges are merged.
    """
    context = docs.sparkSession.sparkContext
    ranges_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = "id long, row long, n_words long, words array<struct<start:long,stop:long>>, spans array<struct<start:long,stop:long>>, items array<string>"
    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("row"))
    if len(blocks) > 1:  # rows need a name of their own, as ids may repeat
        rows = rows.withColumn("row", F.xxhash64("id", "text"))

    def passed(items: list[tuple[str, bytes]]) -> DataFrame:
        shared = context.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(shared.value, n)
            for batch in batches:
                out = []
                for text in batch.column(1).cast(pa.large_binary()):
                    raw = text.as_py() or b""
                    count, ranges, names = scanner.scan(raw)
                    out.append((count, ranges, scanner.spans(raw, ranges) if ranges else [], sorted(names)))
                as_structs = lambda k: pa.array([[{"start": a, "stop": b} for a, b in x[k]] for x in out], ranges_type)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([x[0] for x in out], pa.int64()), as_structs(1), as_structs(2), pa.array([x[3] for x in out], pa.list_(pa.string()))],
                    ["id", "row", "n_words", "words", "spans", "items"],
                )

        return map_arrow(rows, run, schema)

    result = passed(blocks[0])
    if len(blocks) > 1:
        for items in blocks[1:]:
            result = result.unionByName(passed(items))
        result = (
            result.groupBy("id", "row")
            .agg((F.count(F.lit(1)) / len(blocks)).cast("int").alias("copies"), F.first("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("words", "spans", "items")))
            .select("id", "row", "n_words", merged("words").alias("words"), merged("spans").alias("spans"), F.array_distinct("items").alias("items"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
        )
    return result.select(F.col("id").alias(id_col), "n_words", "words", "spans", "items")


def merged(column: str):
    """Disjoint ranges that cover the same as an array of ranges."""
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def step(done, r):
        last = F.element_at(done, -1)
        joined = F.named_struct(F.lit("start"), last["start"], F.lit("stop"), F.greatest(last["stop"], r["stop"]))
        return F.when(F.size(done) == 0, F.array(r)).when(r["start"] <= last["stop"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(column), empty, step)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, **names) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    found = scan(docs, benchmark, n, **names)
    id_col = names.get("id_col", "doc_id")
    hit = F.aggregate("words", F.lit(0).cast("long"), lambda s, r: s + r["stop"] - r["start"])
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (F.size("words") > 0).alias("contaminated"),
    )


def digest(names: list[str]) -> str:
    """The digest of a set of items, for tests."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
