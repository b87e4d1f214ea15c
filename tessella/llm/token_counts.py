"""Token counts by heap-and-linked-list byte-pair merging.

The count of a word is its initial symbols less the merges that byte-pair encoding makes: adjacent
pairs wait in a heap by rank, the symbols form a linked list, and the lowest rank is merged again and
again. No identifiers are emitted, so nothing but counts leaves a worker.

Defined cases: null and empty texts count 0 tokens and 0 bytes; repeated rows are counted each;
special strings inside texts count one token each and split the text; columns other than the id and
the text are dropped.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_arrow
from tessella.llm.words import utf8

#: Words kept in a worker's memory; the memory starts afresh beyond it.
MEMORY_WORDS = 400_000


def load_vocabulary(path: str) -> dict:
    """What counting needs of a tokenizer file: merges in rank order, pattern, suffix, special strings."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return {
        "merges": merges,
        # \s of the library's regular expressions is the Unicode property
        "pattern": split["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"),
        "suffix": spec["model"]["end_of_word_suffix"] or "",
        "special": [x["content"] for x in spec["added_tokens"] if x["special"]],
    }


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class TokenCounter(dict):
    """Maps a word to its number of tokens; unknown words are merged once and remembered."""

    def __init__(self, vocabulary: dict):
        super().__init__()
        self.find = regex.compile(vocabulary["pattern"]).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary["special"], key=len, reverse=True)))) if vocabulary["special"] else None
        symbols, suffix = byte_symbols(), vocabulary["suffix"]
        number: dict[str, int] = {}
        for s in (*symbols, *(x + suffix for x in symbols)):
            number.setdefault(s, len(number))
        self.inner, self.last = [number[s] for s in symbols], [number[s + suffix] for s in symbols]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(vocabulary["merges"]):
            pair = (number.setdefault(a, len(number)), number.setdefault(b, len(number)))
            self.ranks.setdefault(pair, (rank, number.setdefault(a + b, len(number))))

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = n = self.merge(word.encode("utf-8", "surrogatepass"))
        return n

    def merge(self, raw: bytes) -> int:
        ranks, inner = self.ranks, self.inner
        symbol = [inner[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        n = left = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = ranks.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two was merged since
            symbol[i], symbol[j] = made, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = ranks.get((made, symbol[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, made, symbol[k], found[1]))
            h = before[i]
            if h >= 0:
                found = ranks.get((symbol[h], made))
                if found:
                    heapq.heappush(heap, (found[0], h, symbol[h], made, found[1]))
        return left

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case is taken letter by letter, without the final form of sigma
                text = text.replace("Σ", "σ")
        return sum(map(self.__getitem__, self.find(text.lower())))

    def tokens(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


def count_tokens(docs: DataFrame, vocabulary: dict, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row. The vocabulary (a fixed file of a few MB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(shared.value)
        for batch in batches:
            _, bounds = utf8(batch.column(1))
            n = [counter.tokens(x.as_py()) if x.is_valid else 0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = map_arrow(rows, run, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
