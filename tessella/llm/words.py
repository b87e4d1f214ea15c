"""Vectorised word tables over batches of UTF-8 text: boundaries, 128-bit word hashes, n-gram hashes, exact n-gram numbers.

Words are told apart by their bytes (a dictionary of each piece of text) and hashed one by one with XXH3-128, so that no
structure of their letters carries over to the hash. Hashes come as two lanes of 64 bits. Long rows are worked through in pieces cut at separators, so
that the working memory does not grow with a row beyond its hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20
#: Words whose n-grams are taken at once, so that the steps stay in a core's cache.
GRAM_BLOCK = 1 << 15
_U = np.uint64
_WORD_SEED = 0x7E55E11A
#: Odd multipliers of the two lanes.
_LANES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))


def space_table() -> np.ndarray:
    """Separators of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def punctuation_table() -> np.ndarray:
    """Separators of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased text."""
    table = np.zeros(256, bool)
    for low, high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
        table[low : high + 1] = True
    return table


def fold_table() -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), bounds


def chunks(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes; a longer row stands alone."""
    row, rows = 0, len(bounds) - 1
    while row < rows:
        stop = int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1
        stop = min(rows, max(stop, row + 1))
        yield row, stop
        row = stop


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two lanes of 64 bits for each word: its XXH3-128."""
    raw = b"".join([xxhash.xxh3_128_digest(w, _WORD_SEED) for w in words])
    return np.ascontiguousarray(np.frombuffer(raw, np.uint64).reshape(-1, 2).T)


class Hasher:
    """Word boundaries, word numbers and word hashes of texts with the given separators, lower-cased with ``fold``."""

    def __init__(self, separators: np.ndarray, fold: bool):
        self.separators = separators
        self.fold = fold_table() if fold else None

    def bounds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and the number of the first word of each row (one more entry than rows)."""
        starts, ends, first, _ = self._bounds(data, offsets)
        return starts, ends, first

    def _bounds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        word = ~self.separators[data]
        edge = np.empty(len(data) + 1, bool)
        if len(data):
            edge[0], edge[-1] = word[0], word[-1]
            np.not_equal(word[1:], word[:-1], out=edge[1:-1])
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            split = np.unique(inner)
            both = split[word[split] & word[split - 1]]
        else:
            edge[:] = False
            both = np.zeros(0, np.int64)
        at = np.flatnonzero(edge)
        if len(both):
            at = np.sort(np.concatenate([at, both, both]))
        starts, ends = at[0::2], at[1::2]
        return starts, ends, np.searchsorted(starts, offsets), word

    def numbers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The different words, the number of each word among them, and the first word of each row."""
        if self.fold is not None:
            data = self.fold[data]
        starts, ends, first, word = self._bounds(data, offsets)
        ends_of = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=ends_of[1:])
        letters = data[word]
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends_of), pa.py_buffer(letters)])
        known = column.dictionary_encode()
        _, bounds, letters = known.dictionary.buffers()
        raw = letters.to_pybytes() if letters else b""
        at = np.frombuffer(bounds, np.int64, len(known.dictionary) + 1).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], known.indices.to_numpy(zero_copy_only=False), first

    def pieces(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of about ``CHUNK_BYTES`` of one text that end at separators."""
        at = 0
        while at < len(data):
            stop = min(len(data), at + CHUNK_BYTES)
            while stop < len(data):
                gap = np.flatnonzero(self.separators[data[stop : stop + CHUNK_BYTES]])
                if len(gap):
                    stop += int(gap[0])
                    break
                stop = min(len(data), stop + CHUNK_BYTES)
            yield at, stop
            at = stop

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two lanes of hashes of every word, and the number of the first word of each row."""
        if len(offsets) == 2 and len(data) > 2 * CHUNK_BYTES:
            lanes = np.concatenate([self._lanes(data[a:b], np.array([0, b - a]))[0] for a, b in self.pieces(data)], axis=1)
            return lanes, np.array([0, lanes.shape[1]])
        return self._lanes(data, offsets)

    def _lanes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, number, first = self.numbers(data, offsets)
        return word_hashes(known)[:, number], first


def _joined(left: np.ndarray, right: np.ndarray, level: int) -> np.ndarray:
    """The hash of two runs of words that follow one another; what is mixed in between keeps sums from cancelling."""
    out = np.empty_like(left)
    for lane, odd in enumerate(_LANES):
        out[lane] = mix(left[lane] * odd + (right[lane] ^ _U(level * 0xA24BAED4963EE407 % (1 << 64))))
    return out


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Two lanes of hashes of every run of ``n`` consecutive words, rows disregarded; runs of powers of two are hashed once and joined."""
    m = max(0, words.shape[1] - n + 1)
    out = np.empty((2, m), np.uint64)
    for at in range(0, m, GRAM_BLOCK):
        size = min(GRAM_BLOCK, m - at)
        run, length, done, covered = words[:, at : at + size + n - 1], 1, None, 0
        parts = {1: run}
        while 2 * length <= n:
            run = _joined(run[:, : run.shape[1] - length], run[:, length:], 2 * length)
            length *= 2
            parts[length] = run
        for length in sorted(parts, reverse=True):
            if n & length:
                piece = parts[length][:, covered : covered + size]
                done = piece if done is None else _joined(done, piece, n + length)
                covered += length
        out[:, at : at + size] = done if n > 1 else mix(done)
    return out


def exact_grams(hasher: Hasher, raws: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted numbers of its different runs of ``n`` words, the same number for the same words and no other.

    A text of fewer words, but not none, has one run, the whole. Numbers are given by comparing words and then pairs of numbers: nothing is hashed.
    """
    data = np.frombuffer(b"".join(raws), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
    known, number, first = hasher.numbers(data, offsets)
    count = np.diff(first)
    # a word that stands for none fills texts of fewer words up to n
    fill = len(known)
    size = np.where(count > 0, np.maximum(count, n), 0)
    start = np.concatenate([[0], np.cumsum(size)])
    padded = np.full(int(start[-1]), fill, np.int64)
    row = np.repeat(np.arange(len(raws)), count)
    padded[start[row] + np.arange(len(number)) - first[row]] = number
    grams, width, parts, length = padded, fill + 1, {1: (padded, fill + 1)}, 1

    def joined(left: np.ndarray, right: np.ndarray, right_width: int) -> tuple[np.ndarray, int]:
        unique, inverse = np.unique(left * right_width + right, return_inverse=True)
        return inverse, len(unique)

    while 2 * length <= n:
        grams, width = joined(grams[: max(0, len(grams) - length)], grams[length:], width)
        length *= 2
        parts[length] = (grams, width)
    done, covered = None, 0
    m = max(0, len(padded) - n + 1)
    for length in sorted(parts, reverse=True):
        if n & length:
            piece, width = parts[length]
            piece = piece[covered : covered + m]
            done = piece if done is None else joined(done, piece, width)[0]
            covered += length
    return [np.unique(done[start[i] : max(start[i], start[i + 1] - n + 1)]) for i in range(len(raws))]


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
