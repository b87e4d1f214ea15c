"""Packed columns of numbers for bulk shuffles: many entries in one row, byte planes that compress well."""

from __future__ import annotations

import numpy as np

#: 1 MiB of bits that flag ids; of fixed size however many ids there are, a false flag costs work and no more.
FLAG_BITS = 1 << 23


def pack(values: np.ndarray, width: int = 8) -> bytes:
    """The low ``width`` bytes of integers, one plane of bytes after another."""
    raw = np.ascontiguousarray(values).astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


def unpack(data: bytes, width: int = 8) -> np.ndarray:
    """The integers of ``pack`` as uint64."""
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


def unpack_all(rows: list[bytes], width: int = 8) -> np.ndarray:
    return np.concatenate([unpack(x, width) for x in rows]) if rows else np.zeros(0, np.uint64)


def bucket_bits(entries: float, per_bucket: float = 1.5e6) -> int:
    """So many bits of a hash deal ``entries`` into buckets of about ``per_bucket``."""
    return int(min(20, max(6, np.ceil(np.log2(max(1.0, entries / per_bucket))))))


def split_sorted(keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def flag_slots(ids: np.ndarray) -> np.ndarray:
    """The bit of each id."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(FLAG_BITS)).astype(np.int64)


def flags(parts: list[bytes]) -> np.ndarray:
    """All bits set in any of the parts, unpacked to booleans."""
    out = np.zeros(FLAG_BITS // 8, np.uint8)
    for p in parts:
        out |= np.frombuffer(p, np.uint8)
    return np.unpackbits(out).astype(bool)
