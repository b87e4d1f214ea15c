"""Bitmaps of ids, gathered from a frame and broadcast: a bound on what a filter before a shuffle costs, whatever the size of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.blobs import FLAG_BITS, flag_slots
from tessella.llm.common import map_arrow


def flag_parts(ids: DataFrame, context) -> object:
    """A broadcast of FLAG_BITS flags for the ids of a one-column frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FLAG_BITS, bool)
        for batch in batches:
            seen[flag_slots(batch.column(0).to_numpy(zero_copy_only=False))] = True
        at = np.flatnonzero(np.packbits(seen).reshape(-1, 4096).any(axis=1))
        packed = np.packbits(seen).reshape(-1, 4096)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([packed[k].tobytes() for k in at], pa.binary())], ["block", "bits"])

    pieces = map_arrow(ids, run, "block int, bits binary").groupBy("block").applyInArrow(_join_bits, "block int, bits binary").collect()
    out = np.zeros((FLAG_BITS // 8 // 4096, 4096), np.uint8)
    for p in pieces:
        out[p.block] = np.frombuffer(p.bits, np.uint8)
    return context.broadcast(out.tobytes())


def _join_bits(table: pa.Table) -> pa.Table:
    out = np.zeros(4096, np.uint8)
    for b in table["bits"].to_pylist():
        out |= np.frombuffer(b, np.uint8)
    return pa.table([pa.array([table["block"][0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["block", "bits"])
