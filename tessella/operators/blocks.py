"""Blocks of Python over tables: whole frames on the driver's side of the plan, or batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


class Variables:
    """Variables of a session: a block takes tables by name and leaves tables by name; they are lazy frames, not data."""

    def __init__(self) -> None:
        self.globals: dict[str, Any] = {}
        self.local: dict[str, Any] = {}

    def run(self, block: Callable[..., dict[str, Any] | None], tables: dict[str, DataFrame] | None = None) -> None:
        """Calls ``block(variables, **tables)``; what it returns is kept by name. Its errors are the caller's."""
        self.local.update(tables or {})
        self.local.update(block({**self.globals, **self.local}, **(tables or {})) or {})

    def get(self, name: str) -> Any:
        if name not in self.local:
            raise KeyError(f"no variable {name!r}; there are {', '.join(sorted(self.local)) or 'none'}")
        return self.local[name]

    def reset(self) -> None:
        self.local.clear()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over Arrow batches of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


def map_frames(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` over pandas batches of each partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(run, schema)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` over each group as one pandas frame; groups must fit in a task."""
    return df.groupBy(*keys).applyInPandas(fn, schema)
