"""Generated columns for sweeps: deterministic, computed from the row number in the JVM, and the same in SQL.

Each generator takes the row number ``i`` of ``n`` rows and gives a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime that divides no number of rows in use, so that ``i -> i * STEP mod n`` visits every number once.
STEP = 7919


def numbers(spark: SparkSession, n: int) -> DataFrame:
    """(i) from 0 to n - 1."""
    return spark.range(n).withColumnRenamed("id", "i")


def permuted(n: int, i: str = "i") -> Column:
    """0 to n - 1, each once, in a scattered order."""
    return F.col(i) * STEP % n


def disordered(n: int, percent: int, i: str = "i") -> Column:
    """0 to n - 1 in order, but for ``percent`` of every hundred rows, whose values are scattered."""
    return F.when(F.col(i) * 31 % 100 < percent, permuted(n, i)).otherwise(F.col(i))


def sections(length: int, kinds: int = 2, i: str = "i") -> Column:
    """Runs of ``length`` equal values, 0 to ``kinds`` - 1 in turn."""
    return F.floor(F.col(i) / length) % kinds


def clustered(n: int, cardinality: int, run: int, i: str = "i") -> Column:
    """Keys 0 to ``cardinality`` - 1 in runs of ``run`` rows."""
    return F.floor(F.col(i) / run) % cardinality


def two_sections(n: int, few: int, many: int, i: str = "i") -> Column:
    """``few`` different keys in the first half, ``many`` in the second."""
    return F.when(F.col(i) < n // 2, F.col(i) % few).otherwise(F.col(i) % many)
