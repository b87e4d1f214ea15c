"""Matrices: a row of the table as an array of doubles, products by aggregation, and the way back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalar import quoted
from tessella.operators.relational import aggregate


def to_matrix(df: DataFrame, columns: Sequence[str], out: str = "row", keep: Sequence[str] = ()) -> DataFrame:
    """The columns of each row stacked into one array of doubles."""
    return df.select(*keep, F.array(*(F.col(quoted(c)).cast("double") for c in columns)).alias(out))


def from_matrix(df: DataFrame, columns: Sequence[str], source: str = "row", keep: Sequence[str] = ()) -> DataFrame:
    """The entries of each array as columns."""
    return df.select(*keep, *(F.get(F.col(source), i).alias(c) for i, c in enumerate(columns)))


def weighted(df: DataFrame, columns: Sequence[str], weights: Sequence[float], out: str = "product", keep: Sequence[str] = ()) -> DataFrame:
    """The product of a vector of weights with the matrix whose rows are the columns: one value for each row of the table."""
    if len(columns) != len(weights):
        raise ValueError("as many weights as columns are needed")
    total = F.lit(0.0)
    for c, w in zip(columns, weights, strict=True):
        total = total + F.col(quoted(c)).cast("double") * F.lit(float(w))
    return df.select(*keep, total.alias(out))


def gram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, value): inner products of all pairs of columns, in one pass with partial sums; the symmetric half is not computed twice."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    x = [F.col(quoted(c)).cast("double") for c in columns]
    one = df.agg(*(F.coalesce(F.sum(x[i] * x[j]), F.lit(0.0)).alias(f"g_{i}_{j}") for i, j in pairs))
    entries = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"g_{min(a, b)}_{max(a, b)}").alias("value")) for a in range(len(columns)) for b in range(len(columns))]
    return one.select(F.inline(F.array(*entries)))


def aggregate_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[int], values: Sequence[int], func: str = "sum") -> DataFrame:
    """Grouped reduction with keys and values given by their positions in ``columns``."""
    k, v = [columns[i] for i in keys], [columns[i] for i in values]
    return aggregate(df, k, [func] * len(v), v, [f"{func}_{c}" for c in v])


def number_rows(df: DataFrame, order_by: Sequence[str], out: str = "__at") -> DataFrame:
    """Rows numbered from 0 by a total order, found from partition sizes and not by one task.

    The ordered rows are held once (in memory, then on disk), as they are read twice: to count partitions and to number rows; dealt anew, they
    could be cut elsewhere. The number of partitions is fixed, so that they are not joined either.
    """
    columns = [F.col(quoted(c)) for c in order_by]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    numbered = ordered.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).persist()
    # as many rows as partitions
    sizes = numbered.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    from pyspark.sql import Window

    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    return numbered.join(F.broadcast(before), "__p").withColumn(out, F.col("__before") + F.col("__i")).drop("__p", "__i", "__before")


def spans(df: DataFrame, size: int, order_by: Sequence[str], out: str = "span") -> DataFrame:
    """The number of the run of ``size`` rows that each row falls in, by a total order."""
    return number_rows(df, order_by, out).withColumn(out, F.floor(F.col(quoted(out)) / size))
