"""The relational operators: project, select, equi_join, aggregate. Each takes and gives DataFrames and runs nothing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalar import ARITHMETIC, OF_NOTHING, Operand, Ref, compare, is_floating, operand, quoted, reduction, value


def _same_length(**lists: Sequence) -> None:
    if len({len(x) for x in lists.values()}) > 1:
        raise ValueError("lists differ in length: " + ", ".join(f"{k} has {len(v)}" for k, v in lists.items()))


def project(
    df: DataFrame,
    unary_ops: Sequence[str] = (), unary_in: Sequence[str] = (), unary_out: Sequence[str] = (),
    lhs: Sequence[Operand] = (), binary_ops: Sequence[str] = (), rhs: Sequence[Operand] = (), binary_out: Sequence[str] = (),
    names: Sequence[str] = (), renames: Sequence[str] | None = None,
) -> DataFrame:
    """Whole-column reductions, then row-wise arithmetic in order, then a choice of columns under new names.

    Later operations see earlier outputs, which may replace columns. If all chosen columns come from
    reductions and literals alone, the result is one row; otherwise reductions are repeated for every row.
    """
    renames = list(names) if renames is None else list(renames)
    _same_length(unary_ops=unary_ops, unary_in=unary_in, unary_out=unary_out)
    _same_length(lhs=lhs, binary_ops=binary_ops, rhs=rhs, binary_out=binary_out)
    _same_length(names=names, renames=renames)
    for op in binary_ops:
        if op not in ARITHMETIC:
            raise ValueError(f"unknown arithmetic {op!r}: expected one of {', '.join(ARITHMETIC)}")

    final = dict(zip(renames, names, strict=True))  # of equal new names, the last holds
    if not unary_ops:
        return _row_wise(df, lhs, binary_ops, rhs, binary_out).select(*(F.col(quoted(n)).alias(r) for r, n in final.items()))

    aggregates, known = {}, {}
    for op, source, out in zip(unary_ops, unary_in, unary_out, strict=True):
        if source in known:  # a reduction of an earlier one: that is a column of one value
            reduction(op)
            aggregates[out] = F.count(F.lit(1)) * 0 + 1 if op == "count" else aggregates[source].cast("double") if op in ("avg", "prod") else aggregates[source]
        else:
            column = reduction(op)(F.col(quoted(source)))
            aggregates[out] = F.coalesce(column, F.lit(OF_NOTHING[op])) if op in OF_NOTHING else column
        known[out] = True
    scalars = set(known)
    for left, right, out in zip(lhs, rhs, binary_out, strict=True):
        is_scalar = all(not isinstance(x, Ref) or x.name in scalars for x in map(operand, (left, right)))
        scalars = scalars | {out} if is_scalar else scalars - {out}
    one = df.agg(*(c.alias(n) for n, c in aggregates.items()))
    if all(n in scalars for n in final.values()):
        steps = [s for s in zip(lhs, binary_ops, rhs, binary_out, strict=True) if all(not isinstance(x, Ref) or x.name in scalars for x in map(operand, (s[0], s[2])))]
        table = _row_wise(one, *(list(x) for x in zip(*steps, strict=True))) if steps else one
    else:  # one row, so its broadcast is bounded
        table = _row_wise(df.drop(*aggregates).crossJoin(F.broadcast(one)), lhs, binary_ops, rhs, binary_out)
    return table.select(*(F.col(quoted(n)).alias(r) for r, n in final.items()))


def _row_wise(df: DataFrame, lhs: Sequence[Operand], ops: Sequence[str], rhs: Sequence[Operand], out: Sequence[str]) -> DataFrame:
    for left, op, right, name in zip(lhs, ops, rhs, out, strict=True):
        df = df.withColumn(name, ARITHMETIC[op](value(left), value(right)))
    return df


def select(df: DataFrame, columns: Sequence[str] = (), ops: Sequence[str] = (), values: Sequence[object] = ()) -> DataFrame:
    """Rows for which all of ``column op value`` hold; without conditions, all rows."""
    _same_length(columns=columns, ops=ops, values=values)
    if not columns:
        return df
    return df.filter(reduce(lambda a, b: a & b, (compare(df, c, o, v) for c, o, v in zip(columns, ops, values, strict=True))))


def equi_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> DataFrame:
    """Inner join on all key pairs. Columns of the left, then those of the right that are new; where names clash, the right's values in the left's place. NaN meets nothing."""
    _same_length(left_keys=left_keys, right_keys=right_keys)
    if not left_keys:
        raise ValueError("a join needs a key")
    for df, keys in ((left, left_keys), (right, right_keys)):
        if missing := [k for k in keys if k not in df.columns]:
            raise ValueError(f"no such key: {', '.join(missing)}")
    a, b = left.alias("__a"), right.alias("__b")
    col = lambda side, name: F.col(f"{side}.{quoted(name)}")
    conditions = []
    for x, y in zip(left_keys, right_keys, strict=True):
        conditions.append(col("__a", x) == col("__b", y))
        if is_floating(left, x) and is_floating(right, y):
            conditions.append(~F.isnan(col("__a", x)))
    joined = a.join(b, reduce(lambda p, q: p & q, conditions), "inner")
    mine, new = set(right.columns), [c for c in right.columns if c not in left.columns]
    return joined.select(*(col("__b" if c in mine else "__a", c).alias(c) for c in left.columns), *(col("__b", c).alias(c) for c in new))


def aggregate(df: DataFrame, keys: Sequence[str], funcs: Sequence[str], columns: Sequence[str], out: Sequence[str]) -> DataFrame:
    """Reductions for each combination of keys; without keys, one row. Keys come first."""
    _same_length(funcs=funcs, columns=columns, out=out)
    if clash := set(keys) & set(out):
        raise ValueError(f"outputs named like keys: {', '.join(sorted(clash))}")
    reduced = [reduction(f)(F.col(quoted(c))).alias(o) for f, c, o in zip(funcs, columns, out, strict=True)]
    return df.groupBy(*(F.col(quoted(k)) for k in keys)).agg(*reduced) if reduced else df.select(*(F.col(quoted(k)) for k in keys)).distinct()
