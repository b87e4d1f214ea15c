"""The richer dialect as immutable plans, lowered to DataFrames: nested expressions, ordering, top-k, global groups."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.scalar import divide, is_floating, quoted

# expressions


class Expr:
    """Operators build larger expressions; ``&`` joins predicates."""

    def __add__(self, o):
        return Call("plus", (self, wrap(o)))

    def __radd__(self, o):
        return Call("plus", (wrap(o), self))

    def __sub__(self, o):
        return Call("minus", (self, wrap(o)))

    def __rsub__(self, o):
        return Call("minus", (wrap(o), self))

    def __mul__(self, o):
        return Call("times", (self, wrap(o)))

    def __rmul__(self, o):
        return Call("times", (wrap(o), self))

    def __truediv__(self, o):
        return Call("divide", (self, wrap(o)))

    def __gt__(self, o):
        return Call("greater", (self, wrap(o)))

    def __lt__(self, o):
        return Call("greater", (wrap(o), self))

    def __and__(self, o):
        return Call("and", (self, wrap(o)))

    def equals(self, o):
        return Call("equal", (self, wrap(o)))

    def contains(self, text: str):
        return Call("contains", (self, Value(text)))

    def year(self):
        return Call("year", (self,))

    def named(self, name: str) -> Named:
        return Named(name, self)


@dataclass(frozen=True, eq=False)
class Field(Expr):
    name: str


@dataclass(frozen=True, eq=False)
class Value(Expr):
    value: object


@dataclass(frozen=True, eq=False)
class Call(Expr):
    op: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Named:
    name: str
    expr: Expr


def wrap(x) -> Expr:
    """Strings name columns, all else is a literal."""
    return x if isinstance(x, Expr) else Field(x) if isinstance(x, str) else Value(x)


def date(text: str) -> Value:
    return Value(datetime.date.fromisoformat(text))


CALLS: dict[str, Callable[..., Column]] = {
    "plus": lambda *x: reduce(lambda a, b: a + b, x), "minus": lambda a, b: a - b, "times": lambda *x: reduce(lambda a, b: a * b, x), "divide": divide,
    "greater": lambda a, b: a > b, "equal": lambda a, b: a == b, "and": lambda *x: reduce(lambda a, b: a & b, x), "contains": lambda a, b: a.contains(b), "year": F.year,
}

AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "count": lambda c: F.count(F.lit(1)), "min": F.min, "max": F.max, "avg": F.avg}


def column(e: Expr, df: DataFrame | None = None) -> Column:
    """With the frame it is of, comparisons are false for NaN, as those of the plain operators are."""
    if isinstance(e, Field):
        return F.col(quoted(e.name))
    if isinstance(e, Value):
        return F.lit(e.value)
    held = CALLS[e.op](*(column(x, df) for x in e.args))
    if df is not None and e.op in ("greater", "equal") and not isinstance(e.args[0], Value):
        left = column(e.args[0], df)
        if isinstance(df.select(left).schema[0].dataType, (T.FloatType, T.DoubleType)):
            held = held & ~F.isnan(left)  # Spark by itself holds NaN larger than all and equal to itself
    return held


# plans


class Plan:
    def project(self, *out: Named | str) -> Project:
        return Project(self, tuple(x if isinstance(x, Named) else Named(x, Field(x)) for x in out))

    def where(self, predicate: Expr) -> Select:
        return Select(self, predicate)

    def join(self, other: Plan, left: str | tuple[str, ...], right: str | tuple[str, ...]) -> Join:
        pair = lambda x: (x,) if isinstance(x, str) else tuple(x)
        return Join(self, other, pair(left), pair(right))

    def group(self, *by: str, **out: tuple[str, str | Expr]) -> Group:
        return Group(self, by, tuple((name, func, wrap(e)) for name, (func, e) in out.items()))

    def order(self, *by: str | tuple[str, str]) -> Order:
        return Order(self, by)

    def top(self, n: int, *by: str | tuple[str, str]) -> Top:
        return Top(self, by, n)


@dataclass(frozen=True)
class Scan(Plan):
    table: str


@dataclass(frozen=True, eq=False)
class Frame(Plan):
    """A DataFrame as it is."""

    df: DataFrame


@dataclass(frozen=True)
class Project(Plan):
    child: Plan
    out: tuple[Named, ...]


@dataclass(frozen=True)
class Select(Plan):
    child: Plan
    predicate: Expr


@dataclass(frozen=True)
class Join(Plan):
    left: Plan
    right: Plan
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]


@dataclass(frozen=True)
class Group(Plan):
    child: Plan
    by: tuple[str, ...]
    out: tuple[tuple[str, str, Expr], ...]


@dataclass(frozen=True)
class Order(Plan):
    child: Plan
    by: tuple[str | tuple[str, str], ...]


@dataclass(frozen=True)
class Top(Plan):
    child: Plan
    by: tuple[str | tuple[str, str], ...]
    n: int = field(default=10)


def _sort(by: tuple[str | tuple[str, str], ...]) -> list[Column]:
    return [F.col(quoted(k)) if isinstance(k, str) else F.col(quoted(k[0])).desc() if k[1] == "desc" else F.col(quoted(k[0])) for k in by]


def lower(plan: Plan, tables: Mapping[str, DataFrame] | Callable[[str], DataFrame]) -> DataFrame:
    """The DataFrame of a plan. Nothing is rewritten here: pushing down, pruning and join strategies are Catalyst's."""
    get = tables if callable(tables) else tables.__getitem__
    go = lambda p: lower(p, get)
    match plan:
        case Scan(name):
            return get(name)
        case Frame(df):
            return df
        case Project(child, out):
            return go(child).select(*(column(x.expr).alias(x.name) for x in out))
        case Select(child, predicate):
            df = go(child)
            return df.filter(column(predicate, df))
        case Join(left, right, a, b):
            if not a or len(a) != len(b):
                raise ValueError("a join needs as many keys on both sides, one at least")
            x, y = go(left), go(right)
            if clash := set(x.columns) & set(y.columns):
                raise ValueError(f"both sides have {', '.join(sorted(clash))}")
            on = [F.col(quoted(k)) == F.col(quoted(m)) for k, m in zip(a, b, strict=True)]
            on += [~F.isnan(F.col(quoted(k))) for k, m in zip(a, b, strict=True) if is_floating(x, k) and is_floating(y, m)]
            return x.join(y, reduce(lambda p, q: p & q, on))
        case Group(child, by, out):
            return go(child).groupBy(*(F.col(quoted(k)) for k in by)).agg(*(AGGREGATES[f](column(e)).alias(n) for n, f, e in out))
        case Order(child, by):
            return go(child).orderBy(*_sort(by))
        case Top(child, by, n):
            return go(child).orderBy(*_sort(by)).limit(n)
    raise TypeError(f"not a plan: {plan!r}")
