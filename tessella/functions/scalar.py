"""Typed operands, the four arithmetic operators, six comparisons, six reductions, and great-circle distance."""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_KM = 6371.0


@dataclass(frozen=True)
class Ref:
    """A column by name; a name that looks like a number is still a name."""

    name: str


@dataclass(frozen=True)
class Lit:
    """A literal."""

    value: object


Operand = Ref | Lit | str | int | float | bool | datetime.date


def operand(x: Operand) -> Ref | Lit:
    """Bare strings are columns, all else is a literal."""
    if isinstance(x, (Ref, Lit)):
        return x
    return Ref(x) if isinstance(x, str) else Lit(x)


def quoted(name: str) -> str:
    """A column name in which dots and backticks mean themselves."""
    return "`" + name.replace("`", "``") + "`"


def value(x: Operand) -> Column:
    x = operand(x)
    return F.col(quoted(x.name)) if isinstance(x, Ref) else F.lit(x.value)


def divide(x: Column, y: Column) -> Column:
    """Division of doubles as IEEE 754 has it: by zero it gives infinities and NaN, never an error."""
    a, b = x.cast("double"), y.cast("double")
    by_zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
    return F.when(b == 0, F.when(F.isnan(a), F.lit(math.nan)).otherwise(by_zero)).otherwise(a / F.when(b == 0, F.lit(None)).otherwise(b))


ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide}

COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}

REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "prod": F.product, "count": lambda c: F.count(F.lit(1)), "avg": F.avg, "max": F.max, "min": F.min,
}

#: What whole-column reductions give over no rows; the others give null.
OF_NOTHING = {"sum": 0, "prod": 1.0}


def reduction(name: str) -> Callable[[Column], Column]:
    if name not in REDUCTIONS:
        raise ValueError(f"unknown reduction {name!r}: expected one of {', '.join(REDUCTIONS)}")
    return REDUCTIONS[name]


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def compare(df: DataFrame, name: str, op: str, literal: object) -> Column:
    """``column op literal`` with NaN false for all but ``!=``; Spark by itself holds NaN larger than all."""
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}: expected one of {', '.join(COMPARISONS)}")
    if isinstance(literal, float) and math.isnan(literal):
        raise ValueError("comparison with NaN")
    column = F.col(quoted(name))
    bound = F.lit(literal)
    if isinstance(literal, datetime.datetime) and isinstance(df.schema[name].dataType, T.TimestampNTZType):
        bound = F.lit(literal.isoformat(sep=" ")).cast("timestamp_ntz")  # else every row is cast, and nothing is pushed to the scan
    held = COMPARISONS[op](column, bound)
    return held & ~F.isnan(column) if op in (">", ">=") and is_floating(df, name) else held


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres, as one JVM expression."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return F.lit(2000 * EARTH_KM) * F.asin(F.sqrt(h))


def haversine_atan_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The same by the two-argument arc tangent, which keeps its precision near antipodes."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return F.lit(2000 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))
