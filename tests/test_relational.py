from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions.scalar import Lit, Ref
from tessella.operators.relational import aggregate, equi_join, project, select

NAN = float("nan")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def t(spark):
    make = spark.createDataFrame
    return {
        1: make([(1, 0.8, 0), (2, 3.14, 0), (3, 2.42, 1)], "col1 int, col2 double, col3 int"),
        2: make([(10, 3, 6), (5, 3, 7), (1, 4, 8)], "col1 int, col2 int, col3 int"),
        3: make([(10, 5, 9), (5, 3, 2), (2, 4, 1)], "col1 int, col2 int, col4 int"),
        4: make([(0, 0, 1), (1, 0, 2), (0, 1, 3), (1, 1, 4)] * 2, "col1 int, col2 int, col3 int"),
    }


def test_select(t):
    assert rows(select(t[1], ["col3", "col1"], ["==", "<"], [0, 1.5])) == [(1, 0.8, 0)]
    assert select(t[1]).count() == 3


def test_select_nan(spark):
    df = spark.createDataFrame([(1, NAN), (2, 5.0), (3, 1.0)], "k int, v double")
    assert rows(select(df, ["v"], [">"], [2.0]).select("k")) == [(2,)]
    assert rows(select(df, ["v"], [">="], [1.0]).select("k")) == [(2,), (3,)]
    assert rows(select(df, ["v"], ["!="], [5.0]).select("k")) == [(1,), (3,)]
    with pytest.raises(ValueError):
        select(df, ["v"], ["=="], [NAN])
    with pytest.raises(ValueError):
        select(df, ["v"], ["~"], [1.0])


def test_join(t):
    got = equi_join(t[2], t[3], ["col1", "col2"], ["col1", "col2"])
    assert got.columns == ["col1", "col2", "col3", "col4"] and rows(got) == [(5, 3, 7, 2)]
    assert rows(equi_join(t[2].where("col1 > 99"), t[3], ["col1"], ["col1"])) == []
    with pytest.raises(ValueError):
        equi_join(t[2], t[3], [], [])
    with pytest.raises(ValueError):
        equi_join(t[2], t[3], ["col1"], ["col1", "col2"])
    with pytest.raises(ValueError):
        equi_join(t[2], t[3], ["nowhere"], ["col1"])


def test_join_clash_takes_the_right(spark):
    a = spark.createDataFrame([(1, "l", 7)], "k int, v string, w int")
    b = spark.createDataFrame([("r", 1, 9)], "v string, k int, z int")
    got = equi_join(a, b, ["k"], ["k"])
    assert got.columns == ["k", "v", "w", "z"] and rows(got) == [(1, "r", 7, 9)]


def test_join_nan_keys_meet_nothing_and_duplicates_multiply(spark):
    a = spark.createDataFrame([(NAN, 1), (2.0, 2), (2.0, 3)], "k double, x int")
    b = spark.createDataFrame([(NAN, 1), (2.0, 8), (2.0, 9)], "m double, y int")
    assert rows(equi_join(a, b, ["k"], ["m"])) == [(2.0, 2, 2.0, 8), (2.0, 2, 2.0, 9), (2.0, 3, 2.0, 8), (2.0, 3, 2.0, 9)]


def test_aggregate(t):
    got = aggregate(t[4], ["col1", "col2"], ["sum", "count"], ["col3", "col3"], ["s", "n"])
    assert rows(got) == [(0, 0, 2, 2), (0, 1, 6, 2), (1, 0, 4, 2), (1, 1, 8, 2)]
    assert rows(aggregate(t[4].where("col1 > 9"), ["col1"], ["sum"], ["col3"], ["s"])) == []
    assert rows(aggregate(t[4], [], ["max", "min", "avg", "prod"], ["col3"] * 4, list("abcd"))) == [(4, 1, 2.5, 576.0)]
    with pytest.raises(ValueError):
        aggregate(t[4], ["col1"], ["sum"], ["col3"], ["col1"])


def test_project_reduction_beside_rows(t):
    got = project(t[1], ["prod"], ["col1"], ["p"], ["col2"], ["+"], ["col3"], ["s"], ["p", "s"], ["col1_prod", "col2_plus_col3"])
    assert [(p, round(s, 9)) for p, s in rows(got)] == [(6.0, 0.8), (6.0, 3.14), (6.0, 3.42)]


def test_project_scalar_shadow_and_names(spark, t):
    assert rows(project(t[1], ["sum"], ["col2"], ["s"], ["s"], ["/"], [7.0], ["d"], ["d"]).select(F.round("d", 9))) == [(round(6.36 / 7, 9),)]
    got = project(t[1], lhs=["col1", "col1"], binary_ops=["+", "*"], rhs=[1, 10], binary_out=["col1", "w"], names=["col1", "w"])
    assert rows(got) == [(2, 20), (3, 30), (4, 40)]
    odd = spark.createDataFrame([(3.0, 4.0)], "nan double, `1_0` double")
    assert rows(project(odd, lhs=["nan", Lit(2)], binary_ops=["*", "-"], rhs=["1_0", Ref("nan")], binary_out=["a", "b"], names=["a", "b"])) == [(12.0, -1.0)]
    assert project(t[1], names=["col1", "col2"], renames=["x", "x"]).columns == ["x"]
    nothing = t[1].where("col1 > 9")
    assert rows(project(nothing, ["sum", "prod", "count", "max"], ["col1"] * 4, list("abcd"), names=list("abcd"))) == [(0, 1.0, 0, None)]


def test_division_is_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (NAN, 0.0)], "a double, b double")
    got = [r.q for r in project(df, lhs=["a"], binary_ops=["/"], rhs=["b"], binary_out=["q"], names=["q"]).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 1.5 and math.isnan(got[4])


def test_against_loops(spark):
    rng = random.Random(3)
    a = [(rng.randrange(6), rng.randrange(4), rng.randrange(50)) for _ in range(60)]
    b = [(rng.randrange(6), rng.randrange(4), rng.randrange(50)) for _ in range(60)]
    x, y = spark.createDataFrame(a, "k int, g int, v int"), spark.createDataFrame(b, "k2 int, g2 int, w int")
    assert rows(equi_join(x, y, ["k", "g"], ["k2", "g2"])) == sorted(p + q for p in a for q in b if p[:2] == q[:2])
    sums = {}
    for k, g, v in a:
        if v >= 10:
            sums.setdefault((k, g), []).append(v)
    got = aggregate(select(x, ["v"], [">="], [10]), ["k", "g"], ["sum", "min", "count"], ["v"] * 3, ["s", "lo", "n"])
    assert rows(got) == sorted((*key, sum(v), min(v), len(v)) for key, v in sums.items())
