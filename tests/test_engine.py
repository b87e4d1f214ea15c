from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.operators import analytics, blocks, matrix
from tessella.plans.algebra import Field, Scan, lower
from tessella.plans.tree import Evaluator, Node
from tessella.session import table
from tessella.sources import files
from tessella.streaming.incremental import read_stream, run_available


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_plan_pushes_filters_and_prunes(spark, sf):
    plan = Scan("lineitem").join(Scan("part").project("p_partkey", "p_brand"), "l_partkey", "p_partkey").where(Field("l_quantity") < 5.0).group("p_brand", n=("count", "l_quantity"))
    text = lower(plan, lambda n: table(spark, sf, n))._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_quantity,5.0)" in text and "l_extendedprice" not in text


def test_plan_errors(spark, sf):
    get = lambda n: table(spark, sf, n)
    with pytest.raises(ValueError):
        lower(Scan("nation").join(Scan("nation"), "n_nationkey", "n_nationkey"), get)
    with pytest.raises(ValueError):
        lower(Scan("nation").join(Scan("region"), (), ()), get)
    with pytest.raises(TypeError):
        lower("nation", get)


def test_tree(spark, sf):
    run = Evaluator(spark, lambda n: table(spark, sf, n))
    run(Node("python_globals", {"factor": 3}))
    run(Node("python", lambda names, nation: {"out": nation.select((F.col("n_nationkey") * names["factor"]).alias("x"))}, ("nation", Node("table", "nation"))))
    assert rows(run(Node("get_python_var", "out")))[-1] == (72,)
    assert run(Node("reset_python_dict")) == Node("reset_python_dict")
    with pytest.raises(KeyError):
        run(Node("get_python_var", "out"))
    assert run(Node("Other", Node("Inner", 1), 2)) == Node("Other", Node("Inner", 1), 2)
    assert run(Node("encoded", 5)) == 5


def test_matrix(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (4, 8)], "col1 int, col2 int")
    for n in (1, 3):
        assert [tuple(r) for r in matrix.gram(df.repartition(n), ["col1", "col2"]).orderBy("i", "j").collect()] == [(0, 0, 30.0), (0, 1, 70.0), (1, 0, 70.0), (1, 1, 174.0)]
    assert rows(matrix.weighted(df, ["col1", "col2"], [2.0, 1.0])) == [(7.0,), (10.0,), (13.0,), (16.0,)]
    assert rows(matrix.from_matrix(matrix.to_matrix(df, ["col1", "col2"]), ["col1", "col2"])) == [(1.0, 5.0), (2.0, 6.0), (3.0, 7.0), (4.0, 8.0)]
    assert rows(matrix.spans(df, 3, ["col1"]).select("col1", "span")) == [(1, 0), (2, 0), (3, 0), (4, 1)]
    with pytest.raises(ValueError):
        matrix.weighted(df, ["col1"], [1.0, 2.0])


def test_regression_matches_steps(spark):
    data = [(i / 20, 0.3 + 0.5 * i / 20) for i in range(20)]
    fit = analytics.fit_linear(spark.createDataFrame(data, "x double, y double"), "x", "y")
    p = q = 1.0
    for _ in range(51):
        e = [p + q * x - y for x, y in data]
        stale = sum(v * v for v in e) / 40
        p, q = p - 0.1 * sum(e) / 20, q - 0.1 * sum(v * x for v, (x, _) in zip(e, data, strict=True)) / 20
    assert fit.intercept == pytest.approx(p) and fit.slope == pytest.approx(q)
    assert fit.stale_train_error == pytest.approx(stale)
    assert fit.train_error == pytest.approx(sum((p + q * x - y) ** 2 for x, y in data) / 40)
    assert analytics.fit_linear(spark.createDataFrame([], "x double, y double"), "x", "y").slope == 1.0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 2.5), (2, "c|d", None)], "k int, s string, v double")
    files.write_csv(df, str(tmp_path / "a"))
    assert rows(files.read_csv(spark, str(tmp_path / "a"), df.schema).fillna(0)) == rows(df.fillna(0))
    files.write_tbl(df.where("k = 1"), str(tmp_path / "b"))
    assert "".join(p.read_text() for p in (tmp_path / "b").glob("part*.csv")) == "1|a,b|2.5|\n"
    assert rows(files.read_tbl(spark, str(tmp_path / "b"), df.schema)) == [(1, "a,b", 2.5)]
    files.write_columns(df, str(tmp_path / "c"), ["k"])
    assert rows(spark.read.parquet(str(tmp_path / "c/s"))) == [(1, "a,b"), (2, "c|d")]
    (tmp_path / "region.tbl").write_text("0|AFRICA|x|\n1|ASIA|y|\n")
    store = files.Storage(spark)
    store.create("region")
    assert rows(store.load("region", str(tmp_path / "region.tbl"))) == [(0, "AFRICA", "x"), (1, "ASIA", "y")]
    store.constrain("region", ("r_regionkey",))
    assert store.violations("region").count() == 0
    assert store.drop("region") and not spark.catalog.tableExists("region")
    store.create("t", key="BIGINT", payload="DOUBLE")
    assert store.fetch("t").dtypes == [("key", "bigint"), ("payload", "double")]
    assert rows(store.load_rows("t", {"key": [1, 2], "payload": [0.5, 1.5]})) == [(1, 0.5), (2, 1.5)]
    store.drop("t")
    with pytest.raises(ValueError):
        store.load("t", "x.csv")
    with pytest.raises(ValueError):
        store.set("nonsense", 1)
    with pytest.raises(ValueError):
        files.schema({"a": "money"})


def test_blocks(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 6.0)], "k int, v double")
    assert rows(blocks.map_frames(df, lambda f: f.assign(v=f.v + 1), "k int, v double")) == [(1, 3.0), (1, 5.0), (2, 7.0)]
    assert rows(blocks.map_groups(df, ["k"], lambda f: f.head(1).assign(v=f.v.sum()), "k int, v double")) == [(1, 6.0), (2, 6.0)]
    assert rows(blocks.map_batches(df, lambda b: b, "k int, v double")) == rows(df)


def test_refresh_and_lists(spark):
    df = spark.createDataFrame([(i,) for i in range(9)], "k int")
    assert [r.k for r in analytics.every_nth(df, 3, "k").collect()] == [0, 3, 6]
    some = df.where("k < 4")
    assert rows(analytics.apply_refresh(df, some, some, ("k",))) == rows(df)
    assert analytics.within(df, some, "k").count() == 4 and analytics.without(df, some, "k").count() == 5


def test_stream_gives_what_a_batch_gives(spark, sf, tmp_path):
    from tessella.operators.relational import aggregate, select

    source = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    source.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), source.schema, 1)
    query = lambda df: aggregate(select(df, ["l_quantity"], ["<"], [24.0]), ["l_returnflag"], ["count", "max"], ["l_quantity"] * 2, ["n", "hi"])
    run_available(stream, query, str(tmp_path / "out"), str(tmp_path / "cp"), "complete")
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(query(source))
    run_available(stream, lambda df: select(df, ["l_quantity"], [">"], [40.0]), str(tmp_path / "rows"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == source.where("l_quantity > 40").count()
