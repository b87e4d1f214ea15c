from __future__ import annotations

import importlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.operators import analytics, matrix
from tessella.plans.tree import Evaluator, Node
from tessella.sources import files


@pytest.mark.parametrize("line", ["foo|B|y|", "1|B|", "1|B|y|z|"])
def test_malformed_lines_fail(spark, tmp_path, line):
    (tmp_path / "good.tbl").write_text("1|A|x|\n2|B|y|\n")
    (tmp_path / "bad.tbl").write_text(f"1|A|x|\n{line}\n")
    kinds = "k int, a string, b string"
    assert [tuple(r) for r in files.read_tbl(spark, f"file://{tmp_path}/good.tbl", kinds).collect()] == [(1, "A", "x"), (2, "B", "y")]
    with pytest.raises(Exception):  # noqa: B017  the kind of error is Spark's
        files.read_tbl(spark, f"file://{tmp_path}/bad.tbl", kinds).collect()


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_rows_are_numbered_without_gaps(spark, reuse):
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
        assert sorted((r.k, r.at) for r in matrix.number_rows(df, ["k"], "at").collect()) == [(k, k) for k in range(1000)]
        assert sorted(r.k for r in analytics.every_nth(df, 3, "k").collect()) == list(range(0, 1000, 3))
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)


def test_dictionary_encoded_lists(spark):
    run = Evaluator(spark)
    assert run(Node("encoded", Node("List", 1, 0, 1), Node("List", "x", "y"))) == Node("List", "y", "x", "y")
    with pytest.raises(ValueError):
        run(Node("Table", Node("a", Node("List", 1)), Node("b", Node("List"))))


def test_queries_without_what_the_training_operators_need(monkeypatch):
    original = importlib.import_module

    def missing(name, *rest):
        if name == "tessella.llm.entry":
            raise ImportError("no module named ahocorasick")
        return original(name, *rest)

    monkeypatch.setattr(importlib, "import_module", missing)
    if importlib.util.find_spec("tessella.llm") is not None:
        with pytest.warns(UserWarning):
            assert "q1_tpch" in entry.queries()
    assert "pipeline" not in entry.queries()
