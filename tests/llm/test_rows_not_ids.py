"""Mixing takes rows and not ids, and every stage takes columns of any name."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import mixing

TEN = " ".join(f"w{k}" for k in range(10))


@pytest.mark.parametrize("same", [1000, 300, 7])
def test_rows_of_one_id_are_taken_one_by_one(spark, same):
    ident = F.when(F.col("id") < same, 7).otherwise(F.col("id")).cast("long")
    docs = spark.range(1000).select(ident.alias("doc_id"), F.lit("a").alias("source"), F.lit(TEN).alias("text")).repartition(3)
    got = mixing.mix(docs).agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.min("taken").alias("least"), F.max("taken").alias("most")).first()
    assert got.target == 15000.0 and got.taken == 15000 and (got.least, got.most) == (10, 20)
    assert mixing.apply_mix(docs).count() == 1500


def test_rows_of_one_id_and_many_sizes(spark):
    """An id that holds a third of the rows, of different lengths: the order is one of rows, and the target is met within one."""
    size = (F.col("id") % 37 + 1).cast("int")
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "b").alias("source"), F.concat_ws(" ", F.array_repeat(F.lit("w"), size)).alias("text"))
    rows = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert len(rows) == 2 and all(abs(r.taken - r.target) <= 37 and r.most <= 2 for r in rows)


def test_smallest_ratios_of_odds_are_taken(spark):
    """Within a source, what is taken once more are the first rows in the order of odds(u) / odds(p)."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(TEN).alias("text"))
    u = mixing.draw(F.col("doc_id"), F.lit(10).cast("long"))
    got = mixing.mix(docs).withColumn("q", mixing.pareto(u, F.lit(0.5 / (1 - 0.5)))).collect()
    assert [r.taken for r in sorted(got, key=lambda r: r.q)] == [20] * 200 + [10] * 200


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_columns_of_any_name(spark, sf, name):
    passage = "\n".join(" ".join(f"p{k}q{j}" for j in range(8)) for k in range(4))
    docs = spark.createDataFrame([(1, passage, "a", 3, 1, 2, 3), (2, passage, "a", 3, 1, 2, 3), (3, None, None, 0, 1, 2, 3)], ["doc_id", "text", "source", "n_chars", "a.b", "__gone", "t_0_"])
    docs = docs.withColumn("lang", F.lit("en")).withColumn("back`tick", F.lit(1)).withColumn("component_id", F.lit(0)).withColumn("__removed", F.lit("x"))
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    assert got.columns == docs.columns and got.count() <= 6
