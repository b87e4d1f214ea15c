"""The five macro queries in the operator form, with constants that suit the fixture."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tessella.operators.relational import aggregate, equi_join, project, select
from tessella.session import table

QUERIES: dict = {}
Y96, Y97, D98 = datetime.datetime(1996, 1, 1), datetime.datetime(1997, 1, 1), datetime.datetime(1998, 3, 15)


def _round(df, **digits):
    return df.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


def q1_tpch(spark, d):
    shipped = select(table(spark, d, "lineitem"), ["l_shipdate"], ["<="], [datetime.datetime(1998, 9, 1)])
    priced = project(
        shipped, lhs=[1.0, 1.0, "l_extendedprice", "disc_price"], binary_ops=["-", "+", "*", "*"], rhs=["l_discount", "l_tax", "x", "y"], binary_out=["x", "y", "disc_price", "charge"],
        names=["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "disc_price", "charge"],
    )
    grouped = aggregate(
        priced, ["l_returnflag", "l_linestatus"], ["sum", "sum", "sum", "sum", "avg", "avg", "avg", "count"],
        ["l_quantity", "l_extendedprice", "disc_price", "charge", "l_quantity", "l_extendedprice", "l_discount", "l_quantity"],
        ["sum_qty", "sum_base_price", "sum_disc_price", "sum_charge", "avg_qty", "avg_price", "avg_disc", "count_order"],
    )
    return _round(grouped, sum_qty=2, sum_base_price=2, sum_disc_price=1, sum_charge=1, avg_qty=6, avg_price=4, avg_disc=8)


QUERIES["q1_tpch"] = (q1_tpch, """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 1) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 1) AS sum_charge,
  round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 8) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= '1998-09-01' GROUP BY l_returnflag, l_linestatus""")  # fmt: skip


def q3_tpch(spark, d):
    joined = equi_join(equi_join(table(spark, d, "customer"), table(spark, d, "orders"), ["c_custkey"], ["o_custkey"]), table(spark, d, "lineitem"), ["o_orderkey"], ["l_orderkey"])
    kept = select(joined, ["c_mktsegment", "o_orderdate", "l_shipdate"], ["==", "<", ">"], ["BUILDING", D98, D98])
    priced = project(kept, lhs=[1.0, "l_extendedprice"], binary_ops=["-", "*"], rhs=["l_discount", "x"], binary_out=["x", "r"], names=["l_orderkey", "o_orderkey", "r"])
    return _round(aggregate(priced, ["l_orderkey", "o_orderkey"], ["sum"], ["r"], ["revenue"]), revenue=4)


QUERIES["q3_tpch"] = (q3_tpch, """
SELECT l_orderkey, o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < '1998-03-15' AND l_shipdate > '1998-03-15' GROUP BY l_orderkey, o_orderkey""")  # fmt: skip


def q6_tpch(spark, d):
    kept = select(table(spark, d, "lineitem"), ["l_shipdate", "l_shipdate", "l_discount", "l_discount", "l_quantity"], [">=", "<", ">", "<", "<"], [Y96, Y97, 0.05, 0.07, 24.0])
    priced = project(kept, lhs=["l_extendedprice"], binary_ops=["*"], rhs=["l_discount"], binary_out=["r"], names=["r"])
    return _round(project(priced, ["sum"], ["r"], ["revenue"], names=["revenue"]), revenue=2)


QUERIES["q6_tpch"] = (q6_tpch, """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' AND l_discount > 0.05 AND l_discount < 0.07 AND l_quantity < 24""")  # fmt: skip

PARTSUPP = """partsupp AS (
  SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, 0.5 * p_retailprice AS ps_supplycost, p_size * 10 AS ps_availqty
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def partsupp(spark, d):
    """The fixture has no such table: the pairs that occur in lineitem, with a cost and a stock from the part."""
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return pairs.join(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"), (F.lit(0.5) * F.col("p_retailprice")).alias("ps_supplycost"), (F.col("p_size") * 10).alias("ps_availqty"),
    )


def q9_tpch(spark, d):
    suppliers = equi_join(table(spark, d, "nation"), table(spark, d, "supplier"), ["n_nationkey"], ["s_nationkey"])
    supplied = equi_join(equi_join(table(spark, d, "part"), partsupp(spark, d), ["p_partkey"], ["ps_partkey"]), suppliers, ["ps_suppkey"], ["s_suppkey"])
    sold = equi_join(table(spark, d, "lineitem"), supplied, ["l_partkey", "l_suppkey"], ["ps_partkey", "ps_suppkey"])
    dated = equi_join(sold, table(spark, d, "orders"), ["l_orderkey"], ["o_orderkey"])
    earned = project(
        dated, lhs=[1.0, "l_extendedprice", "ps_supplycost", "x"], binary_ops=["-", "*", "*", "-"], rhs=["l_discount", "x", "l_quantity", "y"], binary_out=["x", "x", "y", "amount"],
        names=["n_name", "o_orderdate", "amount"], renames=["nation", "o_orderdate", "amount"],
    )
    return _round(aggregate(earned, ["nation", "o_orderdate"], ["sum"], ["amount"], ["sum_profit"]), sum_profit=4)


QUERIES["q9_tpch"] = (q9_tpch, f"""
WITH {PARTSUPP}
SELECT n_name AS nation, o_orderdate, round(sum(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 4) AS sum_profit
FROM lineitem JOIN partsupp ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey JOIN part ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey
GROUP BY n_name, o_orderdate""")  # fmt: skip


def q17_tpch(spark, d):
    joined = equi_join(table(spark, d, "lineitem"), table(spark, d, "part"), ["l_partkey"], ["p_partkey"])
    kept = select(joined, ["p_brand", "l_quantity"], ["==", "<"], ["Brand#23", 5.1])
    return _round(project(kept, ["sum"], ["l_extendedprice"], ["t"], ["t"], ["/"], [7.0], ["avg_yearly"], ["avg_yearly"]), avg_yearly=2)


QUERIES["q17_tpch"] = (q17_tpch, "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#23' AND l_quantity < 5.1")
