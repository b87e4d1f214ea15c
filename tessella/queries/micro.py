"""Small queries, one for each comparison, arithmetic operator, reduction and join rule."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tessella.functions.scalar import Lit, Ref
from tessella.operators.relational import aggregate, equi_join, project, select
from tessella.session import table

QUERIES: dict = {}


def add(name, query, sql):
    QUERIES[name] = (query, sql)


def line(spark, d):
    return table(spark, d, "lineitem")


Y96, Y97 = datetime.datetime(1996, 1, 1), datetime.datetime(1997, 1, 1)
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
KEYS = KEY.split(", ")

# select

Q6 = (["l_shipdate", "l_shipdate", "l_discount", "l_discount", "l_quantity"], [">=", "<", ">", "<", "<"], [Y96, Y97, 0.05, 0.07, 24.0])
add("select_q6_filter", lambda s, d: select(line(s, d), *Q6), "SELECT * FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' AND l_discount > 0.05 AND l_discount < 0.07 AND l_quantity < 24")
for _name, _op, _sql in (("eq", "==", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">=")):
    add(f"select_{_name}", lambda s, d, op=_op: select(line(s, d), ["l_quantity"], [op], [24.0]), f"SELECT * FROM lineitem WHERE l_quantity {_sql} 24")
add("select_empty_conditions", lambda s, d: select(table(s, d, "nation")), "SELECT * FROM nation")
add("select_string_eq", lambda s, d: select(line(s, d), ["l_returnflag", "l_linestatus"], ["==", "!="], ["R", "O"]), "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'O'")
add("select_date_as_days", lambda s, d: select(line(s, d).withColumn("day", F.unix_date(F.col("l_shipdate").cast("date"))), ["day"], ["<="], [10470]).select(*KEYS, "day"),
    f"SELECT {KEY}, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS day FROM lineitem WHERE l_shipdate < '1998-09-02'")

# project: row by row

ROW = {"add": ("+", "+"), "sub": ("-", "-"), "mul": ("*", "*")}
for _name, (_op, _sql) in ROW.items():
    add(f"project_{_name}", lambda s, d, op=_op: project(line(s, d), lhs=["l_extendedprice"], binary_ops=[op], rhs=["l_discount"], binary_out=["v"], names=[*KEYS, "v"]), f"SELECT {KEY}, l_extendedprice {_sql} l_discount AS v FROM lineitem")
add("project_div", lambda s, d: project(line(s, d), lhs=["l_extendedprice"], binary_ops=["/"], rhs=["l_discount"], binary_out=["v"], names=[*KEYS, "v"]),
    f"SELECT {KEY}, CASE WHEN l_discount = 0 THEN CASE WHEN l_extendedprice > 0 THEN 'infinity'::DOUBLE WHEN l_extendedprice < 0 THEN '-infinity'::DOUBLE ELSE 'nan'::DOUBLE END ELSE l_extendedprice / l_discount END AS v FROM lineitem")
add("project_literal_left", lambda s, d: project(line(s, d), lhs=[Lit(1.0)], binary_ops=["-"], rhs=[Ref("l_discount")], binary_out=["v"], names=[*KEYS, "v"]), f"SELECT {KEY}, 1.0::DOUBLE - l_discount AS v FROM lineitem")
add("project_chained", lambda s, d: project(line(s, d), lhs=[1.0, "l_extendedprice", 1.0, "y"], binary_ops=["-", "*", "+", "*"], rhs=["l_discount", "x", "l_tax", "z"], binary_out=["x", "y", "z", "charge"], names=[*KEYS, "y", "charge"], renames=[*KEYS, "disc_price", "charge"]),
    f"SELECT {KEY}, l_extendedprice * (1.0::DOUBLE - l_discount) AS disc_price, l_extendedprice * (1.0::DOUBLE - l_discount) * (1.0::DOUBLE + l_tax) AS charge FROM lineitem")
add("project_rename", lambda s, d: project(table(s, d, "nation"), names=["n_nationkey", "n_name"], renames=["key", "nation"]), "SELECT n_nationkey AS key, n_name AS nation FROM nation")
add("project_shadow", lambda s, d: project(table(s, d, "nation"), lhs=["n_nationkey", "n_nationkey"], binary_ops=["+", "*"], rhs=[1, 10], binary_out=["n_nationkey", "w"], names=["n_name", "n_nationkey", "w"]),
    "SELECT n_name, n_nationkey + 1 AS n_nationkey, (n_nationkey + 1) * 10 AS w FROM nation")
add("project_sixteen_adds", lambda s, d: project(line(s, d), lhs=["l_extendedprice"] * 16, binary_ops=["+"] * 16, rhs=[1.0] * 16, binary_out=[f"c{i}" for i in range(16)], names=[*KEYS, *(f"c{i}" for i in range(16))]),
    f"SELECT {KEY}, {', '.join(f'l_extendedprice + 1.0::DOUBLE AS c{i}' for i in range(16))} FROM lineitem")

# project: whole columns

for _name, _sql in (("sum", "round(sum(l_quantity), 2)"), ("count", "count(*)"), ("avg", "round(avg(l_quantity), 6)"), ("max", "max(l_quantity)"), ("min", "min(l_quantity)")):
    _digits = {"sum": 2, "avg": 6}.get(_name)

    def _whole(s, d, op=_name, digits=_digits):
        out = project(line(s, d), unary_ops=[op], unary_in=["l_quantity"], unary_out=["v"], names=["v"])
        return out.select(F.round("v", digits).alias("v")) if digits else out

    add(f"project_{_name}", _whole, f"SELECT {_sql} AS v FROM lineitem")
add("project_prod", lambda s, d: project(table(s, d, "nation").withColumn("f", 1 + F.col("n_regionkey") / 10), unary_ops=["prod"], unary_in=["f"], unary_out=["p"], names=["p"]).select(F.round("p", 6).alias("p")),
    "SELECT round(product(1 + n_regionkey / 10.0::DOUBLE), 6) AS p FROM nation")
add("project_sum_of_nothing", lambda s, d: project(select(line(s, d), ["l_quantity"], ["<"], [0.0]), unary_ops=["sum", "prod", "count"], unary_in=["l_quantity"] * 3, unary_out=["a", "b", "c"], names=["a", "b", "c"]),
    "SELECT 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, CAST(0 AS BIGINT) AS c")
add("project_scalar_then_divide", lambda s, d: project(line(s, d), unary_ops=["sum"], unary_in=["l_extendedprice"], unary_out=["t"], lhs=["t"], binary_ops=["/"], rhs=[7.0], binary_out=["yearly"], names=["yearly"]).select(F.round("yearly", 2).alias("yearly")),
    "SELECT round(sum(l_extendedprice) / 7.0, 2) AS yearly FROM lineitem")
add("project_mixed_broadcast", lambda s, d: project(line(s, d), unary_ops=["max"], unary_in=["l_extendedprice"], unary_out=["top"], lhs=["l_extendedprice"], binary_ops=["/"], rhs=["top"], binary_out=["share"], names=[*KEYS, "share"]),
    f"SELECT {KEY}, l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem) AS share FROM lineitem")
add("project_revenue", lambda s, d: project(project(line(s, d), lhs=["l_extendedprice"], binary_ops=["*"], rhs=["l_discount"], binary_out=["r"], names=["r"]), unary_ops=["sum"], unary_in=["r"], unary_out=["revenue"], names=["revenue"]).select(F.round("revenue", 1).alias("revenue")),
    "SELECT round(sum(l_extendedprice * l_discount), 1) AS revenue FROM lineitem")

# equi_join

add("equi_join_orders_lineitem", lambda s, d: equi_join(table(s, d, "orders"), line(s, d), ["o_orderkey"], ["l_orderkey"]), "SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
add("equi_join_two_keys", lambda s, d: equi_join(line(s, d).select("l_partkey", "l_suppkey", "l_orderkey"), line(s, d).where("l_quantity < 10").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("q"), F.col("l_linenumber").alias("n")), ["l_partkey", "l_suppkey"], ["p", "q"]),
    "SELECT a.l_partkey, a.l_suppkey, a.l_orderkey, b.l_partkey AS p, b.l_suppkey AS q, b.l_linenumber AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey WHERE b.l_quantity < 10")
add("equi_join_many_to_many", lambda s, d: equi_join(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), table(s, d, "customer").select("c_custkey", "c_nationkey"), ["s_nationkey"], ["c_nationkey"]),
    "SELECT s_suppkey, s_nationkey, c_custkey, c_nationkey FROM supplier JOIN customer ON s_nationkey = c_nationkey")
add("equi_join_name_clash", lambda s, d: equi_join(table(s, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name")), table(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), ["k"], ["k"]),
    "SELECT r_regionkey AS k, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
add("equi_join_empty", lambda s, d: equi_join(table(s, d, "nation").where("n_nationkey < 0"), table(s, d, "region"), ["n_regionkey"], ["r_regionkey"]), "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 0")

# aggregate

ALL_SIX = (["sum", "prod", "count", "avg", "max", "min"], ["l_quantity", "f", "l_quantity", "l_quantity", "l_quantity", "l_quantity"], ["s", "p", "n", "a", "hi", "lo"])


def _rounded(df, **digits):
    return df.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


add("aggregate_q1_nofilter", lambda s, d: _rounded(aggregate(line(s, d), ["l_returnflag", "l_linestatus"], ["sum", "sum", "avg", "avg", "avg", "count"], ["l_quantity", "l_extendedprice", "l_quantity", "l_extendedprice", "l_discount", "l_quantity"], ["sum_qty", "sum_base", "avg_qty", "avg_price", "avg_disc", "n"]), sum_qty=2, sum_base=2, avg_qty=6, avg_price=4, avg_disc=8),
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 8) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL")
add("aggregate_all_six", lambda s, d: _rounded(aggregate(line(s, d).withColumn("f", 1 + F.col("l_tax")), ["l_orderkey"], *ALL_SIX), s=2, p=8, a=6),
    "SELECT l_orderkey, round(sum(l_quantity), 2) AS s, round(product(1 + l_tax), 8) AS p, count(*) AS n, round(avg(l_quantity), 6) AS a, max(l_quantity) AS hi, min(l_quantity) AS lo FROM lineitem GROUP BY l_orderkey")
add("aggregate_two_keys", lambda s, d: aggregate(line(s, d), ["l_suppkey", "l_returnflag"], ["count", "max"], ["l_quantity", "l_quantity"], ["n", "hi"]), "SELECT l_suppkey, l_returnflag, count(*) AS n, max(l_quantity) AS hi FROM lineitem GROUP BY ALL")
add("aggregate_no_keys", lambda s, d: aggregate(line(s, d), [], ["count", "min"], ["l_quantity", "l_quantity"], ["n", "lo"]), "SELECT count(*) AS n, min(l_quantity) AS lo FROM lineitem")
add("aggregate_empty", lambda s, d: aggregate(line(s, d).where("l_quantity < 0"), ["l_suppkey"], ["count"], ["l_quantity"], ["n"]), "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_suppkey")
