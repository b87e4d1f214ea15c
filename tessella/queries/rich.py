"""Queries in the richer dialect."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.plans.algebra import Field, Scan, Value, date, lower, wrap
from tessella.queries.tpch import PARTSUPP, partsupp
from tessella.session import table

QUERIES: dict = {}
L, O, C = Scan("lineitem"), Scan("orders"), Scan("customer")
f = Field


def _tables(spark, d):
    return lambda name: partsupp(spark, d) if name == "partsupp" else table(spark, d, name)


def add(name, plan, sql, **digits):
    def query(spark, d):
        df = lower(plan, _tables(spark, d))
        return df.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))

    QUERIES[name] = (query, sql)


net = f("l_extendedprice") * (1.0 - f("l_discount"))
q1 = (
    L.where(f("l_shipdate") < date("1998-08-31"))
    .project("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", net.named("disc_price"), (net * (1.0 + f("l_tax"))).named("charge"))
    .group("l_returnflag", "l_linestatus", sum_qty=("sum", "l_quantity"), sum_base=("sum", "l_extendedprice"), sum_disc=("sum", "disc_price"), sum_charge=("sum", "charge"), discounts=("sum", "l_discount"), n=("count", "l_quantity"))
    .project("l_returnflag", "l_linestatus", "sum_qty", "sum_base", "sum_disc", "sum_charge", (f("sum_qty") / f("n")).named("avg_qty"), (f("sum_base") / f("n")).named("avg_price"), (f("discounts") / f("n")).named("avg_disc"), "n")
    .order("l_returnflag", "l_linestatus")
)
add("og_q1", q1, """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 1) AS sum_disc,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 1) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 8) AS avg_disc, count(*) AS n
  FROM lineitem WHERE l_shipdate < '1998-08-31' GROUP BY l_returnflag, l_linestatus""", sum_qty=2, sum_base=2, sum_disc=1, sum_charge=1, avg_qty=6, avg_price=4, avg_disc=8)  # fmt: skip

building = C.where(f("c_mktsegment").contains("BUILDING")).project("c_custkey")
early = O.where(f("o_orderdate") < date("1998-03-15")).project("o_orderkey", "o_custkey", "o_orderdate")
first_join = early.join(building, "o_custkey", "c_custkey")
add("og_q3_first_join", first_join, "SELECT o_orderkey, o_custkey, o_orderdate, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(c_mktsegment, 'BUILDING') AND o_orderdate < '1998-03-15'")
late = L.where(f("l_shipdate") > date("1998-03-15")).project("l_orderkey", net.named("net"))
q3 = late.join(first_join, "l_orderkey", "o_orderkey").group("l_orderkey", "o_orderdate", revenue=("sum", "net"))
Q3 = """SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE c_mktsegment = 'BUILDING' AND o_orderdate < '1998-03-15' AND l_shipdate > '1998-03-15' GROUP BY l_orderkey, o_orderdate"""
add("og_q3_notop", q3, Q3, revenue=4)
add("og_q3", q3.top(10, ("revenue", "desc"), "o_orderdate", "l_orderkey"), Q3 + " ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, o_orderdate, l_orderkey LIMIT 10", revenue=4)

in_95 = (f("l_shipdate") > date("1995-12-31")) & (f("l_shipdate") < date("1997-01-01"))
q6 = L.where(in_95 & (f("l_discount") > Value(0.0499)) & (Value(0.07001) > f("l_discount")) & (Value(24.0) > f("l_quantity"))).group(revenue=("sum", f("l_extendedprice") * f("l_discount")))
Q6 = "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate > '1995-12-31' AND l_shipdate < '1997-01-01' AND l_discount > 0.0499 AND l_discount < 0.07001 AND l_quantity < 24"
add("og_q6", q6, Q6, revenue=2)


def og_q6_reclustered(spark, d):
    """The same over lineitem dealt out anew by month of shipping: the result does not depend on how rows lie."""
    moved = table(spark, d, "lineitem").repartition(8, F.date_trunc("month", F.col("l_shipdate"))).sortWithinPartitions("l_shipdate")
    return lower(q6, {"lineitem": moved}).select(F.round("revenue", 2).alias("revenue"))


QUERIES["og_q6_reclustered"] = (og_q6_reclustered, Q6)

priced = Scan("part").where((f("p_retailprice") > Value(950.0)) & (Value(980.0) > f("p_retailprice"))).project("p_partkey")
by_nation = Scan("supplier").project("s_suppkey", "s_nationkey").join(Scan("nation").project("n_nationkey", "n_name"), "s_nationkey", "n_nationkey")
costs = Scan("partsupp").join(priced, "ps_partkey", "p_partkey").join(by_nation, "ps_suppkey", "s_suppkey")
amount = net - f("ps_supplycost") * f("l_quantity")


def _q9(sold):
    return (
        sold.join(O.project("o_orderkey", f("o_orderdate").year().named("o_year")), "l_orderkey", "o_orderkey")
        .project(f("n_name").named("nation"), "o_year", amount.named("amount")).group("nation", "o_year", sum_profit=("sum", "amount")).order("nation", ("o_year", "desc"))
    )


Q9 = f"""WITH {PARTSUPP}
SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 4) AS sum_profit
FROM lineitem JOIN partsupp ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey WHERE p_retailprice > 950 AND p_retailprice < 980 GROUP BY ALL"""
add("og_q9", _q9(L.join(costs, ("l_partkey", "l_suppkey"), ("ps_partkey", "ps_suppkey"))), Q9, sum_profit=4)
add("og_q9_split", _q9(L.join(costs, "l_partkey", "ps_partkey").where(f("l_suppkey").equals("ps_suppkey"))), Q9, sum_profit=4)

large = L.group("l_orderkey", sum_qty=("sum", "l_quantity")).where(f("sum_qty") > Value(300.0))
add("og_q18_subquery", large, "SELECT l_orderkey, round(sum(l_quantity), 2) AS sum_qty FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 300", sum_qty=2)
q18 = large.join(O.project("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), "l_orderkey", "o_orderkey").join(C.project("c_custkey", "c_name"), "o_custkey", "c_custkey").project("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", wrap("sum_qty").named("sum_qty"))
Q18 = """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
  GROUP BY ALL HAVING sum(l_quantity) > 300"""
add("og_q18_notop", q18, Q18, sum_qty=2)
add("og_q18", q18.top(100, ("o_totalprice", "desc"), "o_orderdate", "o_orderkey"), Q18 + " ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100", sum_qty=2)
