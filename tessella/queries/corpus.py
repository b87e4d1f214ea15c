"""The decision-support queries in SQL, with the columns and constants that the fixture has.

One text serves both engines: PARTSUPP is a derived table, floating sums are rounded, counts are bigint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.queries.tpch import PARTSUPP
from tessella.session import views

QUERIES: dict = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def add(number: str, text: str) -> None:
    if "partsupp" in text:
        text = f"WITH {PARTSUPP}{', ' + text[5:] if text.startswith('WITH ') else ' ' + text}"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *TABLES)
        return spark.sql(text)

    QUERIES[f"tpch_sql_{number}"] = (query, text)


NET = "l_extendedprice * (1 - l_discount)"

add("01", f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum({NET}), 1) AS sum_disc_price,
  round(sum({NET} * (1 + l_tax)), 1) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 8) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= date '1998-12-01' - interval '90' day GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
add("02", """SELECT s_acctbal, s_name, n_name, p_partkey FROM partsupp JOIN part ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey
JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE p_size = 15 AND p_type LIKE '%ECONOMY' AND r_name = 'EUROPE' AND ps_supplycost = (
  SELECT min(c.ps_supplycost) FROM partsupp c JOIN supplier z ON z.s_suppkey = c.ps_suppkey JOIN nation y ON y.n_nationkey = z.s_nationkey JOIN region x ON x.r_regionkey = y.n_regionkey
  WHERE c.ps_partkey = p_partkey AND x.r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""")
add("03", f"""SELECT l_orderkey, round(sum({NET}), 4) AS revenue, o_orderdate FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < date '1998-03-15' AND l_shipdate > date '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY sum({NET}) DESC, o_orderdate, l_orderkey LIMIT 10""")
add("04", """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= date '1997-07-01' AND o_orderdate < date '1997-07-01' + interval '3' month
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority ORDER BY o_orderpriority""")
add("05", f"""SELECT n_name, round(sum({NET}), 4) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= date '1997-01-01' AND o_orderdate < date '1997-01-01' + interval '1' year GROUP BY n_name ORDER BY revenue DESC""")
add("06", """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1996-01-01' + interval '1' year AND l_discount BETWEEN 0.06 - 0.01 AND 0.06 + 0.01 AND l_quantity < 24""")
add("07", f"""SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
  SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS int) AS l_year, {NET} AS volume
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey
  WHERE ((a.n_name = 'NATION_1' AND b.n_name = 'NATION_2') OR (a.n_name = 'NATION_2' AND b.n_name = 'NATION_1')) AND l_shipdate BETWEEN date '1997-01-01' AND date '1998-12-31') AS shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""")

SHARE = f"""SELECT o_year, round(sum({{share}}) / sum(volume), 6) AS mkt_share FROM (
  SELECT CAST(extract(year FROM o_orderdate) AS int) AS o_year, {NET} AS volume, s.n_name AS nation FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation c ON c.n_nationkey = c_nationkey JOIN region ON r_regionkey = c.n_regionkey JOIN nation s ON s.n_nationkey = s_nationkey
  WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND o_orderdate BETWEEN date '1997-01-01' AND date '1998-12-31') AS all_nations GROUP BY o_year ORDER BY o_year"""
add("08", SHARE.format(share="CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END"))
add("08a", SHARE.format(share="CASE nation WHEN 'NATION_3' THEN volume ELSE 0 END"))
add("09", f"""SELECT nation, o_year, round(sum(amount), 4) AS sum_profit FROM (
  SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS int) AS o_year, {NET} - ps_supplycost * l_quantity AS amount FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN partsupp ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = s_nationkey WHERE p_name LIKE '%ring%') AS profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC""")
add("10", f"""SELECT c_custkey, c_name, round(sum({NET}), 4) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderdate >= date '1997-10-01' AND o_orderdate < date '1997-10-01' + interval '3' month AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY sum({NET}) DESC, c_custkey LIMIT 20""")
add("11", """SELECT ps_partkey, round(sum(ps_supplycost * ps_availqty), 4) AS value FROM partsupp JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_7'
GROUP BY ps_partkey HAVING sum(ps_supplycost * ps_availqty) > (
  SELECT sum(ps_supplycost * ps_availqty) * 0.0001 FROM partsupp JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_7')
ORDER BY value DESC, ps_partkey""")

LATE = """SELECT l_returnflag, CAST(sum({high}) AS bigint) AS high_line_count, CAST(sum({low}) AS bigint) AS low_line_count FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate AND l_shipdate >= date '1997-01-01' AND l_shipdate < date '1997-01-01' + interval '1' year GROUP BY l_returnflag ORDER BY l_returnflag"""
add("12", LATE.format(high="CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END", low="CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END"))
add("12a", LATE.format(high="CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 1 ELSE 0 END", low="CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 0 ELSE 1 END"))
add("13", """SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON o_custkey = c_custkey AND o_orderpriority NOT LIKE '1%' GROUP BY c_custkey) AS c_orders
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""")
add("13a", """WITH c_orders AS (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON o_custkey = c_custkey AND o_orderpriority NOT LIKE '1%' GROUP BY c_custkey)
SELECT c_count, count(*) AS custdist FROM c_orders GROUP BY c_count ORDER BY custdist DESC, c_count DESC""")

PROMO = f"""SELECT round(100.00 * sum({{promo}}) / sum({NET}), 6) AS promo_revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_shipdate >= date '1997-09-01' AND l_shipdate < date '1997-09-01' + interval '1' month"""
add("14", PROMO.format(promo=f"CASE WHEN p_type LIKE 'PROMO%' THEN {NET} ELSE 0 END"))
add("14a", PROMO.format(promo=f"CASE substring(p_type FROM 1 FOR 5) WHEN 'PROMO' THEN {NET} ELSE 0 END"))

REVENUE = f"""revenue AS (SELECT l_suppkey AS supplier_no, round(sum({NET}), 4) AS total_revenue FROM lineitem
  WHERE l_shipdate >= date '1997-01-01' AND l_shipdate < date '1997-01-01' + interval '3' month GROUP BY l_suppkey)"""
add("15a", f"""WITH {REVENUE} SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no
WHERE total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""")


def tpch_sql_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the revenue as a view that is made, used and dropped."""
    views(spark, sf_dir, *TABLES)
    spark.sql(f"WITH {REVENUE} SELECT * FROM revenue").createOrReplaceTempView("revenue_of_quarter")
    out = spark.sql("SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue_of_quarter ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue_of_quarter) ORDER BY s_suppkey")
    spark.catalog.dropTempView("revenue_of_quarter")
    return out


QUERIES["tpch_sql_15"] = (tpch_sql_15, QUERIES["tpch_sql_15a"][1])
add("16", """SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#12' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""")
add("17", """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#23' AND l_quantity < (SELECT 0.2 * avg(z.l_quantity) FROM lineitem z WHERE z.l_partkey = p_partkey)""")
add("18", """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 300)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")
add("19", f"""SELECT round(sum({NET}), 4) AS revenue FROM lineitem JOIN part ON
  (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 25)
  OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
  OR (p_partkey = l_partkey AND p_brand = 'Brand#15' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)""")
add("20", """SELECT s_name, s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_3' AND s_suppkey IN (
  SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%')
  AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= date '1997-01-01' AND l_shipdate < date '1997-01-01' + interval '1' year))
ORDER BY s_name""")
add("21", """SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem a ON s_suppkey = a.l_suppkey JOIN orders ON o_orderkey = a.l_orderkey
WHERE o_orderstatus = 'F' AND a.l_shipdate > o_orderdate + interval '60' day
AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_shipdate > o_orderdate + interval '60' day)
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""")
add("22", """SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (
  SELECT c_nationkey AS cntrycode, c_acctbal FROM customer WHERE c_nationkey IN (13, 1, 23, 9, 17, 18, 7)
  AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00 AND c_nationkey IN (13, 1, 23, 9, 17, 18, 7))
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')) AS custsale
GROUP BY cntrycode ORDER BY cntrycode""")
