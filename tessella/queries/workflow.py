"""Sweeps, matrices, trip analytics, and round trips through files and Python blocks."""

from __future__ import annotations

import tempfile
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tessella.functions.scalar import haversine_atan_m, haversine_m
from tessella.operators import analytics, blocks, matrix
from tessella.operators.relational import aggregate, equi_join, select
from tessella.plans.tree import Evaluator, Node
from tessella.session import table
from tessella.sources import files, generate

QUERIES: dict = {}

# sweeps: thresholds and group shapes

THRESHOLDS = (1, 50, 1000, 5000, 9000)


def together(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def counted(df, **labels):
    """One row: the labels and the number of rows."""
    return aggregate(df, [], ["count"], [df.columns[0]], ["n"]).select(*(F.lit(v).alias(k) for k, v in labels.items()), "n")


def sweep_selectivity(spark, d):
    """How many rows pass the selection ``key < t`` for each threshold, over keys 1 to 10000."""
    keys = table(spark, d, "lineitem").select((F.col("l_partkey") * 7919 % 10000 + 1).alias("key"))
    return together([counted(select(keys, ["key"], ["<"], [t]), threshold=t) for t in THRESHOLDS]).withColumn("threshold", F.col("threshold").cast("bigint"))


QUERIES["sweep_selectivity"] = (sweep_selectivity, f"SELECT CAST(t AS BIGINT) AS threshold, (SELECT count(*) FROM lineitem WHERE l_partkey * 7919 % 10000 + 1 < t) AS n FROM (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]) AS t)")


def _group(key, payloads):
    """Grouped max, min and sum of payloads of either width by a key of either width."""
    def query(spark, d):
        df = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("int" if key == 4 else "bigint").alias("key"), F.col("l_linenumber").cast("int").alias("p4"), F.col("l_partkey").alias("p8"))
        return aggregate(df, ["key"], [x for x, _ in payloads], [f"p{w}" for _, w in payloads], [f"v{i}" for i in range(len(payloads))])

    cast = "INTEGER" if key == 4 else "BIGINT"
    kind = lambda op, w: "BIGINT" if op == "sum" or w == 8 else "INTEGER"
    columns = ", ".join(f"CAST({op}({'l_linenumber' if w == 4 else 'l_partkey'}) AS {kind(op, w)}) AS v{i}" for i, (op, w) in enumerate(payloads))
    return query, f"SELECT CAST(l_suppkey AS {cast}) AS key, {columns} FROM lineitem GROUP BY 1"


FIVE = [("max", 8), ("min", 8), ("sum", 8), ("max", 4), ("min", 4)]
for _key in (4, 8):
    for _name, _payloads in (("pay4", [("max", 4)]), ("pay8", [("max", 8)]), ("pay16", [("max", 8), ("min", 8)]), ("pay24", [("max", 8), ("min", 8), ("sum", 8)]), ("pay40", FIVE)):
        QUERIES[f"group_key{_key}_{_name}"] = _group(_key, _payloads)


def group_cardinality(spark, d):
    """max(payload) by keys of 10, 100 and 1000 values: one query for each, over the same scan."""
    base = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    parts = [aggregate(base.withColumn("key", F.col("l_orderkey") % c), ["key"], ["max"], ["l_partkey"], ["v"]).select(F.lit(c).alias("cardinality"), "key", "v") for c in (10, 100, 1000)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES["group_cardinality"] = (group_cardinality, " UNION ALL ".join(f"SELECT {c} AS cardinality, l_orderkey % {c} AS key, max(l_partkey) AS v FROM lineitem GROUP BY 2" for c in (10, 100, 1000)))
QUERIES["partition_join"] = (
    lambda s, d: equi_join(table(s, d, "lineitem").select(F.col("l_orderkey").alias("key1")), table(s, d, "orders").select(F.col("o_orderkey").alias("key2")), ["key1"], ["key2"]),
    "SELECT l_orderkey AS key1, o_orderkey AS key2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)

# sweeps over generated rows: order, lengths of sections, clustering of keys

N = 100_000


def sweep_randomness(spark, d):
    """A selection of half of the values, which come in order but for a share of the rows."""
    return together([counted(select(generate.numbers(spark, N).select(generate.disordered(N, p).alias("v")), ["v"], ["<"], [N // 2]), percent=p) for p in (0, 10, 50, 100)])


QUERIES["sweep_randomness"] = (
    sweep_randomness,
    f"SELECT CAST(p AS INTEGER) AS percent, count(*) AS n FROM range({N}) r(i), (SELECT unnest([0, 10, 50, 100]) AS p) WHERE CASE WHEN i * 31 % 100 < p THEN i * 7919 % {N} ELSE i END < {N // 2} GROUP BY p",
)


def sweep_sections(spark, d):
    """A selection of one of two values that come in sections of equal length, and of one of ten, by length and ratio."""
    frames = [counted(select(generate.numbers(spark, N).select(generate.sections(length, kinds).alias("v")), ["v"], ["=="], [0]), length=length, kinds=kinds) for length in (1, 64, 4096) for kinds in (2, 10)]
    return together(frames)


QUERIES["sweep_sections"] = (
    sweep_sections,
    f"SELECT CAST(l AS INTEGER) AS length, CAST(k AS INTEGER) AS kinds, count(*) AS n FROM range({N}) r(i), (SELECT unnest([1, 64, 4096]) AS l), (SELECT unnest([2, 10]) AS k) WHERE (i // l) % k = 0 GROUP BY l, k",
)


def sweep_group_clustering(spark, d):
    """Grouped maximum and sum by keys in runs of 1, 100 and 10000 rows."""
    frames = [aggregate(generate.numbers(spark, N).select(generate.clustered(N, 50, run).alias("key"), generate.permuted(N).alias("v")), ["key"], ["max", "sum"], ["v", "v"], ["top", "total"]).withColumn("run", F.lit(run)) for run in (1, 100, 10000)]
    return together(frames)


QUERIES["sweep_group_clustering"] = (
    sweep_group_clustering,
    f"SELECT (i // r.run) % 50 AS key, max(i * 7919 % {N}) AS top, CAST(sum(i * 7919 % {N}) AS BIGINT) AS total, CAST(r.run AS INTEGER) AS run FROM range({N}) t(i), (SELECT unnest([1, 100, 10000]) AS run) r GROUP BY 1, r.run",
)


def group_two_sections(spark, d):
    """Grouped counts and minima where the first half has ten keys and the second a thousand."""
    rows = generate.numbers(spark, N).select(generate.two_sections(N, 10, 1000).alias("key"), generate.permuted(N).alias("v"))
    return aggregate(rows, ["key"], ["count", "min"], ["v", "v"], ["n", "least"])


QUERIES["group_two_sections"] = (
    group_two_sections,
    f"SELECT CASE WHEN i < {N // 2} THEN i % 10 ELSE i % 1000 END AS key, count(*) AS n, min(i * 7919 % {N}) AS least FROM range({N}) t(i) GROUP BY 1",
)


def sweep_partition_join(spark, d):
    """Joins of 100,000 rows with tables of 10, 1000 and 50,000 keys, which the rows have in runs or scattered."""
    frames = []
    for keys in (10, 1000, 50_000):
        other = generate.numbers(spark, keys).select(F.col("i").alias("k"), (F.col("i") * 3).alias("w"))
        for run in (1, 1000):
            rows = generate.numbers(spark, N).select(generate.clustered(N, keys, run).alias("key"))
            joined = equi_join(rows, other, ["key"], ["k"])
            frames.append(aggregate(joined, [], ["count", "sum"], ["w", "w"], ["n", "total"]).select(F.lit(keys).alias("keys"), F.lit(run).alias("run"), "n", "total"))
    return together(frames)


QUERIES["sweep_partition_join"] = (
    sweep_partition_join,
    f"""SELECT CAST(c AS INTEGER) AS keys, CAST(r AS INTEGER) AS run, count(*) AS n, CAST(sum(k.i * 3) AS BIGINT) AS total
    FROM range({N}) t(i), (SELECT unnest([10, 1000, 50000]) AS c), (SELECT unnest([1, 1000]) AS r), range(50000) k(i) WHERE k.i < c AND k.i = (t.i // r) % c GROUP BY c, r""",
)

# trees with tables in them, and the richer dialect as data

NUMBERS_TABLE = Node("Table", Node("a", Node("List", 1, 2, 3), Node("List", 4)), Node("b", Node("List", 1.5, float("nan"), 3.5, 1.5)), Node("c", Node("List", "x", "y", "x", "z")))
GIVEN = "(VALUES (1, 1.5::DOUBLE, 'x'), (2, 'nan'::DOUBLE, 'y'), (3, 3.5::DOUBLE, 'x'), (4, 1.5::DOUBLE, 'z')) t(a, b, c)"


def tree(node):
    return lambda spark, d: Evaluator(spark, lambda name: table(spark, d, name))(node)


QUERIES["tree_table_literal"] = (tree(NUMBERS_TABLE), f"SELECT CAST(a AS BIGINT) AS a, b, c FROM {GIVEN}")
QUERIES["tree_project"] = (
    tree(Node("project", NUMBERS_TABLE, ["sum", "count"], ["a", "a"], ["s", "n"], ["a"], ["*"], [2], ["twice"], ["a", "twice", "s", "n"])),
    f"SELECT CAST(a AS BIGINT) AS a, CAST(2 * a AS BIGINT) AS twice, CAST(sum(a) OVER () AS BIGINT) AS s, count(*) OVER () AS n FROM {GIVEN}",
)
QUERIES["tree_reduction_of_reduction"] = (
    tree(Node("project", NUMBERS_TABLE, ["sum", "sum", "count", "max"], ["a", "s", "s", "n"], ["s", "ss", "n", "m"], [], [], [], [], ["s", "ss", "n", "m"])),
    f"SELECT CAST(sum(a) AS BIGINT) AS s, CAST(sum(a) AS BIGINT) AS ss, CAST(1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS m FROM {GIVEN}",
)
QUERIES["tree_equi_join"] = (
    tree(Node("equi_join", NUMBERS_TABLE, Node("Table", Node("k", Node("List", 2, 4, 4, 9)), Node("v", Node("List", "p", "q", "r", "s"))), ["a"], ["k"])),
    f"SELECT CAST(a AS BIGINT) AS a, b, c, CAST(k AS BIGINT) AS k, v FROM {GIVEN} JOIN (VALUES (2, 'p'), (4, 'q'), (4, 'r'), (9, 's')) s(k, v) ON a = k",
)
QUERIES["tree_nan_join"] = (
    tree(Node("Join", NUMBERS_TABLE, Node("Table", Node("d", Node("List", float("nan"), 1.5))), Node("Where", Node("Equal", "b", "d")))),
    f"SELECT CAST(a AS BIGINT) AS a, b, c, d FROM {GIVEN} JOIN (VALUES ('nan'::DOUBLE), (1.5::DOUBLE)) s(d) ON b = d AND NOT isnan(b)",
)
QUERIES["tree_nan_select"] = (
    tree(Node("Select", NUMBERS_TABLE, Node("Where", Node("And", Node("Greater", "b", 1.0), Node("Greater", 4, "a"))))),
    f"SELECT CAST(a AS BIGINT) AS a, b, c FROM {GIVEN} WHERE b > 1.0 AND NOT isnan(b) AND a < 4",
)
QUERIES["tree_nan_keys"] = (
    tree(Node("equi_join", NUMBERS_TABLE, Node("Table", Node("d", Node("List", float("nan"), 3.5))), ["b"], ["d"])),
    f"SELECT CAST(a AS BIGINT) AS a, b, c, d FROM {GIVEN} JOIN (VALUES ('nan'::DOUBLE), (3.5::DOUBLE)) s(d) ON b = d AND NOT isnan(b)",
)
QUERIES["tree_og_group"] = (
    tree(Node("Group", Node("table", "lineitem"), Node("By", "l_returnflag"), Node("As", "least", Node("Min", "l_quantity"), "most", Node("Max", "l_quantity"), "n", Node("Count", "l_quantity")))),
    "SELECT l_returnflag, min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n FROM lineitem GROUP BY l_returnflag",
)
_net = Node("Times", "l_extendedprice", Node("Minus", 1, "l_discount"))
_orders = Node("Project", Node("Select", Node("table", "orders"), Node("Where", Node("Greater", Node("DateObject", "1995-03-15"), "o_orderdate"))), Node("As", "o_orderkey", "o_orderkey", "o_orderdate", "o_orderdate"))
_sold = Node("Select", Node("table", "lineitem"), Node("Where", Node("Greater", "l_shipdate", Node("DateObject", "1995-03-15"))))
QUERIES["tree_og_q3"] = (
    lambda spark, d: tree(
        Node("Top", Node("Group", Node("Join", _sold, _orders, Node("Where", Node("Equal", "l_orderkey", "o_orderkey"))), Node("By", "l_orderkey"), Node("As", "revenue", Node("Sum", _net))), Node("By", Node("Desc", "revenue"), "l_orderkey"), 10)
    )(spark, d).withColumn("revenue", F.round("revenue", 2)),
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_shipdate > DATE '1995-03-15' AND o_orderdate < DATE '1995-03-15' GROUP BY l_orderkey ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, l_orderkey LIMIT 10""",
)

# matrices

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
WEIGHTS = [0.5, 0.25, 2.0, 4.0]
QUERIES["matrix_vector"] = (
    lambda s, d: matrix.weighted(table(s, d, "lineitem"), NUMBERS, WEIGHTS, keep=ID).select(*ID, F.round("product", 4).alias("product")),
    f"SELECT {', '.join(ID)}, round(l_quantity * 0.5 + l_extendedprice * 0.25 + l_discount * 2.0 + l_tax * 4.0, 4) AS product FROM lineitem",
)
QUERIES["gram_matrix"] = (
    lambda s, d: matrix.gram(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).select("i", "j", F.round("value", 2).alias("value")),
    " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum({a} * {b}), 2) AS value FROM lineitem" for i, a in enumerate(["l_quantity", "l_discount", "l_tax"]) for j, b in enumerate(["l_quantity", "l_discount", "l_tax"])),
)
QUERIES["stack_columns"] = (
    lambda s, d: matrix.from_matrix(matrix.to_matrix(table(s, d, "lineitem"), NUMBERS, keep=ID), ["a", "b", "c", "e"], keep=ID),
    f"SELECT {', '.join(ID)}, l_quantity AS a, l_extendedprice AS b, l_discount AS c, l_tax AS e FROM lineitem",
)
QUERIES["aggregate_matrix"] = (
    lambda s, d: matrix.aggregate_matrix(table(s, d, "lineitem"), ["l_suppkey", "l_returnflag", "l_quantity"], [0, 1], [2]).select("l_suppkey", "l_returnflag", F.round("sum_l_quantity", 2).alias("sum_l_quantity")),
    "SELECT l_suppkey, l_returnflag, round(sum(l_quantity), 2) AS sum_l_quantity FROM lineitem GROUP BY ALL",
)
QUERIES["split_into_spans"] = (
    lambda s, d: matrix.spans(table(s, d, "orders").select("o_orderkey"), 1000, ["o_orderkey"]).select("o_orderkey", F.col("span").cast("bigint").alias("span")),
    "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS span FROM orders",
)

# trips: orders stand for trips, the places of customers and suppliers for stations

TRIPS = """trips AS (SELECT o_orderkey AS id, o_custkey % 40 AS a, o_orderkey % 40 AS b, CAST(o_custkey % 40 AS DOUBLE) / 100 + 45.5 AS lat1, CAST(o_custkey % 40 AS DOUBLE) / 50 - 73.6 AS lon1,
  CAST(o_orderkey % 40 AS DOUBLE) / 100 + 45.5 AS lat2, CAST(o_orderkey % 40 AS DOUBLE) / 50 - 73.6 AS lon2, o_totalprice AS duration FROM orders)"""
DISTANCE = """2000 * 6371.0 * asin(sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2)))"""


def stations(spark, d):
    return spark.range(40).select(F.col("id").alias("code"), (F.col("id").cast("double") / 100 + 45.5).alias("latitude"), (F.col("id").cast("double") / 50 - 73.6).alias("longitude"))


def trips(spark, d):
    """Trips with the places of both stations: two joins on one small table."""
    raw = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("a"), (F.col("o_orderkey") % 40).alias("b"), F.col("o_totalprice").alias("duration"))
    s = stations(spark, d)
    start = s.select(F.col("code").alias("a"), F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1"))
    end = s.select(F.col("code").alias("b"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    return equi_join(equi_join(raw, start, ["a"], ["a"]), end, ["b"], ["b"])


def measured(spark, d):
    return trips(spark, d).withColumn("distance", haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))


QUERIES["haversine"] = (lambda s, d: measured(s, d).select("id", F.round("distance", 3).alias("distance")), f"WITH {TRIPS} SELECT id, round({DISTANCE}, 3) AS distance FROM trips")
QUERIES["haversine_atan2"] = (
    lambda s, d: trips(s, d).select("id", F.round(haversine_atan_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 3).alias("distance")),
    f"WITH {TRIPS} SELECT id, round({DISTANCE}, 3) AS distance FROM trips",
)
NORMAL = f"""{TRIPS}, m AS (SELECT id, {DISTANCE} AS distance, duration FROM trips),
 t AS (SELECT id, distance / (SELECT max(distance) FROM m) AS x, duration / (SELECT max(duration) FROM m) AS y FROM m)"""


def normal(spark, d):
    return analytics.max_normalise(measured(spark, d).select("id", F.col("distance").alias("x"), F.col("duration").alias("y")), "x", "y")


QUERIES["normalise"] = (lambda s, d: normal(s, d).select("id", F.round("x", 8).alias("x"), F.round("y", 8).alias("y")), f"WITH {NORMAL} SELECT id, round(x, 8) AS x, round(y, 8) AS y FROM t")


def _fitted(spark, d):
    train, test = analytics.split(normal(spark, d), F.col("id"))
    return analytics.fit_linear(train, "x", "y"), test


def linreg_fit(spark, d):
    fit, _ = _fitted(spark, d)
    return spark.createDataFrame([(round(fit.intercept, 6), round(fit.slope, 6), round(fit.train_error, 8), round(fit.stale_train_error, 8))], "intercept double, slope double, train_error double, stale_train_error double")


def linreg_test_error(spark, d):
    """The half mean squared error over the test rows, in the units of the durations."""
    fit, test = _fitted(spark, d)
    top = measured(spark, d).agg(F.max("duration")).first()[0]
    return spark.createDataFrame([(round(analytics.half_mse(test, "x", "y", fit) * top, 2),)], "error double")


STEPS = f"""WITH RECURSIVE {NORMAL}, s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, sum(y * y) AS syy FROM t WHERE id % 10 < 7),
 g AS (SELECT 0 AS k, 1.0::DOUBLE AS p, 1.0::DOUBLE AS q UNION ALL
   SELECT k + 1, p - 0.1 * (n * p + sx * q - sy) / n, q - 0.1 * (sx * p + sxx * q - sxy) / n FROM g, s WHERE k < 51),
 e AS (SELECT k, p, q, (n * p * p + 2 * p * q * sx + q * q * sxx - 2 * p * sy - 2 * q * sxy + syy) / (2 * n) AS err FROM g, s)"""
QUERIES["linreg_fit"] = (linreg_fit, f"{STEPS} SELECT round(p, 6) AS intercept, round(q, 6) AS slope, round(err, 8) AS train_error, round((SELECT err FROM e WHERE k = 50), 8) AS stale_train_error FROM e WHERE k = 51")
QUERIES["linreg_test_error"] = (linreg_test_error, f"{STEPS} SELECT round((SELECT sum(pow(p + q * x - y, 2)) / (2 * count(*)) FROM t WHERE id % 10 >= 7) * (SELECT max(duration) FROM trips), 2) AS error FROM e WHERE k = 51")

QUERIES["frequent_pairs"] = (lambda s, d: analytics.frequent_pairs(trips(s, d), "a", "b", 12), f"WITH {TRIPS} SELECT a, b, count(*) AS count FROM trips WHERE a <> b GROUP BY a, b HAVING count(*) >= 12")
QUERIES["distinct_every_third"] = (
    lambda s, d: analytics.every_nth(trips(s, d).select("a", "b").distinct(), 3, "a", "b"),
    f"WITH {TRIPS} SELECT a, b FROM (SELECT a, b, row_number() OVER (ORDER BY a, b) AS k FROM (SELECT DISTINCT a, b FROM trips)) WHERE (k - 1) % 3 = 0",
)


def _test_pairs(s, d):
    return analytics.every_nth(trips(s, d).select("a", "b").distinct(), 3, "a", "b")


THIRD = "third AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (ORDER BY a, b) AS k FROM (SELECT DISTINCT a, b FROM trips)) WHERE (k - 1) % 3 = 0)"
QUERIES["in_list_semi"] = (lambda s, d: analytics.within(trips(s, d), _test_pairs(s, d), "a", "b").select("id", "a", "b"), f"WITH {TRIPS}, {THIRD} SELECT id, a, b FROM trips SEMI JOIN third USING (a, b)")
QUERIES["not_in_anti"] = (lambda s, d: analytics.without(trips(s, d), _test_pairs(s, d), "a", "b").select("id", "a", "b"), f"WITH {TRIPS}, {THIRD} SELECT id, a, b FROM trips ANTI JOIN third USING (a, b)")
QUERIES["refresh_insert_delete"] = (
    lambda s, d: analytics.apply_refresh(table(s, d, "orders"), table(s, d, "orders").where("o_orderkey % 10 = 3").withColumn("o_orderkey", -F.col("o_orderkey")), table(s, d, "orders").where("o_orderkey % 10 = 7").select("o_orderkey"), ("o_orderkey",)),
    "SELECT * FROM orders WHERE o_orderkey % 10 <> 7 UNION ALL SELECT * REPLACE (-o_orderkey AS o_orderkey) FROM orders WHERE o_orderkey % 10 = 3",
)

# expression trees, files, blocks

QUERIES["tree_select_aggregate"] = (
    lambda s, d: Evaluator(s, lambda name: table(s, d, name))(Node("aggregate", Node("select", Node("table", "lineitem"), ["l_quantity"], ["<"], [24.0]), ["l_returnflag"], ["count"], ["l_quantity"], ["n"])),
    "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 24 GROUP BY l_returnflag",
)


def _scratch(spark):
    return (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()).rstrip("/") + "/" + next(tempfile._get_candidate_names())


def csv_round_trip(spark, d):
    path, df = _scratch(spark), table(spark, d, "customer")
    files.write_csv(df, path)
    return files.read_csv(spark, path, df.schema)


def tbl_round_trip(spark, d):
    path, df = _scratch(spark), table(spark, d, "supplier")
    files.write_tbl(df, path)
    return files.read_tbl(spark, path, df.schema)


def _doubled(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pc.multiply(batch.column(1), 2.0)], ["s_suppkey", "doubled"])


def python_block(spark, d):
    """A block takes a table by name and leaves one by name; what it does to rows runs in Arrow batches."""
    run = Evaluator(spark, lambda name: table(spark, d, name))
    block = lambda _, supplier: {"out": blocks.map_batches(supplier.select("s_suppkey", "s_acctbal"), _doubled, "s_suppkey bigint, doubled double")}
    run(Node("python", block, ("supplier", Node("table", "supplier"))))
    return run(Node("get_python_var", "out"))


QUERIES["csv_round_trip"] = (csv_round_trip, "SELECT * FROM customer")
QUERIES["tbl_round_trip"] = (tbl_round_trip, "SELECT * FROM supplier")
QUERIES["python_block_map"] = (python_block, "SELECT s_suppkey, s_acctbal * 2 AS doubled FROM supplier")
QUERIES["select_column_pair"] = (lambda s, d: trips(s, d).where(F.col("a") != F.col("b")).select("id"), f"WITH {TRIPS} SELECT id FROM trips WHERE a <> b")
