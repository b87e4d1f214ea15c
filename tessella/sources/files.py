"""Readers and writers, and the storage commands: create, load, drop, fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_KINDS = {"int": T.IntegerType, "bigint": T.LongType, "double": T.DoubleType, "string": T.StringType, "date": T.DateType, "boolean": T.BooleanType, "float": T.FloatType}
_NAMES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date"}

#: Columns of the eight benchmark tables in the pipe-separated files that the public generator writes.
TBL_COLUMNS = {
    "region": "r_regionkey int, r_name string, r_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "part": "p_partkey bigint, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice double, p_comment string",
    "supplier": "s_suppkey bigint, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal double, s_comment string",
    "partsupp": "ps_partkey bigint, ps_suppkey bigint, ps_availqty int, ps_supplycost double, ps_comment string",
    "customer": "c_custkey bigint, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal double, c_mktsegment string, c_comment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
}


def schema(columns: dict[str, str]) -> T.StructType:
    """A schema from names and types: int, bigint, double, float, string, date, boolean, or their SQL names."""
    out = T.StructType()
    for name, kind in columns.items():
        kind = _NAMES.get(kind.upper(), kind.lower())
        if kind not in _KINDS:
            raise ValueError(f"unknown type {kind!r} of {name!r}")
        out.add(name, _KINDS[kind]())
    return out


def read_csv(spark: SparkSession, path: str, columns: T.StructType | str, header: bool = True) -> DataFrame:
    """CSV with a given schema, so that no pass over the data is spent on guessing."""
    return spark.read.csv(path, schema=columns, header=header, mode="FAILFAST")


def read_tbl(spark: SparkSession, path: str, columns: T.StructType | str) -> DataFrame:
    """Pipe-separated files whose lines end in a separator. Values that do not parse, and lines of fewer or more fields, fail the read."""
    from pyspark.sql import functions as F

    ddl = columns if isinstance(columns, T.StructType) else T.StructType.fromDDL(columns)
    trailing = T.StructType([*ddl.fields, T.StructField("__end", T.StringType())])
    return spark.read.csv(path, schema=trailing, sep="|", header=False, mode="FAILFAST", columnNameOfCorruptRecord="__corrupt").where(
        F.when(F.col("__end").isNull() | (F.col("__end") == ""), F.lit(True)).otherwise(F.raise_error(F.lit("a line has more fields than columns")).cast("boolean"))
    ).drop("__end")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, driver: str | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table of a database; ``partition`` is (column, low, high, number), without which one task reads it all."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("driver", driver) if driver else reader
    if partition:
        for key, value in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition, strict=True):
            reader = reader.option(key, value)
    return reader.load()


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "error") -> None:
    df.write.csv(path, header=header, mode=mode)


def write_tbl(df: DataFrame, path: str, mode: str = "error") -> None:
    """Pipe-separated lines that end in a separator."""
    from pyspark.sql import functions as F

    df.withColumn("__end", F.lit("")).write.csv(path, sep="|", header=False, mode=mode, emptyValue="")


def write_parquet(df: DataFrame, path: str, mode: str = "error", partition_by: list[str] | None = None) -> None:
    df.write.parquet(path, mode=mode, partitionBy=partition_by)


def write_columns(df: DataFrame, folder: str, keys: list[str], mode: str = "error") -> None:
    """Each column beside the keys in a folder of its own."""
    for c in (c for c in df.columns if c not in keys):
        df.select(*keys, c).write.parquet(f"{folder}/{c}", mode=mode)


class Storage:
    """Named tables: created by their columns, loaded from files or rows, fetched, dropped. They are temporary views, so any SQL sees them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.columns, self.settings, self.keys = spark, {}, {}, {}

    def create(self, name: str, **columns: str) -> None:
        """Without types, those of the data are taken as it is loaded."""
        self.columns[name] = columns
        if columns:
            self.spark.createDataFrame([], schema(columns)).createOrReplaceTempView(name)

    def load(self, name: str, path: str) -> DataFrame:
        """From .tbl, .csv or Parquet, by the path's ending."""
        if name not in self.columns:
            raise ValueError(f"no table {name!r}")
        kinds = schema(self.columns[name]) if self.columns[name] else None
        if path.endswith(".tbl"):
            df = read_tbl(self.spark, path, kinds or TBL_COLUMNS[name])
        elif path.endswith(".csv"):
            df = read_csv(self.spark, path, kinds) if kinds else self.spark.read.csv(path, header=True, inferSchema=True)
        else:
            df = self.spark.read.parquet(path)
        df.createOrReplaceTempView(name)
        return df

    def load_rows(self, name: str, data: dict[str, list]) -> DataFrame:
        """From columns in memory."""
        if name not in self.columns:
            raise ValueError(f"no table {name!r}")
        import pyarrow as pa

        df = self.spark.createDataFrame(pa.table(data))
        df.createOrReplaceTempView(name)
        return df

    def fetch(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def drop(self, name: str) -> bool:
        self.columns.pop(name, None)
        self.keys.pop(name, None)
        return self.spark.catalog.dropTempView(name)

    def constrain(self, name: str, primary: tuple[str, ...] = (), foreign: dict[str, tuple[str, str]] | None = None) -> None:
        """Keys are noted and not enforced."""
        self.keys[name] = {"primary": primary, "foreign": foreign or {}}

    def violations(self, name: str) -> DataFrame:
        """Rows of a noted primary key that repeat."""
        from pyspark.sql import functions as F

        key = list(self.keys[name]["primary"])
        return self.fetch(name).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    #: Settings that have a counterpart.
    SETTINGS = {"FileLoadingBlockSize": "spark.sql.files.maxPartitionBytes", "OutputBatchRows": "spark.sql.parquet.columnarReaderBatchSize", "ArrowBatchRows": "spark.sql.execution.arrow.maxRecordsPerBatch"}

    def set(self, name: str, value: object) -> None:
        if name not in self.SETTINGS:
            raise ValueError(f"unknown setting {name!r}: expected one of {', '.join(self.SETTINGS)}")
        self.spark.conf.set(self.SETTINGS[name], str(value))
        self.settings[name] = value
