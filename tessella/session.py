"""Sessions and fixture tables."""

from __future__ import annotations

import os
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SCHEMAS: weakref.WeakKeyDictionary[SparkSession, dict[str, StructType]] = weakref.WeakKeyDictionary()

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def build(app: str = "tessella", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session: adaptive execution, UTC, ANSI arithmetic, shuffles as wide as there are cores. On a cluster, the given session is used as it is."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": str(cpus), "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table. Its schema is read from the files once a session; later reads need no job to find it out."""
    path = f"{sf_dir}/{name}.parquet"
    known = _SCHEMAS.setdefault(spark, {})
    if path in known:
        return spark.read.schema(known[path]).parquet(path)
    df = spark.read.parquet(path)
    known[path] = df.schema
    return df


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers tables as temporary views; nothing is read."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
