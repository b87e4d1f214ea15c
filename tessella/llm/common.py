"""Shared plumbing of the training-data operators: table access, durable cuts, code shipping."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]
#: Bytes of a table for which one like it has a file, and the files it has at least.
FILE_BYTES = 8 << 20
LEAST_FILES = 4
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, by Spark's own reader, so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quoted(name: str) -> str:
    """A column's name as one identifier, whatever letters it has."""
    return "`" + name.replace("`", "``") + "`"


def free_names(df: DataFrame, n: int) -> list[str]:
    """Names that no column of ``df`` has, in either case, and that none begins with."""
    taken, stem = [c.lower() for c in df.columns], "t_"
    while any(c.startswith(stem) for c in taken):
        stem += "x_"
    return [f"{stem}{k}_" for k in range(n)]


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tessella_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tessella-code-")
    target = Path(folder) / "tessella_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(_PACKAGE.rglob("*.py")):
            archive.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(str(target))
    context._tessella_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode, where that is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark.sparkContext, "_tessella_dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir: executors of a cluster do not see a temporary folder of the driver")
            folder = "file://" + tempfile.mkdtemp(prefix="tessella-shared-")
            spark.sparkContext._tessella_dir = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a path in any store that Hadoop's file systems reach; a stopped session leaves it."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the gateway is gone at exit when the session was stopped first
        return


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all: written beside its place and renamed."""
    jvm = spark.sparkContext._jvm
    where, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(beside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not store.rename(beside, where):
        raise FileExistsError(path)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store; none where it does not exist."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Files of shuffles go as soon as what they were made for is written; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str, like: DataFrame | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: its lineage ends there, and lost executors cost nothing.

    ``like`` is a table of about as many rows that was written before: the result then has a file for each
    ``FILE_BYTES`` of it and not for each partition. It only makes partitions fewer, and only after the last shuffle.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if like is not None:
        df = df.coalesce(min(1 << 20, max(LEAST_FILES, -(-input_bytes(like) // FILE_BYTES))))
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a plan, from file sizes; no job runs."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with the package shipped first, for columns of any name: Spark resolves them as identifiers there."""
    ship(df.sparkSession)
    names = df.columns
    if all(c.replace("_", "a").isalnum() for c in names):
        return df.mapInArrow(fn, schema)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(pa.RecordBatch.from_arrays(b.columns, names) for b in batches)

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(named, schema)


def learnable(doc_id: str = "doc_id"):
    """True for rows that models may learn from: crc32 of the id as text, modulo 3, is not 1."""
    return ~held_out(doc_id)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
