"""Shared scratch tables and size-checked broadcasts.

Everything an operator needs twice is written once as Parquet below the folder
named by ``spark.checkpoint.dir``, so a lost executor costs a re-read and not a
recomputation.  A folder is chosen here only where that setting is absent,
which happens in tests.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; a temporary one only where all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="termloom-"))
            atexit.register(_remove, _fallback[0])
        found = "file://" + _fallback[0]
    return found.rstrip("/")


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/termloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that read them are then void."""
    drop(spark, _root(spark))


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no pending result reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def give_back(spark: SparkSession) -> None:
    """Have every executor collect its garbage, so that its heap shrinks to what is in use.

    A heap grows to its limit under one heavy stage and keeps that size, while
    the Python workers of the next stage need the memory.  Each task of a small
    job calls the collector of its own executor.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


#: Bytes of a row group, which a writing task holds in memory.
ROW_GROUP = 16 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back with its schema."""
    path = new_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._termloom_path = path
    return out


def forget(df: DataFrame) -> None:
    drop(df.sparkSession, df._termloom_path)


#: Rows of narrow tables for each task that writes them.
TASK_ROWS = 20_000


def merged(df: DataFrame, rows: int) -> DataFrame:
    """Join the partitions behind the last shuffle where ``rows``, the most there can be, are few.

    Spark itself does so where adaptive coalescing is on; without it each of hundreds of nearly
    empty partitions is a task and a file. No fewer than one task a core are left, and every
    ``TASK_ROWS`` rows have one, so large tables keep all partitions.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS + 1))


#: Most rows, and most bytes in them, that are ever broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def _bytes(col: Column, kind: DataType) -> Column:
    """About the bytes that a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        out = F.octet_length(col).cast("long")
    elif isinstance(kind, ArrayType):
        plain = not isinstance(kind.elementType, (StringType, BinaryType, ArrayType, MapType, StructType))
        out = F.size(col) * F.lit(8).cast("long") if plain else F.aggregate(col, F.lit(0).cast("long"), lambda a, x: a + _bytes(x, kind.elementType))
    elif isinstance(kind, MapType):
        out = _bytes(F.map_keys(col), ArrayType(kind.keyType)) + _bytes(F.map_values(col), ArrayType(kind.valueType))
    elif isinstance(kind, StructType):
        out = sum((_bytes(col[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    else:
        return F.lit(8).cast("long")
    return F.coalesce(out, F.lit(0).cast("long")) + 8


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring rows and bytes of all columns; larger inputs keep a shuffle join."""
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
    got = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if got[0] <= rows and (got[1] or 0) <= most else df
