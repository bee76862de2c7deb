"""Tables that a query needs more than once, written where all executors can read them.

They lie below the folder named by ``spark.checkpoint.dir``, so a lost executor
costs a re-read.  A temporary folder is used only where that is unset and all
runs in one process.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: list[str] = []


def folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _temporary:
            _temporary.append(tempfile.mkdtemp(prefix="termloom-core-"))
            atexit.register(shutil.rmtree, _temporary[0], ignore_errors=True)
        found = "file://" + _temporary[0]
    return f"{found.rstrip('/')}/termloom-core/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back with its schema."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
