"""Intermediate tables in the folder that driver and executors share.

A long plan is cut by writing Parquet to ``spark.checkpoint.dir`` and reading it
again: the rows survive the loss of any executor, and later jobs do not repeat
the work.  ``localCheckpoint`` is never used.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
RELEASE_S = 4.0
_released = 0.0


def scratch_root(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only for local masters without the setting."""
    root = spark.conf.get(KEY, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {KEY} to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="fusegrid-")
    spark.conf.set(KEY, f"file://{root}")
    return f"file://{root}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, every RELEASE_S seconds at most.

    Spark's cleaner follows the driver's garbage collection, which a driver with a roomy heap seldom runs.
    """
    global _released
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is None or time.monotonic() - _released < RELEASE_S:
        return
    for _ in range(2):  # the first lets go of what Python held, the second finds it
        gc.collect()
        jvm.System.gc()
        time.sleep(0.1)
    _released = time.monotonic()


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, in a folder for each value of ``by``, and return a scan of it."""
    spark = df.sparkSession
    release(spark)
    path = f"{scratch_root(spark)}/fusegrid/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Empty tables of ``materialize`` that nothing will read again; results still to be computed must not depend on them."""
    for table in tables:
        table.sparkSession.range(0).write.mode("overwrite").parquet(table.scratch_path)
