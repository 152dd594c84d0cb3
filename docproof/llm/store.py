"""Cutting lineage: intermediate tables in the folder that spark.checkpoint.dir names.

The tables of a run lie under ``docproof-<application id>`` there. What an operator needs no longer
it deletes itself; what its result still reads can go when that has been written."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds between two calls of the driver's collectors.
TIDY = 10.0
#: Whether the shuffle files of an execution go when it ends: nothing reads those of a table that is written.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tidied = 0.0


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Only a driver that runs its tasks itself (tests) may
    do without one, and gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files and broadcasts of steps that are over: it acts on
    what the driver's collectors find, and a driver with little to do seldom collects."""
    global _tidied
    if time.monotonic() - _tidied > TIDY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _tidied = time.monotonic()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back, so that lost executors
    cost no recomputation of what led to it, and later reads see only the columns they need."""
    spark = df.sparkSession
    tidy(spark)
    path = f"{checkpoint_dir(spark)}/docproof-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    held = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANED) if held is None else spark.conf.set(CLEANED, held)
    table = spark.read.schema(df.schema).parquet(path)
    table._settled_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of :func:`settled` that nothing reads any more."""
    for table in tables:
        if path := vars(table).pop("_settled_at", None):
            context = table.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
