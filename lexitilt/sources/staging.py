"""Stage boundaries inside a run: results used more than once are written once."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one in local mode only."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="lexitilt-")
        context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps start from the files, so a lost executor costs a re-read, not the
    whole lineage; they read only the columns they use, and the planner knows the
    size it is joining.
    """
    path = f"{staging_dir(df.sparkSession).rstrip('/')}/lexitilt/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(staged: DataFrame) -> None:
    """Gives back the disk of a frame of ``materialize`` that nothing reads any more."""
    files = staged.inputFiles()
    if files:
        staged.sparkSession.createDataFrame([], staged.schema).write.mode("overwrite").parquet(
            files[0].rsplit("/", 1)[0])


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder for as long as something reads it: Spark removes the files
    with the frame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on."""
    folder = staging_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def released(df: DataFrame) -> DataFrame:
    """``df``, after a collection of the driver's garbage, which lets Spark remove the shuffle files
    of steps already written. The driver's JVM hears of what Python let go of a moment later."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        df.sparkSession.sparkContext._jvm.System.gc()
    time.sleep(0.3)  # files go a moment after the collection
    return df
