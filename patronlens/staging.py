"""Tables written to the shared folder of ``spark.checkpoint.dir``.

A profile feeds several passes (fit, transform, models). Writing it once cuts the lineage to the
raw tables, survives the loss of executors, and gives later passes a columnar table with pruning
and real statistics, none of which an in-memory copy on the executors offers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows that are worth a task of their own.
ROWS_OF_TASK = 5_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; all executors must reach it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return folder.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Boosting cuts its lineage with RDD checkpoints, so the context needs the folder too."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/patronlens-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    return _write(df, name)[0]


def even_tasks(staged: DataFrame) -> int:
    """Into how many tasks the rows of a staged table are dealt: one per core, fewer for few rows.

    More would not be faster, and every task of every pass reports to the driver.
    """
    return min(staged.sparkSession.sparkContext.defaultParallelism, staged.count() // ROWS_OF_TASK + 1)


def spread(staged: DataFrame, *order_by: str) -> DataFrame:
    """The rows of a staged table dealt evenly over the cores, in the order of ``order_by`` inside each task.

    A staged table comes in as many parts as its last shuffle was merged to, and a file of one row group is read by one task: what
    passes over it hundreds of times would run on one or two cores. The order keeps samples the same on every run.
    """
    return staged.repartition(even_tasks(staged)).sortWithinPartitions(*order_by)


def storage_bytes(spark: SparkSession) -> int:
    """What all executors together can hold of persisted tables, in bytes."""
    held = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
    sizes = []
    while held.hasNext():
        sizes.append(held.next()._1())
    # On a cluster the driver is listed too, but holds no blocks of tasks; it is no larger than an executor.
    return sum(sizes) if len(sizes) == 1 else sum(sorted(sizes)[1:])


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A staged table that goes at the end of the block; nothing read from it may be left to compute."""
    table, path = _write(df, name)
    try:
        yield table
    finally:
        drop_path(df.sparkSession, path)


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application has staged; call it when the application ends."""
    drop_path(spark, application_folder(spark))
