"""Tables read from a folder and tables written between steps, in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from patronlens.staging import new_path


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BATCH_ROWS = 1024


def limit_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch where the session has Spark's own number of them: texts are long, and a task holds several batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


_written: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession, *kept: str) -> Iterator[list[str]]:
    """Tables that are written inside the block go at its end, but for those whose paths the block adds to the list."""
    wanted = list(kept)
    _written.append([])
    try:
        yield wanted
    finally:
        forget(spark, *[path for path in _written.pop() if path not in wanted])


def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read back, and its path."""
    path = new_path(df.sparkSession, name)
    if _written:
        _written[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        target = hadoop.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
