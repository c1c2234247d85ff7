"""Folders that readers see whole or not at all.

A writer fills a folder that nobody reads yet and publishes it last, by creating an empty marker under ``_published`` whose
name is a number and the folder. Creating an empty file is one step on HDFS and on object stores, nothing that is published is
overwritten, and a writer that dies half way leaves a folder without a marker. Spark's readers skip names that begin with ``_``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from patronlens.staging import drop_path

MARKERS = "_published"


def _markers(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{MARKERS}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def is_versioned(spark: SparkSession, root: str) -> bool:
    """Whether something was ever published under ``root``, or :func:`prepare` was called for it."""
    files, path = _markers(spark, root)
    return files.exists(path)


def prepare(spark: SparkSession, root: str) -> None:
    """Readers see ``root`` as an empty set of versions from now on."""
    files, path = _markers(spark, root)
    files.mkdirs(path)


def published(spark: SparkSession, root: str) -> dict[int, str]:
    """Path of every published folder by number, ascending; of two with one number the greater name holds."""
    files, path = _markers(spark, root)
    if not files.exists(path):
        return {}
    names = sorted(status.getPath().getName() for status in files.listStatus(path))
    split = (name.split("-", 1) for name in names)
    return {int(number): f"{root}/{folder}" for number, folder in split}


def publish(spark: SparkSession, root: str, folder: str, number: int | None = None) -> int:
    """Make ``root/folder`` visible; without a number it becomes the next one."""
    if number is None:
        number = max(published(spark, root), default=-1) + 1
    files, path = _markers(spark, root)
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{number:020d}-{folder}")
    files.create(marker, False).close()
    return number


def current(spark: SparkSession, root: str, number: int | None = None) -> str:
    """Path of the newest version, or of the one asked for."""
    known = published(spark, root)
    wanted = max(known, default=None) if number is None else number
    if wanted not in known:
        raise ValueError(f"{root} has no published version" + ("" if number is None else f" {number}"))
    return known[wanted]


def prune(spark: SparkSession, root: str, keep: int) -> None:
    """Withdraw and delete all but the newest ``keep`` versions; folders that were never published stay."""
    files, path = _markers(spark, root)
    known = published(spark, root)
    for number in sorted(known)[: max(len(known) - keep, 0)]:
        folder = known[number].rpartition("/")[2]
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{number:020d}-{folder}"), False)
        drop_path(spark, known[number])
