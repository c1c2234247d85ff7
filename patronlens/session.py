"""Session settings: what a local test run sets, and what a cluster run should ask for."""

from __future__ import annotations

from pyspark.sql import SparkSession

TARGET_PARTITION_BYTES = 128 * 1024 * 1024

COMMON_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def cluster_settings(input_bytes: int, total_cores: int) -> dict[str, str]:
    """Settings for ``spark-submit``.

    The shuffle starts with enough partitions for about 128 MB each (adaptive execution
    merges what turns out small) and never fewer than two waves of tasks.
    """
    partitions = max(2 * total_cores, -(-input_bytes // TARGET_PARTITION_BYTES))
    return COMMON_SETTINGS | {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(2 * TARGET_PARTITION_BYTES),
    }


def local_session(scratch: str, cores: int | str = "*", app: str = "patronlens") -> SparkSession:
    """One-machine session for tests and the bench, staging in ``scratch``; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", scratch)
    )
    for key, value in COMMON_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
