"""Scoring of a stream of record files with Structured Streaming; stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from patronlens import schema, versions
from patronlens.plans.scoring import ModelSet, score_marked, write_scored


def read_record_stream(
    spark: SparkSession, path: str, file_format: str = "json", max_files_per_trigger: int = 1000
) -> DataFrame:
    """New record files as they arrive: JSON lines, or Parquet with the columns of ``schema.SCORING`` in their declared types.

    A line of JSON that is no record keeps its text for the quarantine; a Parquet file has no such rows.
    """
    reader = spark.readStream.schema(schema.SCORING_TEXT).option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.option("columnNameOfCorruptRecord", schema.UNREAD).format(file_format).load(path)


def score_stream(records: DataFrame, models: ModelSet, out: str, checkpoint: str) -> StreamingQuery:
    """Score all files present, then stop; run again to go on where it stopped.

    Each micro-batch fills its own folder and is published when it is whole: readers never see part of a batch. A batch that
    is repeated after a failure is skipped if it was published, else its folder is written anew.
    """
    versions.prepare(records.sparkSession, out)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"batch_id={batch_id}"
        if batch_id not in versions.published(spark, out):
            write_scored(score_marked(batch, models), f"{out}/{folder}")
            versions.publish(spark, out, folder, batch_id)

    return (
        records.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
