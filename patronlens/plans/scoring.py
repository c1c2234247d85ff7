"""Scoring of records by all three models at once: one table in, one nested response per row out."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens import schema, versions
from patronlens.functions import round_half_even
from patronlens.operators import labels
from patronlens.operators.clean import mark_violations
from patronlens.operators.models import ChurnModel, ClvModel, SegmentModel
from patronlens.operators.serving import serving_columns, serving_features
from patronlens.sources.sinks import write_parquet

ANSWERED, REJECTED = "answered", "rejected"


@dataclass(frozen=True)
class ModelSet:
    """The trained models of one run."""

    clv: ClvModel
    churn: ChurnModel
    segments: SegmentModel

    def save(self, path: str) -> None:
        self.clv.save(f"{path}/clv")
        self.churn.save(f"{path}/churn")
        self.segments.save(f"{path}/segments")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ModelSet:
        return cls(
            ClvModel.load(spark, f"{path}/clv"),
            ChurnModel.load(spark, f"{path}/churn"),
            SegmentModel.load(spark, f"{path}/segments"),
        )

    def info(self, spark: SparkSession) -> DataFrame:
        """One row per model."""
        first, second, third = (m.info(spark) for m in (self.clv, self.churn, self.segments))
        return first.unionByName(second).unionByName(third)

    def transform(self, features: DataFrame) -> DataFrame:
        """All prediction columns beside the features."""
        return self.segments.transform(self.churn.transform(self.clv.transform(features)))


def respond(predicted: DataFrame, top_factors: list[str], *kept: str) -> DataFrame:
    """Key, the nested answers ``clv``, ``churn`` and ``segment``, and columns that are kept beside them."""
    clv = F.struct(
        round_half_even("predicted_clv", 2).alias("customer_lifetime_value"),
        labels.clv_fixed_segment().alias("clv_segment"),
        labels.confidence().alias("confidence"),
    )
    churn = F.struct(
        round_half_even("churn_probability", 4).alias("churn_probability"),
        F.col("churn_prediction"),
        labels.risk_category_request().alias("risk_category"),
        F.array(*[F.lit(f) for f in top_factors]).alias("top_risk_factors"),
    )
    segment = F.struct(
        F.col("segment_id"),
        F.col("segment_name"),
        round_half_even("distance_to_center", 4).alias("distance_to_center"),
        labels.recommended_actions().alias("recommended_actions"),
    )
    return predicted.select("customer_id", clv.alias("clv"), churn.alias("churn"), segment.alias("segment"), *kept)


def top_factors(models: ModelSet) -> list[str]:
    return [name for name, _ in models.churn.importances()[:3]]


def score_records(records: DataFrame, models: ModelSet) -> DataFrame:
    """Nested answers for valid records; the features are computed once for all models."""
    return respond(models.transform(serving_features(records, models.clv.features)), top_factors(models))


def score_marked(records: DataFrame, models: ModelSet) -> DataFrame:
    """Every record once, in one narrow pass, as ``schema.SCORED``: answered, or rejected with its reasons."""
    marked = mark_violations(records)
    kept = marked.withColumns({"record": F.struct(*records.columns), "valid": F.size("violations") == 0})
    # Rejected records pass the models with zeros, and their answers are dropped.
    safe = [F.when(F.col("valid"), F.col(n)).otherwise(F.lit(0)).alias(n) for n in models.clv.features]
    features = kept.withColumns(serving_columns()).select("customer_id", "record", "violations", "valid", *safe)
    answers = respond(models.transform(features), top_factors(models), "record", "violations", "valid")
    answered = F.col("valid")
    return answers.select(
        "customer_id",
        *[F.when(answered, F.col(c)).alias(c) for c in ("clv", "churn", "segment")],
        F.when(~answered, F.col("record")).alias("record"),
        "violations",
        F.when(answered, ANSWERED).otherwise(REJECTED).alias("outcome"),
    )


def write_scored(scored: DataFrame, out: str) -> None:
    """One table, partitioned by outcome."""
    write_parquet(scored, out, ["outcome"])


def read_scored(spark: SparkSession, out: str) -> DataFrame:
    """A scored batch, or the published micro-batches of a stream."""
    if not versions.is_versioned(spark, out):
        return spark.read.schema(schema.SCORED).parquet(out)
    folders = versions.published(spark, out).values()
    reader = spark.read.schema(schema.SCORED).option("basePath", out)
    return reader.parquet(*folders) if folders else spark.createDataFrame([], schema.SCORED)


def answers(spark: SparkSession, out: str) -> DataFrame:
    """Nested answers of a scored batch or stream."""
    return read_scored(spark, out).filter(F.col("outcome") == ANSWERED).select("customer_id", "clv", "churn", "segment")


def quarantine(spark: SparkSession, out: str) -> DataFrame:
    """Rejected records as they came, with the rules they break."""
    return read_scored(spark, out).filter(F.col("outcome") == REJECTED).select("record.*", "violations")


def score_batch(records: DataFrame, models: ModelSet, out: str) -> DataFrame:
    """Validate, score and write a batch in one pass over it; returns one row with counts and seconds.

    The counts come from the footers of what was written. (Observed metrics would do without them, but a forest that was
    trained in the same session cannot be shipped to the executors any more once a session has observed something.)
    """
    started = time.monotonic()
    write_scored(score_marked(records, models), out)
    counts = dict(read_scored(records.sparkSession, out).groupBy("outcome").count().collect())
    row = (counts.get(ANSWERED, 0), counts.get(REJECTED, 0), round(time.monotonic() - started, 2))
    columns = "total_customers long, rejected_records long, processing_time_seconds double"
    return records.sparkSession.createDataFrame([row], columns)
