"""Input frames that the registered queries share, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens import schema
from patronlens.functions import clip, round_half_even
from patronlens.operators import labels
from patronlens.operators.profile import MAX_CLV, customer_id, customer_profile, profile_measures
from patronlens.sources.tables import read_table
from patronlens.staging import stage

# Fixed centres for the checks of the segment operators: recency, frequency and open rate, each 0..1.
CENTERS = [[0.05, 0.05, 0.6], [0.2, 0.02, 0.0], [1.0, 0.01, 0.0], [0.05, 0.02, 0.0], [0.6, 0.01, 0.1]]
CENTER_FEATURES = ["recency_share", "frequency_share", "open_share"]


def tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(read_table(spark, folder, name) for name in ("customer", "orders", "events"))


def measures(spark: SparkSession, folder: str) -> DataFrame:
    return profile_measures(*tables(spark, folder))


def profile(spark: SparkSession, folder: str) -> DataFrame:
    return customer_profile(*tables(spark, folder))


def staged_profile(spark: SparkSession, folder: str) -> DataFrame:
    return stage(profile(spark, folder), "profile")


def number() -> Column:
    """The number inside a customer id."""
    return F.substring("customer_id", 6, 20).cast("long")


def dirty_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile with defects: second copies, nulls, negative values, an unknown account type."""
    copies = F.when(number() % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    copied = profile(spark, folder).withColumn("copy", F.explode(copies))
    return copied.withColumns(
        {
            "avg_purchase_amount": F.col("avg_purchase_amount") + F.col("copy"),
            "monetary": F.when(number() % 17 != 0, F.col("monetary")),
            "support_tickets": F.when(number() % 13 != 0, F.col("support_tickets")),
            "age": F.when(number() % 97 == 0, -5).otherwise(F.col("age")),
            "tenure_days": F.when(number() % 89 == 0, -3).otherwise(F.col("tenure_days")),
            "email_open_rate": F.when(number() % 83 == 0, 100.5).otherwise(F.col("email_open_rate")),
            "account_type": F.when(number() % 101 == 0, "Gold").otherwise(F.col("account_type")),
        }
    )


def scored_by_rules(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`rule_scores` with the distances to all centres."""
    return _rule_scores(spark, folder)


def rule_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Truth and rule-based predictions per customer."""
    return _rule_scores(spark, folder).drop("center_distances")


def _rule_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Truth and rule-based predictions per customer, in the columns the models would fill."""
    m = measures(spark, folder)
    no_retention = F.col("avg_purchase_amount") * F.col("frequency") * 12 * (F.col("tenure_days") / 365)
    scored = m.select(
        customer_id().alias("customer_id"),
        "account_type",
        "tenure_days",
        "monetary",
        round_half_even(schema.CLV_TARGET).alias("true_clv"),
        round_half_even(clip(no_retention, 0.0, float(MAX_CLV))).alias("predicted_clv"),
        F.col("churned").alias("true_churn"),
        clip("behaviour_score", 0.0, 1.0).alias("churn_probability"),
        (F.col("recency") / 365).alias("recency_share"),
        (F.col("frequency") / 20).alias("frequency_share"),
        (F.col("email_open_rate") / 100).alias("open_share"),
    )
    scored = scored.withColumns(
        {"churn_prediction": labels.churn_prediction(), "risk_category": labels.risk_category_batch()}
    )
    return labels.assign_segment(scored, [F.col(c) for c in CENTER_FEATURES], CENTERS)


def staged_scores(spark: SparkSession, folder: str) -> DataFrame:
    return stage(rule_scores(spark, folder), "scores")
