"""The scored customer table behind the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.operators.features import FeatureStats, add_features, encode_account_type, fill_features
from patronlens.operators.labels import risk_category_batch
from patronlens.plans.scoring import ModelSet


def scored_customers(customers: DataFrame, stats: FeatureStats, models: ModelSet) -> DataFrame:
    """Customer columns with predicted value, churn probability, risk, segment and its name.

    The original row travels along as a struct, so nothing has to be joined back.
    """
    carried = customers.withColumn("customer", F.struct(*customers.columns))
    features = encode_account_type(add_features(carried, stats), stats).select("customer", *models.clv.features)
    predictions = ["predicted_clv", "churn_probability", "segment_id", "segment_name"]
    predicted = models.transform(fill_features(features, stats.fills)).withColumn("risk_category", risk_category_batch())
    return predicted.select("customer.*", *predictions, "risk_category")
