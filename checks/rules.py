"""The rules behind labels as SQL text, written apart from the library; answers of models are held against them.

``{0}`` is the number that a rule reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits and names.
CLV_SEGMENT = """CASE WHEN {0} < 2000 THEN 'Low Value' WHEN {0} < 5000 THEN 'Medium Value'
  WHEN {0} < 10000 THEN 'High Value' ELSE 'Premium Value' END"""
CONFIDENCE = "CASE WHEN {0} > 180 THEN 'high' ELSE 'medium' END"
CHURN = "CASE WHEN {0} >= 0.5 THEN 1 ELSE 0 END"
RISK_REQUEST = """CASE WHEN {0} < 0.25 THEN 'Low Risk' WHEN {0} < 0.5 THEN 'Medium Risk'
  WHEN {0} < 0.75 THEN 'High Risk' ELSE 'Critical Risk' END"""
RISK_BATCH = """CASE WHEN {0} > 0 AND {0} <= 0.25 THEN 'Low Risk' WHEN {0} > 0.25 AND {0} <= 0.5 THEN 'Medium Risk'
  WHEN {0} > 0.5 AND {0} <= 0.75 THEN 'High Risk' WHEN {0} > 0.75 AND {0} <= 1 THEN 'Critical Risk' END"""
SEGMENT = """CASE {0} WHEN 0 THEN 'High-Value Engaged' WHEN 1 THEN 'Loyal Regulars' WHEN 2 THEN 'At-Risk'
  WHEN 3 THEN 'New Prospects' WHEN 4 THEN 'Dormant' END"""


def follows(label: str, rule: str, number: str, digits: int | None = None) -> Column:
    """Whether ``label`` is what ``rule`` says of ``number``, or of one that rounds to it at so many digits."""
    steps = [0.0] if digits is None else [-0.5 * 10**-digits, 0.0, 0.5 * 10**-digits]
    said = [rule.format(number if not step else f"({number} + ({step:.10f}D))") for step in steps]
    return F.expr(" OR ".join(f"{label} <=> ({s})" for s in said))


def answer_facts(answers: DataFrame) -> DataFrame:
    """Every nested answer held against the numbers in it."""
    value, chance, segment = "clv.customer_lifetime_value", "churn.churn_probability", "segment.segment_id"
    return answers.select(
        "customer_id",
        (F.expr(f"{value} >= 0") & follows("clv.clv_segment", CLV_SEGMENT, value, 2)).alias("clv_fits"),
        (F.expr(f"{chance} BETWEEN 0 AND 1") & follows("churn.churn_prediction", CHURN, chance, 4)).alias("churn_fits"),
        follows("churn.risk_category", RISK_REQUEST, chance, 4).alias("risk_fits"),
        (F.expr("segment.distance_to_center >= 0") & follows("segment.segment_name", SEGMENT, segment)).alias("segment_fits"),
        F.size("churn.top_risk_factors").alias("factors"),
        F.size("segment.recommended_actions").alias("actions"),
        F.col("clv.confidence").alias("confidence"),
    )


def dashboard_facts(scored: DataFrame) -> DataFrame:
    """Every scored customer with its labels held against its numbers."""
    return scored.select(
        "customer_id",
        "account_type",
        (F.col("predicted_clv") >= 0).alias("not_negative"),
        F.col("churn_probability").between(0, 1).alias("in_range"),
        follows("risk_category", RISK_BATCH, "churn_probability").alias("risk_fits"),
        follows("segment_name", SEGMENT, "segment_id").alias("named"),
    )


def ranked_importances(spark: SparkSession, pipeline) -> DataFrame:
    """``place`` from 0, ``feature, importance`` of fitted trees: their own vector beside the inputs of the assembler."""
    names = [n for s in pipeline.stages if s.hasParam("inputCols") for n in s.getOrDefault("inputCols")]
    rows = [(n, float(v)) for n, v in zip(names, pipeline.stages[-1].featureImportances.toArray(), strict=True)]
    raw = spark.createDataFrame(rows, "feature string, importance double")
    # One row per feature.
    ranked = "row_number() OVER (PARTITION BY 1 ORDER BY importance DESC, feature) - 1"
    return raw.selectExpr(f"CAST({ranked} AS BIGINT) AS place", "feature", "importance")


def factor_facts(factors: DataFrame, ranked: DataFrame) -> DataFrame:
    """``place, same`` of every row of ``factors`` (place, feature, importance): whether it is what the trees say."""
    same = F.expr("f.feature <=> t.feature AND f.importance <=> t.importance")
    return factors.alias("f").join(ranked.alias("t"), "place", "left").select("place", same.alias("same"))
