"""Business labels on predictions: value segments, risk, segments with names and actions."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens import schema
from patronlens.functions import cut, exact_quantiles, present, qcut_label, quantile_edges
from patronlens.functions.windows import over_few_rows
from patronlens.operators.moments import cluster_moments


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def percentile_threshold(staged: DataFrame, column: str, percentile: float) -> float | None:
    """Exact percentile (0..100) of one column."""
    return exact_quantiles(staged, {column: [Fraction(str(percentile)) / 100]})[column][0]


# --- lifetime value -----------------------------------------------------------------------------


def add_clv_quartile_segment(staged: DataFrame, column: str = "predicted_clv") -> DataFrame:
    """Value segment by quartile of the predictions."""
    edges = quantile_edges(staged, {column: len(schema.CLV_SEGMENTS)})[column]
    return staged.withColumn("clv_segment", qcut_label(column, edges, schema.CLV_SEGMENTS))


def add_high_value_flag(
    staged: DataFrame, percentile: float = schema.HIGH_VALUE_PERCENTILE, column: str = "predicted_clv"
) -> DataFrame:
    """True at or above the percentile of the predictions."""
    threshold = percentile_threshold(staged, column, percentile)
    return staged.withColumn("is_high_value", present(column) >= F.lit(threshold).cast("double"))


def clv_distribution(staged: DataFrame, column: str = "predicted_clv") -> DataFrame:
    """Mean, median, population deviation, extremes, quartiles and total."""
    low, middle, high = exact_quantiles(staged, {column: ["0.25", "0.5", "0.75"]})[column]
    return staged.agg(
        F.avg(column).alias("mean_clv"),
        F.lit(middle).cast("double").alias("median_clv"),
        F.stddev_pop(column).alias("std_clv"),
        F.min(column).alias("min_clv"),
        F.max(column).alias("max_clv"),
        F.lit(low).cast("double").alias("q25_clv"),
        F.lit(high).cast("double").alias("q75_clv"),
        F.sum(column).alias("total_predicted_value"),
    )


def clv_fixed_segment(clv: Column | str = "predicted_clv") -> Column:
    """Value segment by fixed limits; a value on a limit belongs to the higher segment."""
    c = _col(clv)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for limit, label in zip(schema.CLV_SEGMENT_LIMITS, schema.CLV_SEGMENTS):
        out = out.when(c < limit, label)
    return out.otherwise(schema.CLV_SEGMENTS[-1])


def confidence(tenure: Column | str = "tenure_days") -> Column:
    return F.when(_col(tenure) > 180, "high").otherwise("medium")


# --- churn --------------------------------------------------------------------------------------


def churn_prediction(probability: Column | str = "churn_probability") -> Column:
    p = _col(probability)
    return F.when(p >= schema.CHURN_THRESHOLD, 1).when(p.isNotNull(), 0)


def risk_category_batch(probability: Column | str = "churn_probability") -> Column:
    """Right-closed quarters; a probability of exactly 0 has no category."""
    return cut(probability, schema.RISK_BINS, schema.RISK_LABELS)


def risk_category_request(probability: Column | str = "churn_probability") -> Column:
    """Left-closed quarters; 0 is low and 0.25 is medium."""
    p = _col(probability)
    out = F.when(p.isNull(), F.lit(None).cast("string"))
    for limit, label in zip(schema.RISK_BINS[1:-1], schema.RISK_LABELS):
        out = out.when(p < limit, label)
    return out.otherwise(schema.RISK_LABELS[-1])


def add_churn_risk(df: DataFrame, probability: str = "churn_probability") -> DataFrame:
    return df.withColumns(
        {"churn_prediction": churn_prediction(probability), "risk_category": risk_category_batch(probability)}
    )


def at_risk_flag(
    probability: Column | str = "churn_probability", threshold: float = schema.AT_RISK_THRESHOLD
) -> Column:
    return _col(probability) >= threshold


def risk_distribution(df: DataFrame, probability: str = "churn_probability") -> DataFrame:
    """Customers per category, predicted churners, mean probability."""
    category = risk_category_batch(probability)
    counts = [
        F.count_if(category == label).alias(label.lower().replace(" ", "_")) for label in schema.RISK_LABELS
    ]
    return df.agg(
        *counts,
        F.count_if(churn_prediction(probability) == 1).alias("total_at_risk"),
        F.avg(probability).alias("avg_churn_probability"),
    )


# --- segments -----------------------------------------------------------------------------------


def distance(columns: Sequence[Column], center: Sequence[float]) -> Column:
    """Euclidean distance of the row to a fixed point."""
    gaps = [c - F.lit(float(x)) for c, x in zip(columns, center, strict=True)]
    squares = [gap * gap for gap in gaps]
    return F.sqrt(sum(squares[1:], squares[0]))


def assign_segment(df: DataFrame, columns: Sequence[Column], centers: Sequence[Sequence[float]]) -> DataFrame:
    """Nearest centre as ``segment_id`` (the lower id on a tie) and ``distance_to_center``."""
    ready = df.withColumn("center_distances", F.array(*[distance(columns, center) for center in centers]))
    nearest = F.array_min("center_distances")
    return ready.withColumns(
        {
            "segment_id": (F.array_position("center_distances", nearest) - 1).cast("int"),
            "distance_to_center": nearest,
        }
    )


def segment_name(segment_id: Column | str = "segment_id") -> Column:
    """Name of the segment, ``Segment <id>`` for an id without one."""
    c = _col(segment_id)
    names = F.array(*[F.lit(n) for n in schema.SEGMENT_NAMES])
    return F.coalesce(F.get(names, c), F.concat(F.lit("Segment "), c.cast("string")))


def recommended_actions(segment_id: Column | str = "segment_id") -> Column:
    """Three actions for a known segment, one general text otherwise."""
    texts = F.array(*[F.array(*[F.lit(t) for t in actions]) for actions in schema.SEGMENT_ACTIONS])
    default = F.array(*[F.lit(t) for t in schema.DEFAULT_ACTIONS])
    return F.coalesce(F.get(texts, _col(segment_id)), default)


def segment_profiles(df: DataFrame, segments: int = len(schema.SEGMENT_NAMES)) -> DataFrame:
    """Size and share in percent of every segment, empty ones included; rows with an unknown or no id have lines of their own."""
    listed = df.sparkSession.range(segments).select(F.col("id").cast("int").alias("segment_id"), F.lit(0).alias("one"))
    counted = listed.unionByName(df.select(F.col("segment_id").cast("int").alias("segment_id"), F.lit(1).alias("one")))
    filled = counted.groupBy("segment_id").agg(F.sum("one").alias("size"))
    total = F.sum("size").over(over_few_rows())
    return filled.withColumn("percentage", F.coalesce(F.try_divide(F.col("size") * 100.0, total), F.lit(0.0)))


def segment_characteristics(df: DataFrame, features: Sequence[str], vector: str | None = None) -> DataFrame:
    """Size, share, mean and population deviation of each feature, one row per segment.

    With ``vector`` the features are the parts of that column.
    """
    moments = cluster_moments(df, vector or features)
    share = F.col("n") * 100.0 / F.sum("n").over(over_few_rows())
    stats = []
    for i, name in enumerate(features):
        stats.append(F.col("center")[i].alias(f"{name}_mean"))
        stats.append(F.sqrt(F.col("variances")[i]).alias(f"{name}_std"))
    return moments.select(F.col("label").alias("segment_id"), F.col("n").alias("size"), *stats, share.alias("percentage"))
