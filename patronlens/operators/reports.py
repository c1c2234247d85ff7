"""Data sets behind the dashboard charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.functions import round_half_even
from patronlens.functions.windows import over_few_rows
from patronlens.operators.labels import percentile_threshold, segment_name


def kpis(staged: DataFrame) -> DataFrame:
    """Customers, mean predicted value, share above 0.5 churn, customers above the 75th percentile (both strict)."""
    threshold = F.lit(percentile_threshold(staged, "predicted_clv", 75)).cast("double")
    return staged.agg(
        F.count("*").alias("total_customers"),
        F.avg("predicted_clv").alias("avg_clv"),
        F.avg((F.col("churn_probability") > 0.5).cast("int")).alias("churn_rate"),
        F.count_if(F.col("predicted_clv") > threshold).alias("high_value_customers"),
    )


def histogram(staged: DataFrame, column: str = "predicted_clv", bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed; empty bins are not listed."""
    low, high = staged.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        low = high = 0.0
    width = (high - low) / bins
    place = F.floor((F.col(column) - low) / width) if width else F.lit(0)
    number = F.when(place >= bins, bins - 1).otherwise(place).cast("int")
    counted = staged.filter(F.col(column).isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("customers"))
    return counted.select("bin", (F.col("bin") * width + low).alias("bin_start"), "customers")


def risk_counts(df: DataFrame) -> DataFrame:
    """Customers per risk category, largest first; rows without a category are left out."""
    return (
        df.filter(F.col("risk_category").isNotNull())
        .groupBy("risk_category")
        .agg(F.count("*").alias("customers"))
        .orderBy(F.desc("customers"), "risk_category")
    )


def segment_counts(df: DataFrame) -> DataFrame:
    """Customers and share in percent per segment name, largest first."""
    counted = df.groupBy(segment_name().alias("segment_name")).agg(F.count("*").alias("customers"))
    share = F.col("customers") * 100.0 / F.sum("customers").over(over_few_rows())
    return counted.withColumn("percentage", share).orderBy(F.desc("customers"), "segment_name")


def top_importance(importance: DataFrame, top: int = 10) -> DataFrame:
    """The most important features in ascending order, as a bar chart draws them."""
    return importance.orderBy(F.desc("importance"), "feature").limit(top).orderBy("importance", F.desc("feature"))


def _two_digits(value: Column) -> Column:
    return F.format_string("%.2f", round_half_even(value, 2))


def value_churn_points(df: DataFrame) -> DataFrame:
    """One point per customer with its hover text."""
    text = F.concat(
        F.lit("CLV: $"),
        _two_digits(F.col("predicted_clv")),
        F.lit("<br>Churn: "),
        _two_digits(F.col("churn_probability") * 100),
        F.lit("%"),
    )
    return df.select("customer_id", "predicted_clv", "churn_probability", text.alias("hover_text"))


def value_churn_grid(df: DataFrame, clv_step: float = 500.0, probability_step: float = 0.05) -> DataFrame:
    """The same cloud as counts per cell: its size does not grow with the customers."""
    return df.groupBy(
        F.floor(F.col("predicted_clv") / clv_step).alias("clv_cell"),
        F.floor(F.col("churn_probability") / probability_step).alias("churn_cell"),
    ).agg(F.count("*").alias("customers"))


def kpi_delta(df: DataFrame, value: str, delta: str) -> DataFrame:
    """Reference value of a KPI card: value minus change."""
    return df.withColumn("reference", F.col(value) - F.col(delta))


def period_series(df: DataFrame, time: str, value: str, unit: str = "month") -> DataFrame:
    """Rows and total value per period."""
    return (
        df.groupBy(F.date_trunc(unit, F.col(time)).cast("date").alias("period"))
        .agg(F.count("*").alias("rows"), F.sum(value).alias("value"))
        .orderBy("period")
    )


def series_with_change(series: DataFrame) -> DataFrame:
    """Change to the period before; ``series`` has one row per period."""
    previous = F.lag("value").over(over_few_rows().orderBy("period"))
    return series.withColumn("delta", F.col("value") - previous)


def segment_radar(characteristics: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean of each feature per segment in long form."""
    means = characteristics.select("segment_id", *[F.col(f"{f}_mean").alias(f) for f in features])
    return means.unpivot(["segment_id"], list(features), "feature", "value")


def customer_sample(df: DataFrame, rows: int = 10) -> DataFrame:
    """The first customers by id as the dashboard table shows them."""
    return (
        df.orderBy("customer_id")
        .limit(rows)
        .select(
            "customer_id",
            "account_type",
            F.concat(F.lit("$"), _two_digits(F.col("predicted_clv"))).alias("predicted_clv"),
            "risk_category",
            segment_name().alias("segment_name"),
        )
    )
