"""Moments of feature columns per group, by the summaries of Spark ML, and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.operators.features import fit_scaler, scale_features

# Sums in one aggregate; beyond 100 fields Spark generates no code for it.
SUMS_AT_ONCE = 80


def points_of(df: DataFrame, features: Sequence[str] | str) -> DataFrame:
    """``df`` with the features as vector column ``point``; a single name is a vector column already."""
    if isinstance(features, str):
        return df.withColumn("point", F.col(features))
    return VectorAssembler(inputCols=list(features), outputCol="point").transform(df)


def gap_between(point: Column, center: Column) -> Column:
    """Euclidean distance of two array columns."""
    squares = F.zip_with(point, center, lambda x, c: (x - c) * (x - c))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def cluster_moments(df: DataFrame, features: Sequence[str] | str, label: str = "segment_id") -> DataFrame:
    """Size, means and population variances of the features, one row per cluster.

    The ML summary keeps one vector buffer per cluster; two aggregate functions per feature would
    outgrow what a generated method can hold.
    """
    grouped = (
        points_of(df, features)
        .groupBy(F.col(label).alias("label"))
        .agg(
            F.count("*").alias("n"),
            Summarizer.metrics("mean", "variance").summary(F.col("point")).alias("summary"),
        )
    )
    unbiased = F.col("n") - 1
    return grouped.select(
        "label",
        "n",
        vector_to_array("summary.mean").alias("center"),
        F.transform(vector_to_array("summary.variance"), lambda v: v * unbiased / F.col("n")).alias("variances"),
    )


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of features, in long form; the matrix has features**2 cells.

    Rows that miss a feature are left out. A feature that does not vary has no correlation and gives null.
    The products of the scaled features are summed by plain aggregates, ``SUMS_AT_ONCE`` pairs per pass.
    """
    names = list(features)
    whole = df.select(*[F.col(n).cast("double").alias(n) for n in names]).dropna()
    stats = fit_scaler(whole, names)
    scaled = scale_features(whole, stats)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[:i]]
    found: dict[tuple[str, str], float | None] = {}
    for start in range(0, len(pairs), SUMS_AT_ONCE):
        some = pairs[start : start + SUMS_AT_ONCE]
        sums = [F.sum(F.col(a) * F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(some)]
        *values, rows = scaled.agg(*sums, F.count("*").alias("rows")).first()
        for pair, value in zip(some, values):
            found[pair] = value / rows if value is not None and all(stats.deviations[x] for x in pair) else None
    cells = [(a, b, 1.0 if a == b else found.get((a, b), found.get((b, a)))) for a in names for b in names]
    return df.sparkSession.createDataFrame(cells, "feature_a string, feature_b string, correlation double")
