"""Model and business metrics as aggregates over a table of truth and prediction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens import schema
from patronlens.functions import safe_divide
from patronlens.functions.windows import over_few_rows
from patronlens.operators.labels import percentile_threshold
from patronlens.operators.moments import cluster_moments, gap_between, points_of
from patronlens.staging import staged

SILHOUETTE_ROWS = 20_000
TILE_ROWS = 512


def regression_metrics(df: DataFrame, truth: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    """rmse, mae, r2 and mape in percent over rows with truth and prediction; a true value of 0 has no relative error."""
    y = F.when(F.col(prediction).isNotNull(), F.col(truth))
    error = y - F.col(prediction)
    return df.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop(y))).alias("r2"),
        (F.avg(F.abs(F.try_divide(error, y))) * 100).alias("mape"),
    )


def confusion_counts(df: DataFrame, truth: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    y, p = F.col(truth), F.col(prediction)
    return df.agg(
        F.count_if((y == 0) & (p == 0)).alias("true_negatives"),
        F.count_if((y == 0) & (p == 1)).alias("false_positives"),
        F.count_if((y == 1) & (p == 0)).alias("false_negatives"),
        F.count_if((y == 1) & (p == 1)).alias("true_positives"),
    )


def classification_metrics(df: DataFrame, truth: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    """Accuracy, and precision, recall and f1 of class 1 (0 where undefined), with the confusion counts."""
    tn, fp, fn, tp = (
        F.col(c) for c in ("true_negatives", "false_positives", "false_negatives", "true_positives")
    )
    return confusion_counts(df, truth, prediction).select(
        safe_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        safe_divide(tp, tp + fp).alias("precision"),
        safe_divide(tp, tp + fn).alias("recall"),
        safe_divide(tp * 2, tp * 2 + fp + fn).alias("f1"),
        "true_negatives",
        "false_positives",
        "false_negatives",
        "true_positives",
    )


def auc_roc(
    staged: DataFrame, truth: str = "y_true", probability: str = "probability", ranges: int | None = None
) -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Rows collapse to one per distinct score. The scores are cut into ``ranges`` of similar size (as many as the
    shuffle has partitions), each range is accumulated on its own, and only the totals of the ranges are
    accumulated in one task. Where the cuts fall does not change the result.
    """
    count = ranges or int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    score = F.col(probability).cast("double")
    per_score = staged.groupBy(score.alias("score")).agg(
        F.count_if(F.col(truth) == 1).cast("double").alias("pos"),
        F.count_if(F.col(truth) == 0).cast("double").alias("neg"),
    )
    ordered = per_score.dropna(subset=["score"]).repartitionByRange(count, "score")
    ranged = ordered.withColumn("bucket", F.spark_partition_id())
    inside = Window.partitionBy("bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0.0))
    per_bucket = (
        ranged.withColumn("pairs", F.col("pos") * (below + F.col("neg") / 2))
        .groupBy("bucket")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("pairs").alias("pairs"))
    )
    # One row per range from here on.
    before = over_few_rows().orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("neg").over(before), F.lit(0.0))
    return per_bucket.withColumn("pairs", F.col("pairs") + F.col("pos") * lower).agg(
        F.try_divide(F.sum("pairs"), F.sum("pos") * F.sum("neg")).alias("auc_roc")
    )


def clv_accuracy(df: DataFrame, truth: str = "true_clv", prediction: str = "predicted_clv") -> DataFrame:
    """1 - mae / mean, and the mean absolute error itself."""
    mae = F.avg(F.abs(F.col(truth) - F.col(prediction)))
    return df.agg(
        (1 - F.try_divide(mae, F.avg(truth))).alias("clv_prediction_accuracy"),
        mae.alias("avg_clv_prediction_error"),
    )


def retention(
    df: DataFrame,
    truth: str = "true_churn",
    prediction: str = "churn_prediction",
    baseline: float = schema.RETENTION_BASELINE,
) -> DataFrame:
    """Actual and predicted retention and the lift over the baseline in percent."""
    predicted = 1 - F.avg(prediction)
    return df.agg(
        (1 - F.avg(truth)).alias("actual_retention_rate"),
        predicted.alias("predicted_retention_rate"),
        ((predicted - baseline) / baseline * 100).alias("retention_lift_pct"),
    )


def high_value_precision(
    staged: DataFrame,
    truth: str = "true_clv",
    prediction: str = "predicted_clv",
    percentile: float = schema.HIGH_VALUE_PERCENTILE,
) -> DataFrame:
    """Precision of the high-value class; truth and prediction are held against the percentile of the truth."""
    threshold = F.lit(percentile_threshold(staged, truth, percentile)).cast("double")
    return staged.agg(_high_value_precision(truth, prediction, threshold))


def _high_value_precision(truth: str, prediction: str, threshold: Column) -> Column:
    predicted = F.col(prediction) >= threshold
    hits = F.count_if(predicted & (F.col(truth) >= threshold))
    return safe_divide(hits, F.count_if(predicted)).alias("high_value_identification_precision")


def saved_revenue(df: DataFrame, truth: str = "true_clv", prediction: str = "churn_prediction") -> DataFrame:
    """Customers predicted to churn and the lifetime value they hold."""
    at_risk = F.col(prediction) == 1
    return df.agg(
        F.count_if(at_risk).alias("at_risk_customers_count"),
        F.coalesce(F.sum(F.when(at_risk, F.col(truth))), F.lit(0.0)).alias("potential_saved_revenue"),
    )


def business_impact(
    staged: DataFrame,
    true_clv: str = "true_clv",
    predicted_clv: str = "predicted_clv",
    true_churn: str = "true_churn",
    predicted_churn: str = "churn_prediction",
    baseline: float = schema.RETENTION_BASELINE,
) -> DataFrame:
    """All business metrics in one row."""
    threshold = F.lit(percentile_threshold(staged, true_clv, schema.HIGH_VALUE_PERCENTILE)).cast("double")
    mae = F.avg(F.abs(F.col(true_clv) - F.col(predicted_clv)))
    kept = 1 - F.avg(predicted_churn)
    at_risk = F.col(predicted_churn) == 1
    return staged.agg(
        (1 - F.try_divide(mae, F.avg(true_clv))).alias("clv_prediction_accuracy"),
        (1 - F.avg(true_churn)).alias("actual_retention_rate"),
        kept.alias("predicted_retention_rate"),
        ((kept - baseline) / baseline * 100).alias("retention_lift_pct"),
        _high_value_precision(true_clv, predicted_clv, threshold),
        F.count_if(at_risk).alias("at_risk_customers_count"),
        F.coalesce(F.sum(F.when(at_risk, F.col(true_clv))), F.lit(0.0)).alias("potential_saved_revenue"),
        mae.alias("avg_clv_prediction_error"),
    )


# --- clusters -----------------------------------------------------------------------------------


def with_cluster(df: DataFrame, label: str) -> DataFrame:
    """Rows without a label belong to no cluster and count in none of the metrics."""
    return df.filter(F.col(label).isNotNull())


def calinski_harabasz(df: DataFrame, features: Sequence[str] | str, label: str = "segment_id") -> DataFrame:
    """Between- to within-cluster variance, null for a single cluster; one pass over the rows, the rest on one row per cluster."""
    clusters = cluster_moments(with_cluster(df, label), features, label)
    parts = clusters.select("n", F.posexplode(F.arrays_zip("center", "variances")).alias("place", "part"))
    cells = parts.select("place", "n", F.col("part.center").alias("center"), F.col("part.variances").alias("variance"))
    means = cells.groupBy("place").agg(
        (F.sum(F.col("n") * F.col("center")) / F.sum("n")).alias("mean"), F.sum("n").alias("rows"), F.count("*").alias("k")
    )
    # One row per feature.
    gap = F.col("center") - F.col("mean")
    total = cells.join(F.broadcast(means), "place").agg(
        F.sum(F.col("n") * gap * gap).alias("between"), F.sum(F.col("n") * F.col("variance")).alias("within"),
        F.max("rows").alias("rows"), F.max("k").alias("k"),
    )
    spread = F.try_divide(F.col("within"), F.col("rows") - F.col("k"))
    score = F.try_divide(F.try_divide(F.col("between"), F.col("k") - 1), spread)
    return total.select(F.when(F.col("k") > 1, score).alias("calinski_harabasz_score"))


def davies_bouldin(df: DataFrame, features: Sequence[str] | str, label: str = "segment_id") -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / distance to another cluster; null for a single cluster.

    Two passes over the rows; the comparison of the clusters with each other is a join of the centres.
    Clusters with the same centre are not compared.
    """
    labelled = with_cluster(df, label)
    centers = cluster_moments(labelled, features, label).select("label", "center")
    points = points_of(labelled, features).select(F.col(label).alias("label"), vector_to_array("point").alias("point"))
    spread = points.join(centers, "label").groupBy("label").agg(
        F.avg(gap_between(F.col("point"), F.col("center"))).alias("spread"), F.any_value("center").alias("center")
    )
    with staged(spread, "clusters") as one:
        other = one.select(F.col("label").alias("other"), F.col("spread").alias("other_spread"), F.col("center").alias("other_center"))
        apart = gap_between(F.col("center"), F.col("other_center"))
        ratio = F.when(apart > 0, (F.col("spread") + F.col("other_spread")) / apart)
        pairs = one.join(other, F.col("label") != F.col("other"))
        worst = pairs.groupBy("label").agg(F.coalesce(F.max(ratio), F.lit(0.0)).alias("worst"))
        score = worst.agg(F.avg("worst")).first()[0]
    return df.sparkSession.createDataFrame([(score,)], "davies_bouldin_score double")


def silhouette_squared(df: DataFrame, features: Sequence[str] | str, label: str = "segment_id") -> float:
    """Mean silhouette with squared Euclidean distance: linear in the rows, where the plain form needs all pairs."""
    return ClusteringEvaluator(
        featuresCol="point", predictionCol=label, metricName="silhouette", distanceMeasure="squaredEuclidean"
    ).evaluate(points_of(with_cluster(df, label), features))


def silhouette(
    df: DataFrame,
    features: Sequence[str] | str,
    label: str = "segment_id",
    key: str = "customer_id",
    rows: int = SILHOUETTE_ROWS,
) -> float | None:
    """Mean silhouette with plain Euclidean distance over at most ``rows`` rows, all of them if there are no more; null for a single cluster.

    The plain form needs the distances of all pairs, so it is taken over a sample: the rows with the smallest hashes of ``key``. The sample
    is what ``rows`` bounds and goes to every task as a matrix; a task holds tiles of its points against tiles of the sample and keeps
    one sum of distances per point and cluster. The only point of a cluster counts 0, as do points at no distance from any other.
    """
    spark = df.sparkSession
    points = points_of(with_cluster(df, label), features).select(
        vector_to_array("point").alias("point"), F.col(label).cast("string").alias("label"), F.xxhash64(key, "point").alias("place")
    )
    share = min(1.0, 1.5 * rows / max(points.count(), 1))
    if share < 1.0:
        points = points.where(F.col("place") < F.lit(int(share * 2.0**64) - 2**63))
    with staged(points.orderBy("place").limit(rows).select("point", "label"), "sample") as sample:
        held = sample.toArrow()
        names, cluster, sizes = np.unique(held.column("label").to_pylist(), return_inverse=True, return_counts=True)
        if len(names) < 2:
            return None
        order = np.argsort(cluster, kind="stable")
        matrix = np.array(held.column("point").to_pylist(), float)[order]
        shared = spark.sparkContext.broadcast((matrix, cluster[order], sizes, {n: i for i, n in enumerate(names.tolist())}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every, group, size, number = shared.value
            for part in (b.slice(i, TILE_ROWS) for b in batches for i in range(0, b.num_rows, TILE_ROWS)):
                own = np.array([number[n] for n in part.column(1).to_pylist()])
                some, at = np.array(part.column(0).to_pylist(), float), np.arange(len(own))
                sums = np.zeros((len(own), len(size)))
                for start in range(0, len(every), TILE_ROWS):
                    tile, groups = every[start : start + TILE_ROWS], group[start : start + TILE_ROWS]
                    apart = np.sqrt(((some[:, None, :] - tile[None]) ** 2).sum(axis=2))
                    first = np.concatenate([[0], np.nonzero(np.diff(groups))[0] + 1])
                    sums[:, groups[first]] += np.add.reduceat(apart, first, axis=1)
                inside = sums[at, own] / np.maximum(size[own] - 1, 1)
                sums[at, own] = np.inf
                outside = (sums / size).min(axis=1)
                widest = np.maximum(inside, outside)
                score = np.where((size[own] > 1) & (widest > 0), (outside - inside) / np.where(widest > 0, widest, 1), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([score.sum()]), pa.array([len(score)], pa.int64())], names=["total", "n"])

        return sample.mapInArrow(run, "total double, n long").agg(F.sum("total") / F.sum("n")).first()[0]


def cluster_count(df: DataFrame, label: str = "segment_id") -> DataFrame:
    return df.agg(F.count_distinct(label).alias("n_clusters"))
