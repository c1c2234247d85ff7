"""The training run: customer table to features, three models, evaluation and report."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from patronlens import schema, versions
from patronlens.operators import evaluate
from patronlens.operators.clean import clean_customers
from patronlens.operators.features import FeatureStats, feature_table, fill_features, fit_features, fit_fills, listed_columns
from patronlens.operators.models import ChurnModel, ClvModel, SegmentModel
from patronlens.operators.split import mark_hash_split, mark_stratified_split, test_part, train_part
from patronlens.plans.scoring import ModelSet
from patronlens.sources.sinks import write_report
from patronlens.staging import drop_path, even_tasks, stage, staged


@dataclass(frozen=True)
class TrainingData:
    """Fitted statistics and the feature tables.

    ``features`` is what segments are fitted on; ``split`` adds the flags ``clv_test`` and ``churn_test``
    of the rows held out from the two supervised models. ``filled`` counts the rows that missed a feature.
    """

    stats: FeatureStats
    names: list[str]
    features: DataFrame
    split: DataFrame
    filled: dict[str, int] = field(default_factory=dict)

    def drop(self) -> None:
        """Delete the staged tables; the fitted statistics stay."""
        spark = self.features.sparkSession
        for path in {f.rpartition("/")[0] for f in (*self.features.inputFiles(), *self.split.inputFiles())}:
            drop_path(spark, path)


@dataclass(frozen=True)
class TrainingRun:
    """Everything a training run yields."""

    data: TrainingData
    models: ModelSet
    report: dict[str, Any]

    def report_table(self, spark: SparkSession) -> DataFrame:
        """The report as one nested row."""
        text = json.dumps(self.report)
        struct = F.schema_of_json(F.lit(text))
        return spark.range(1).select(F.from_json(F.lit(text), struct).alias("report")).select("report.*")

    def save(self, spark: SparkSession, path: str) -> None:
        """Models, fitted statistics and the JSON report."""
        self.models.save(f"{path}/models")
        self.data.stats.to_table(spark).coalesce(1).write.mode("overwrite").json(f"{path}/feature_stats")
        write_report(self.report_table(spark), f"{path}/training_report")

    def publish(self, spark: SparkSession, path: str, keep: int = 3) -> int:
        """Save as a new version under ``path``; readers see the old one until all of the new one is written."""
        folder = f"version-{uuid.uuid4().hex}"
        self.save(spark, f"{path}/{folder}")
        number = versions.publish(spark, path, folder)
        versions.prune(spark, path, keep)
        return number


def load_published(spark: SparkSession, path: str, number: int | None = None) -> tuple[ModelSet, FeatureStats]:
    """Models and fitted statistics of the newest published version, or of the one asked for; both of one training."""
    folder = versions.current(spark, path, number)
    return ModelSet.load(spark, f"{folder}/models"), load_stats(spark, folder)


def load_stats(spark: SparkSession, path: str) -> FeatureStats:
    return FeatureStats.from_json(spark.read.schema("stats string").json(f"{path}/feature_stats").first()[0])


def together(spark: SparkSession, *steps) -> list:
    """Run independent steps at the same time; each submits its own jobs."""
    with ThreadPool(len(steps)) as pool:
        return pool.map(lambda step: step(), [inheritable_thread_target(spark)(step) for step in steps], chunksize=1)


def prepare(
    customers: DataFrame, features: list[str] | None = None, clean_first: bool = True, order_by: Sequence[str] = ()
) -> TrainingData:
    """Clean, fit the features, fill what they miss and mark the held-out rows.

    ``clean_first=False`` computes the features on the raw rows and cleans afterwards, the order in
    which the lifetime value inside the features is not capped; segments then see uncleaned rows.
    ``order_by`` says which of several rows of a customer stays.
    """
    names = features or schema.FEATURES_REF
    spark = customers.sparkSession
    base = clean_customers(customers, order_by) if clean_first else stage(customers, "customers")
    fitted = fit_features(base)
    # The joins and groups before left few and uneven parts; all that follows passes over these tables many times.
    tasks = even_tasks(base)
    with staged(feature_table(base, fitted, names).repartition(tasks), "raw-features") as raw:
        fills, filled = fit_fills(raw, listed_columns(raw, names))
        stats = replace(fitted, fills=fills)
        table = stage(fill_features(raw, fills), "features")
    for path in {f.rpartition("/")[0] for f in base.inputFiles()}:
        drop_path(spark, path)
    modelling = table if clean_first else clean_customers(table)
    marked = mark_hash_split(mark_stratified_split(modelling, schema.CHURN_TARGET, flag="churn_test"), flag="clv_test")
    return TrainingData(stats, names, table, stage(marked.repartition(tasks), "split"), filled)


def fit_models(
    data: TrainingData,
    clv: dict[str, Any] | None = None,
    churn: dict[str, Any] | None = None,
    segments: dict[str, Any] | None = None,
) -> ModelSet:
    """Fit the three models, which do not depend on each other; the arguments override their settings."""
    return ModelSet(
        *together(
            data.features.sparkSession,
            lambda: ClvModel(**(clv or {})).fit(train_part(data.split, "clv_test"), data.names),
            lambda: ChurnModel(**(churn or {})).fit(train_part(data.split, "churn_test"), data.names),
            lambda: SegmentModel(**(segments or {})).fit(data.features, data.names),
        )
    )


def held_out_impact(data: TrainingData, models: ModelSet) -> Row:
    """Business metrics over the customers that neither model saw, truth and prediction from the same row."""
    unseen = data.split.filter("clv_test AND churn_test")
    predicted = models.churn.transform(models.clv.transform(unseen)).select(
        F.col(schema.CLV_TARGET).alias("true_clv"),
        F.col(schema.CHURN_TARGET).alias("true_churn"),
        "predicted_clv",
        "churn_prediction",
    )
    with staged(predicted, "impact") as table:
        return evaluate.business_impact(table).first()


def evaluate_models(data: TrainingData, models: ModelSet) -> dict[str, Any]:
    """Metrics on the held-out rows, importances, segment profiles and business impact."""
    spark = data.features.sparkSession
    clv, churn, segments, profiles, impact = together(
        spark,
        lambda: models.clv.evaluate(test_part(data.split, "clv_test")),
        lambda: models.churn.evaluate(test_part(data.split, "churn_test")),
        lambda: models.segments.evaluate(data.features),
        lambda: models.segments.profiles(data.features).drop("center").orderBy("segment_id").collect(),
        lambda: held_out_impact(data, models),
    )
    importance = [{"feature": name, "importance": value} for name, value in models.clv.importances()[:10]]
    factors = [{"churn_factor": name, "importance_score": value} for name, value in models.churn.importances()[:5]]
    return {
        "clv_model": {"metrics": clv, "feature_importance": importance},
        "churn_model": {"metrics": churn, "churn_factors": factors},
        "segmentation_model": {"metrics": segments, "segment_profiles": [row.asDict() for row in profiles]},
        "business_impact": impact.asDict(),
        "filled_values": data.filled,
    }


def train(
    customers: DataFrame,
    features: list[str] | None = None,
    clean_first: bool = True,
    clv: dict[str, Any] | None = None,
    churn: dict[str, Any] | None = None,
    segments: dict[str, Any] | None = None,
    order_by: Sequence[str] = (),
) -> TrainingRun:
    """The whole run on a customer table; ``run.data.drop()`` deletes the tables it leaves staged."""
    data = prepare(customers, features, clean_first, order_by)
    models = fit_models(data, clv, churn, segments)
    return TrainingRun(data, models, evaluate_models(data, models))
