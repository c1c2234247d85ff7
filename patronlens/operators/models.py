"""The three models on Spark ML: lifetime value, churn, segments."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens import schema
from patronlens.functions import clip
from patronlens.operators import evaluate, labels
from patronlens.operators.moments import gap_between
from patronlens.operators.split import mark_folds
from patronlens.staging import ensure_checkpoint_dir, spread, staged, storage_bytes

INFO = "model_name string, is_trained boolean, n_features int, feature_names array<string>, metrics map<string,double>"
IMPORTANCE = "feature string, importance double"


def assembled(features: list[str]) -> PipelineModel:
    """Features to a vector as they are; trees need no scaling."""
    return PipelineModel([VectorAssembler(inputCols=features, outputCol="vector")])


def fit_scaling(df: DataFrame, features: list[str]) -> PipelineModel:
    """Features to a vector scaled by mean and population deviation.

    The scaler of Spark ML divides by the sample deviation; the factor after it turns that into the
    population form and is stored with the pipeline.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="raw_vector")
    vectors = assembler.transform(df.select(*features))
    scaler = StandardScaler(inputCol="raw_vector", outputCol="sample_scaled", withMean=True, withStd=True).fit(vectors)
    rows = df.count()
    factor = (rows / (rows - 1)) ** 0.5 if rows > 1 else 1.0
    correction = ElementwiseProduct(
        scalingVec=Vectors.dense([factor] * len(features)), inputCol="sample_scaled", outputCol="vector"
    )
    return PipelineModel([assembler, scaler, correction])


def summary_of_scores(scores: list[float], scoring: str) -> dict[str, float]:
    mean = sum(scores) / len(scores)
    return {
        f"cv_{scoring}_mean": mean,
        f"cv_{scoring}_std": (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5,
        f"cv_{scoring}_min": min(scores),
        f"cv_{scoring}_max": max(scores),
    }


class CustomerModel:
    """Fit, predict, evaluate, cross-validate, explain, save and load one model."""

    name: str
    label: str | None = None
    defaults: dict[str, Any] = {}
    prediction_columns: list[str] = []
    default_score: str
    parallel_folds = 5
    #: How many models are fitted at the same time as this one and share the memory with it, itself included.
    at_once = 1

    def __init__(self, **overrides):
        self.params = self.defaults | overrides
        self.pipeline: PipelineModel | None = None
        self.features: list[str] = []
        self.metrics: dict[str, float] = {}

    def build(self) -> Estimator:
        raise NotImplementedError

    @property
    def is_trained(self) -> bool:
        return self.pipeline is not None

    def _require_trained(self) -> None:
        if not self.is_trained:
            raise ValueError(f"{self.name} must be trained first")

    def _fit_last_stage(self, ready: DataFrame) -> Transformer:
        return self.build().fit(ready)

    def fit(self, train: DataFrame, features: list[str] | None = None) -> CustomerModel:
        """Train on a staged feature table."""
        ensure_checkpoint_dir(train.sparkSession)
        self.features = list(features or [f for f in schema.FEATURES_REF if f in train.columns])
        kept = [c for c in (self.label,) if c]
        dealt = spread(train.select(*self.features, *[c for c in kept if c not in self.features]), *self.features, *kept)
        vectors = self._vectors(train)
        ready = vectors.transform(dealt).select("vector", *kept)
        self.pipeline = PipelineModel([*vectors.stages, self._fit_last_stage(ready)])
        return self

    def _vectors(self, train: DataFrame) -> PipelineModel:
        return assembled(self.features)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the prediction columns added."""
        self._require_trained()
        out = self._add_predictions(df)
        return out.select(*df.columns, *self.prediction_columns)

    def _add_predictions(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def evaluate(self, test: DataFrame) -> dict[str, float]:
        raise NotImplementedError

    def score(self, test: DataFrame, scoring: str) -> float:
        return self.evaluate(test)[scoring]

    def cross_validate(
        self, df: DataFrame, features: list[str] | None = None, folds: int = 5, scoring: str | None = None
    ) -> dict[str, float]:
        """Mean, population deviation, minimum and maximum of the score over folds by key.

        Folds without a score (such as the area under the curve of one class) are left out.
        """
        scoring = scoring or self.default_score
        found = [s for s in self.fold_scores(df, features, folds, scoring) if s is not None]
        if not found:
            return {f"cv_{scoring}_{part}": None for part in ("mean", "std", "min", "max")}
        return summary_of_scores(found, scoring)

    def fold_scores(
        self, df: DataFrame, features: list[str] | None = None, folds: int = 5, scoring: str | None = None
    ) -> list[float | None]:
        """Score of a fresh model on each fold, trained on the others."""
        wanted = scoring or self.default_score
        return self._each_fold(df, features, folds, lambda model, fold, held: model.score(held.drop("fold"), wanted))

    def out_of_fold(self, df: DataFrame, features: list[str] | None = None, folds: int = 5) -> DataFrame:
        """``df``, a staged table, with ``fold`` and the predictions of the model that was trained on the other folds."""
        parts = self._each_fold(df, features, folds, lambda model, fold, held: model.transform(held))
        return reduce(DataFrame.unionByName, parts)

    def _each_fold(self, df: DataFrame, features: list[str] | None, folds: int, use: Callable) -> list:
        """``use(model, fold, rows of the fold)`` for a fresh model per fold; the folds share the cluster and are fitted at the same time, ``parallel_folds`` at once."""
        folded = mark_folds(df, folds)
        ensure_checkpoint_dir(df.sparkSession)

        def one(fold: int):
            model = type(self)(**self.params)
            model.at_once = min(folds, self.parallel_folds)
            model.fit(folded.filter(F.col("fold") != fold), features)
            return use(model, fold, folded.filter(F.col("fold") == fold))

        with ThreadPool(min(folds, self.parallel_folds)) as pool:
            return pool.map(inheritable_thread_target(df.sparkSession)(one), range(folds), chunksize=1)

    def importances(self) -> list[tuple[str, float]]:
        """Feature and importance, most important first."""
        self._require_trained()
        last = self.pipeline.stages[-1]
        if not hasattr(last, "featureImportances"):
            raise NotImplementedError(f"{self.name} does not support feature importance")
        values = last.featureImportances.toArray()
        names = self.features or [f"feature_{i}" for i in range(len(values))]
        return sorted(zip(names, map(float, values)), key=lambda pair: (-pair[1], pair[0]))

    def feature_importance(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.importances(), IMPORTANCE).orderBy(F.desc("importance"), "feature")

    def info(self, spark: SparkSession) -> DataFrame:
        """One row: name, whether trained, features, metrics."""
        row = (self.name, self.is_trained, len(self.features), self.features, self.metrics)
        return spark.createDataFrame([row], INFO)

    def save(self, path: str) -> None:
        """The pipeline with its scaling under ``path/pipeline``, names and metrics under ``path/metadata``."""
        self._require_trained()
        spark = SparkSession.getActiveSession()
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        metadata = {"name": self.name, "features": self.features, "metrics": self.metrics, "params": self.params}
        one = spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1)
        one.write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CustomerModel:
        try:
            metadata = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        except AnalysisException as error:
            raise FileNotFoundError(f"no model at {path}") from error
        if metadata["name"] != cls.name:
            raise ValueError(f"{path} holds {metadata['name']}, not {cls.name}")
        model = cls(**metadata["params"])
        model.pipeline = PipelineModel.load(f"{path}/pipeline")
        model.features = metadata["features"]
        model.metrics = metadata["metrics"]
        return model


class ClvModel(CustomerModel):
    """Lifetime value by gradient-boosted trees; predictions are not negative."""

    name = "CLV Predictor"
    label = schema.CLV_TARGET
    default_score = "r2"
    defaults = schema.CLV_PARAMS
    prediction_columns = ["predicted_clv"]

    def build(self) -> GBTRegressor:
        return GBTRegressor(featuresCol="vector", labelCol=self.label, **self.params)

    def _add_predictions(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df).withColumn("predicted_clv", clip("prediction", low=0.0))

    def evaluate(self, test: DataFrame) -> dict[str, float]:
        predicted = self.transform(test)
        self.metrics = evaluate.regression_metrics(predicted, self.label, "predicted_clv").first().asDict()
        return self.metrics


class ChurnModel(CustomerModel):
    """Churn by a random forest."""

    name = "Churn Predictor"
    label = schema.CHURN_TARGET
    default_score = "auc_roc"
    defaults = schema.CHURN_PARAMS
    prediction_columns = ["churn_probability", "churn_prediction"]
    #: A forest keeps one weight per row and tree in memory while it is fitted.
    parallel_folds = 2

    def build(self) -> RandomForestClassifier:
        return RandomForestClassifier(featuresCol="vector", labelCol=self.label, **self.params)

    def _fit_last_stage(self, ready: DataFrame) -> Transformer:
        """The forest; where there is room, every row's node in each tree is kept from level to level, instead of walked to from the root.

        The trees are the same. The numbers take 4 bytes, up to three levels of them are held, and they get half of the storage.
        """
        forest = self.build()
        nodes = 3 * 4 * forest.getNumTrees() * ready.count()
        if nodes <= storage_bytes(ready.sparkSession) // (2 * self.at_once):
            # A forest has few levels: without checkpoints the numbers need not go to the shared folder.
            forest = forest.copy({forest.cacheNodeIds: True, forest.checkpointInterval: -1})
        return forest.fit(ready)

    def _add_predictions(self, df: DataFrame) -> DataFrame:
        scored = self.pipeline.transform(df)
        scored = scored.withColumn("churn_probability", vector_to_array("probability")[1])
        return scored.withColumn("churn_prediction", labels.churn_prediction())

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Probabilities of both classes as an array column."""
        self._require_trained()
        return self.pipeline.transform(df).select(*df.columns, vector_to_array("probability").alias("probabilities"))

    def evaluate(self, test: DataFrame) -> dict[str, float]:
        with staged(self.transform(test).select(self.label, *self.prediction_columns), "churn-evaluation") as predicted:
            counts = evaluate.classification_metrics(predicted, self.label, "churn_prediction").first().asDict()
            area = evaluate.auc_roc(predicted, self.label, "churn_probability").first().asDict()
        self.metrics = {k: None if v is None else float(v) for k, v in (counts | area).items()}
        return self.metrics

    def churn_factors(self, spark: SparkSession, top: int = 10) -> DataFrame:
        """The most important features under the names of the churn report."""
        return self.feature_importance(spark).limit(top).toDF("churn_factor", "importance_score")


class SegmentModel(CustomerModel):
    """Segments by k-means: the best of several restarts.

    Cluster numbers of k-means are arbitrary. Segment ids are the places of the centres by spend,
    highest first, so that a name always stands for the same kind of customer.
    """

    name = "Customer Segmentation"
    default_score = "silhouette_sq"
    defaults = schema.SEGMENT_PARAMS
    prediction_columns = ["segment_id", "segment_name", "distance_to_center"]
    order_feature = "monetary"
    parallel_restarts = 4

    def build(self) -> KMeans:
        params = {k: v for k, v in self.params.items() if k != "restarts"}
        # Distances by blocks of rows: the automatic choice would go row by row, as the points are held.
        return KMeans(**{"featuresCol": "vector", "solver": "block"} | params)

    def _vectors(self, train: DataFrame) -> PipelineModel:
        return fit_scaling(train, self.features)

    def _fit_last_stage(self, ready: DataFrame) -> Transformer:
        points = ready.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            base = self.build()
            points.count()
            seeds = range(self.params["seed"], self.params["seed"] + self.params["restarts"])
            fit_one = inheritable_thread_target(points.sparkSession)(
                lambda seed: base.copy({base.seed: seed}).fit(points)
            )
            # Restarts are independent: their jobs share the cluster instead of waiting for each other.
            with ThreadPool(min(self.parallel_restarts, len(seeds))) as pool:
                fitted = pool.map(fit_one, seeds)
            return min(fitted, key=lambda model: model.summary.trainingCost)
        finally:
            points.unpersist()

    def _clusters_by_spend(self) -> list[int]:
        """Cluster numbers of k-means in the order of segment ids."""
        self._require_trained()
        points = [center.tolist() for center in self.pipeline.stages[-1].clusterCenters()]
        place = self.features.index(self.order_feature) if self.order_feature in self.features else 0
        return sorted(range(len(points)), key=lambda i: (-points[i][place], points[i]))

    def centers(self) -> list[list[float]]:
        """Centres in the scaled space by segment id."""
        points = self.pipeline.stages[-1].clusterCenters()
        return [points[i].tolist() for i in self._clusters_by_spend()]

    def _add_predictions(self, df: DataFrame) -> DataFrame:
        order = self._clusters_by_spend()
        ids = F.array(*[F.lit(order.index(cluster)) for cluster in range(len(order))])
        centers = F.array(*[F.array(*[F.lit(x) for x in center]) for center in self.centers()])
        assigned = self.pipeline.transform(df).withColumn("segment_id", F.get(ids, F.col("prediction")))
        gap = gap_between(vector_to_array("vector"), F.get(centers, F.col("segment_id")))
        return assigned.withColumns({"segment_name": labels.segment_name(), "distance_to_center": gap})

    def center_distances(self, df: DataFrame) -> DataFrame:
        """``df`` with the segment id and ``center_distances``, the distance to every centre by segment id."""
        self._require_trained()
        gaps = [gap_between(vector_to_array("vector"), F.array(*[F.lit(x) for x in center])) for center in self.centers()]
        distances = self._add_predictions(df).withColumn("center_distances", F.array(*gaps))
        return distances.select(*df.columns, "segment_id", "center_distances")

    def assigned_points(self, df: DataFrame) -> DataFrame:
        """Segment id and the scaled vector, for quality metrics and profiles."""
        return self._add_predictions(df).select("segment_id", F.col("vector").alias("scaled"))

    def evaluate(self, test: DataFrame) -> dict[str, float]:
        """Silhouette (squared distance), Calinski-Harabasz, Davies-Bouldin, number of segments."""
        with staged(self.assigned_points(test), "segment-evaluation") as assigned:
            clusters = evaluate.cluster_count(assigned).first()[0]
            self.metrics = {
                "silhouette_sq": evaluate.silhouette_squared(assigned, "scaled") if clusters > 1 else None,
                "calinski_harabasz_score": evaluate.calinski_harabasz(assigned, "scaled").first()[0],
                "davies_bouldin_score": evaluate.davies_bouldin(assigned, "scaled").first()[0],
                "n_clusters": float(clusters),
            }
        return self.metrics

    def profiles(self, df: DataFrame) -> DataFrame:
        """Size, share and centre of every segment."""
        spark = df.sparkSession
        centers = spark.createDataFrame(list(enumerate(self.centers())), "segment_id int, center array<double>")
        sizes = labels.segment_profiles(self.assigned_points(df), len(self.centers()))
        return sizes.join(centers, "segment_id")

    def characteristics(self, df: DataFrame) -> DataFrame:
        """Mean and deviation of the scaled features per segment."""
        return labels.segment_characteristics(self.assigned_points(df), self.features, "scaled")
