import pytest
from pyspark.sql import functions as F

from checks.frames import dirty_profile
from patronlens import schema
from patronlens.operators.models import ChurnModel, ClvModel, SegmentModel
from patronlens.operators.split import mark_hash_split, test_part as held_out
from patronlens.plans.scoring import ModelSet, answers, quarantine, score_batch, score_records
from patronlens.plans.training import load_stats, train
from patronlens.sources.tables import records_table
from patronlens.staging import application_folder, stage
from patronlens.streaming.scoring import read_record_stream, score_stream
from test_clean import RECORD


def test_lifetime_value_predictions(training):
    test = held_out(mark_hash_split(training.data.features))
    out = training.models.clv.transform(test)
    assert out.count() == test.count()
    assert out.filter("predicted_clv < 0").count() == 0
    assert training.models.clv.metrics["r2"] > 0


def test_churn_predictions(training):
    out = training.models.churn.transform(training.data.features)
    assert out.filter(~F.col("churn_prediction").isin(0, 1)).count() == 0
    assert out.filter(~F.col("churn_probability").between(0, 1)).count() == 0
    proba = training.models.churn.predict_proba(training.data.features).first()["probabilities"]
    assert len(proba) == 2 and sum(proba) == pytest.approx(1)


def test_segments(training):
    model = training.models.segments
    out = model.transform(training.data.features)
    assert out.filter(~F.col("segment_id").between(0, 4)).count() == 0
    place = model.features.index("monetary")
    spend = [center[place] for center in model.centers()]
    assert spend == sorted(spend, reverse=True)


def test_segment_is_the_nearest_center(training):
    import numpy as np

    model = training.models.segments
    points = model._add_predictions(training.data.features).select("segment_id", "vector", "distance_to_center").collect()
    centers = np.array(model.centers())
    for row in points:
        gaps = np.linalg.norm(centers - row["vector"].toArray(), axis=1)
        assert gaps.argmin() == row["segment_id"]
        assert gaps.min() == pytest.approx(row["distance_to_center"])


def test_scaled_features_have_population_deviation_one(training):
    from patronlens.operators.moments import cluster_moments

    points = training.models.segments.assigned_points(training.data.features).withColumn("all", F.lit(0))
    row = cluster_moments(points, "scaled", "all").first()
    assert row["center"] == pytest.approx([0.0] * 18, abs=1e-9)
    assert [v for v in row["variances"] if v > 1e-12] == pytest.approx([1.0] * sum(v > 1e-12 for v in row["variances"]))


def test_report(training, spark):
    report = training.report_table(spark).first().asDict(recursive=True)
    assert set(report) == {"clv_model", "churn_model", "segmentation_model", "business_impact", "filled_values"}
    assert len(report["clv_model"]["feature_importance"]) == 10
    assert len(report["churn_model"]["churn_factors"]) == 5
    assert len(report["segmentation_model"]["segment_profiles"]) == 5
    assert report["business_impact"]["at_risk_customers_count"] >= 0


def test_models_must_be_trained(spark, training, tmp_path):
    for model in (ClvModel(), ChurnModel(), SegmentModel()):
        with pytest.raises(ValueError, match="must be trained"):
            model.transform(training.data.features)
        with pytest.raises(ValueError, match="must be trained"):
            model.save(str(tmp_path / "x"))
        assert not model.info(spark).first()["is_trained"]
    with pytest.raises(ValueError):
        ClvModel().importances()
    with pytest.raises(NotImplementedError):
        training.models.segments.importances()


def test_defaults_and_overrides():
    assert ClvModel().build().getMaxIter() == 200
    assert ClvModel(maxIter=3).build().getMaxIter() == 3
    assert ChurnModel().build().getNumTrees() == 150
    assert SegmentModel(k=4).build().getK() == 4


def test_save_and_load(spark, training, tmp_path):
    path = str(tmp_path / "run")
    training.save(spark, path)
    again = ModelSet.load(spark, f"{path}/models")
    before = sorted(training.models.transform(training.data.features).collect(), key=lambda r: r["customer_id"])
    after = sorted(again.transform(training.data.features).collect(), key=lambda r: r["customer_id"])
    assert before == after
    assert load_stats(spark, path) == training.data.stats
    assert [tuple(r) for r in again.info(spark).collect()] == [tuple(r) for r in training.models.info(spark).collect()]
    assert spark.read.json(f"{path}/training_report").count() == 1


def test_missing_or_wrong_model(spark, training, tmp_path):
    with pytest.raises(FileNotFoundError):
        ClvModel.load(spark, str(tmp_path / "nowhere"))
    training.models.clv.save(str(tmp_path / "clv"))
    with pytest.raises(ValueError):
        ChurnModel.load(spark, str(tmp_path / "clv"))


def test_cross_validation(training):
    got = ClvModel(maxIter=3, maxDepth=4, stepSize=0.3).cross_validate(training.data.features, folds=3)
    assert got["cv_r2_min"] <= got["cv_r2_mean"] <= got["cv_r2_max"]
    assert set(got) == {"cv_r2_mean", "cv_r2_std", "cv_r2_min", "cv_r2_max"}


def test_sample_record_gets_a_full_answer(spark, training):
    row = score_records(records_table(spark, [RECORD]), training.models).first()
    assert row["clv"]["customer_lifetime_value"] >= 0
    assert row["clv"]["clv_segment"] in schema.CLV_SEGMENTS and row["clv"]["confidence"] == "high"
    assert 0 <= row["churn"]["churn_probability"] <= 1 and len(row["churn"]["top_risk_factors"]) == 3
    assert row["churn"]["risk_category"] in schema.RISK_LABELS
    assert row["segment"]["segment_id"] >= 0 and len(row["segment"]["recommended_actions"]) == 3


@pytest.mark.parametrize("file_format", ["json", "parquet"])
def test_stream_equals_batch_and_goes_on_after_a_stop(spark, folder, training, tmp_path, file_format):
    records = stage(dirty_profile(spark, folder).select(*schema.SCORING.names), "records")
    batch = score_batch(records, training.models, str(tmp_path / "batch")).first()
    assert batch["total_customers"] + batch["rejected_records"] == records.count()

    incoming, out, state = (str(tmp_path / n) for n in ("incoming", "answers", "state"))
    first, second = records.randomSplit([0.5, 0.5], seed=1)
    for part in (first, second):
        part.write.mode("append").format(file_format).save(incoming)
        source = read_record_stream(spark, incoming, file_format, max_files_per_trigger=3)
        query = score_stream(source, training.models, out, state)
        query.awaitTermination()
    key = str  # two records of a customer may come in either order
    streamed = sorted(answers(spark, out).collect(), key=key)
    expected = sorted(answers(spark, str(tmp_path / "batch")).collect(), key=key)
    assert streamed == expected
    assert quarantine(spark, out).count() == batch["rejected_records"]
    assert sorted(map(str, quarantine(spark, out).drop("unread").collect())) == sorted(
        map(str, quarantine(spark, str(tmp_path / "batch")).drop("unread").collect())
    )


def test_features_before_cleaning(spark, customers):
    tiny = {"maxIter": 2, "maxDepth": 2}
    run = train(
        customers, schema.FEATURES_SAFE, clean_first=False, clv=tiny, churn={"numTrees": 3, "maxDepth": 3}, segments={"restarts": 1, "maxIter": 5}
    )
    assert run.models.clv.features == schema.FEATURES_SAFE
    assert run.report["segmentation_model"]["metrics"]["n_clusters"] >= 1


TINY = {"clv": {"maxIter": 2, "maxDepth": 2}, "churn": {"numTrees": 3, "maxDepth": 3}, "segments": {"restarts": 1, "maxIter": 5}}


def test_training_on_dirty_rows(spark, folder):
    """Features that are missing are filled, and no row is lost."""
    dirty = dirty_profile(spark, folder)
    run = train(dirty, order_by=["copy"], **TINY)
    customers = dirty.select("customer_id").distinct().count()
    assert run.data.features.count() == customers == run.data.features.dropna(subset=run.data.names).count()
    assert run.report["filled_values"]["purchase_velocity"] > 0


@pytest.mark.parametrize("column", ["support_tickets", "website_visits_per_month", "frequency"])
def test_training_without_variation(spark, customers, column):
    same = customers.withColumn(column, F.lit(0).cast(customers.schema[column].dataType))
    run = train(same, **TINY)
    assert run.data.features.dropna(subset=run.data.names).count() == customers.count()


def test_training_with_not_a_number(spark, customers):
    holes = customers.withColumn("monetary", F.when(F.crc32("customer_id") % 7 == 0, float("nan")).otherwise(F.col("monetary")))
    run = train(holes, clean_first=False, **TINY)
    assert run.data.filled["monetary"] > 0
    edges = run.data.stats.monetary_edges
    assert list(edges) == sorted(edges)


def test_cross_validation_of_every_model(training):
    table = training.data.features
    churn = ChurnModel(numTrees=3, maxDepth=3).cross_validate(table, folds=2)
    segments = SegmentModel(restarts=1, maxIter=5).cross_validate(table, folds=2)
    assert set(churn) == {f"cv_auc_roc_{p}" for p in ("mean", "std", "min", "max")}
    assert set(segments) == {f"cv_silhouette_sq_{p}" for p in ("mean", "std", "min", "max")}


def test_batch_reads_its_input_once(spark, folder, training, tmp_path):
    records = stage(dirty_profile(spark, folder).select(*schema.SCORING.names), "records")
    from patronlens.plans.scoring import score_marked

    plan = score_marked(records, training.models)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    summary = score_batch(records, training.models, str(tmp_path / "out")).first()
    assert summary["total_customers"] == answers(spark, str(tmp_path / "out")).count()
    assert summary["rejected_records"] == quarantine(spark, str(tmp_path / "out")).count()


def test_staged_tables_go_when_they_are_read(spark, customers, tmp_path):
    import os

    def staged_now():
        root = application_folder(spark).replace("file://", "")
        return set(os.listdir(root)) if os.path.isdir(root) else set()

    before = staged_now()
    run = train(customers, **TINY)
    assert {n.rpartition("-")[0] for n in staged_now() - before} <= {"features", "split"}
    run.data.drop()
    score_batch(customers.select(*schema.SCORING.names), run.models, str(tmp_path / "out"))
    assert staged_now() == before


def test_rows_are_dealt_over_the_cores(spark, customers, monkeypatch):
    """What models pass over many times is dealt over all cores, however few parts the last shuffle left."""
    from patronlens import staging
    from patronlens.plans.training import prepare

    monkeypatch.setattr(staging, "ROWS_OF_TASK", 10)
    cores = spark.sparkContext.defaultParallelism
    data = prepare(customers)
    assert len(data.features.inputFiles()) == len(data.split.inputFiles()) == cores
    seen = []

    class Watched(ClvModel):
        def _fit_last_stage(self, ready):
            seen.extend(ready.rdd.glom().map(len).collect())
            return super()._fit_last_stage(ready)

    Watched(maxIter=1, maxDepth=1).fit(stage(data.split.coalesce(1), "one-part"), data.names)
    assert len(seen) == cores and sum(seen) == data.split.count() and max(seen) - min(seen) <= 1


def test_forest_keeps_nodes_where_there_is_room(training, monkeypatch):
    """With and without the node of every row in memory: the same trees."""
    from patronlens.operators import models

    fitted = []
    for room in (10**12, 0):
        monkeypatch.setattr(models, "storage_bytes", lambda spark, room=room: room)
        model = ChurnModel(numTrees=5, maxDepth=4).fit(training.data.split, training.data.names)
        fitted.append(model.pipeline.stages[-1])
    assert [f.getCacheNodeIds() for f in fitted] == [True, False]
    assert fitted[0].toDebugString.partition("\n")[2] == fitted[1].toDebugString.partition("\n")[2]


def test_storage_of_the_executors(spark):
    from patronlens.staging import storage_bytes

    assert 0 < storage_bytes(spark) < 12 * 2**30


def test_segments_are_fitted_by_blocks(training):
    assert SegmentModel().build().getSolver() == "block"
    assert training.models.segments.pipeline.stages[-1].getSolver() == "block"
