"""The checks of model answers turn red when a rule of the library changes."""

import pytest
from pyspark.sql import functions as F

from checks import rules
from patronlens.operators import labels, reports
from patronlens.plans.scoring import respond, score_records, top_factors

VALUES = [0.0, 1999.99, 2000.0, 4999.99, 5000.0, 9999.99, 10000.0, 50000.0]
CHANCES = [0.0, 0.1, 0.25, 0.3, 0.5, 0.6, 0.75, 1.0]


@pytest.fixture(scope="module")
def predicted(spark):
    rows = [(f"c{i}", v, p, i % 5, 100 * i, 0.5) for i, (v, p) in enumerate(zip(VALUES, CHANCES))]
    names = "customer_id string, predicted_clv double, churn_probability double, segment_id int, tenure_days int, distance_to_center double"
    return spark.createDataFrame(rows, names)


def labelled(predicted):
    return predicted.withColumns({"churn_prediction": labels.churn_prediction(), "segment_name": labels.segment_name(), "risk_category": labels.risk_category_batch()})


def wrong_answers(predicted, fact):
    facts = rules.answer_facts(respond(labelled(predicted), ["a", "b", "c"]))
    return facts.where(f"NOT {fact}").count()


FACTS = ["clv_fits", "churn_fits", "risk_fits", "segment_fits"]


@pytest.mark.parametrize("fact", FACTS)
def test_right_answers_are_green(predicted, fact):
    assert wrong_answers(predicted, fact) == 0


@pytest.mark.parametrize(
    "fact, rule, instead",
    [
        ("clv_fits", "clv_fixed_segment", lambda c="predicted_clv": F.when(F.col(c) <= 2000, "Low Value").otherwise("Medium Value")),
        ("clv_fits", "clv_fixed_segment", lambda c="predicted_clv": F.lit(None).cast("string")),
        ("churn_fits", "churn_prediction", lambda p="churn_probability": (F.col(p) >= 0.7).cast("int")),
        ("risk_fits", "risk_category_request", lambda p="churn_probability": F.when(F.col(p) < 0.3, "Low Risk").otherwise("High Risk")),
        ("risk_fits", "risk_category_request", lambda p="churn_probability": F.lit(None).cast("string")),
        ("segment_fits", "segment_name", lambda c="segment_id": F.concat(F.lit("Segment "), F.col(c).cast("string"))),
    ],
)
def test_wrong_answers_are_red(predicted, monkeypatch, fact, rule, instead):
    monkeypatch.setattr(labels, rule, instead)
    assert wrong_answers(predicted, fact) > 0


def test_confidence(predicted, monkeypatch):
    def wrong():
        return respond(labelled(predicted), [], "tenure_days").where(~rules.follows("clv.confidence", rules.CONFIDENCE, "tenure_days")).count()

    assert wrong() == 0
    monkeypatch.setattr(labels, "confidence", lambda c="tenure_days": F.when(F.col(c) > 250, "high").otherwise("medium"))
    assert wrong() > 0


def test_dashboard(predicted, monkeypatch):
    def wrong(fact):
        return rules.dashboard_facts(labelled(predicted).withColumn("account_type", F.lit("Basic"))).where(f"NOT {fact}").count()

    assert [wrong(f) for f in ("not_negative", "in_range", "risk_fits", "named")] == [0, 0, 0, 0]
    # The categories of a request: 0 has one, a limit belongs to the higher one.
    monkeypatch.setattr(labels, "risk_category_batch", labels.risk_category_request)
    assert wrong("risk_fits") == 4
    monkeypatch.setattr(labels, "segment_name", lambda c="segment_id": F.lit("Dormant"))
    assert wrong("named") == 7


def test_factors(spark, training, customers):
    model = training.models.churn
    ranked = rules.ranked_importances(spark, model.pipeline)
    top = [r["feature"] for r in ranked.orderBy("place").limit(3).collect()]
    assert top_factors(training.models) == top
    answer = score_records(customers.limit(5), training.models).select("churn.top_risk_factors").distinct().collect()
    assert [r[0] for r in answer] == [top]

    def placed(pairs):
        return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "place long, feature string, importance double")

    listed = [tuple(r) for r in model.churn_factors(spark).collect()]
    assert rules.factor_facts(placed(listed), ranked).where("NOT same").count() == 0
    swapped = [listed[1], listed[0], *listed[2:]]
    assert rules.factor_facts(placed(swapped), ranked).where("NOT same").count() == 2
    chart = [tuple(r) for r in reports.top_importance(model.feature_importance(spark)).collect()]
    assert rules.factor_facts(placed(chart[::-1]), ranked).where("NOT same").count() == 0
    assert rules.factor_facts(placed(chart), ranked).where("NOT same").count() > 0
