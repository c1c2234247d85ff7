import pytest
from pyspark.sql import functions as F

from patronlens import schema
from patronlens.operators import labels, reports


def p_frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, churn_probability double")


def column(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_both_forms_of_risk_category(spark):
    df = p_frame(spark, [0.0, 0.1, 0.25, 0.5, 0.75, 1.0, None])
    low, medium, high, critical = schema.RISK_LABELS
    assert column(df, labels.risk_category_batch()) == [None, low, low, medium, high, critical, None]
    assert column(df, labels.risk_category_request()) == [low, low, medium, high, critical, critical, None]


def test_churn_and_at_risk_thresholds_are_inclusive(spark):
    df = p_frame(spark, [0.4999, 0.5, 0.7])
    assert column(df, labels.churn_prediction()) == [0, 1, 1]
    assert column(df, labels.at_risk_flag()) == [False, False, True]


def test_fixed_value_segments(spark):
    df = spark.createDataFrame([(0, 1999.99), (1, 2000.0), (2, 5000.0), (3, 9999.0), (4, 10000.0)], "i int, predicted_clv double")
    low, medium, high, premium = schema.CLV_SEGMENTS
    assert column(df, labels.clv_fixed_segment()) == [low, medium, high, high, premium]


def test_quartile_segments_of_equal_predictions(spark):
    df = spark.createDataFrame([(7.0,)] * 5, "predicted_clv double")
    assert {r["clv_segment"] for r in labels.add_clv_quartile_segment(df).collect()} == {None}


def test_confidence_limit(spark):
    df = spark.createDataFrame([(0, 180), (1, 181)], "i int, tenure_days int")
    assert column(df, labels.confidence()) == ["medium", "high"]


def test_unknown_segment_gets_a_number_and_general_advice(spark):
    df = spark.createDataFrame([(0,), (4,), (7,)], "segment_id int")
    rows = df.select("segment_id", labels.segment_name().alias("n"), labels.recommended_actions().alias("a")).orderBy("segment_id").collect()
    assert [r["n"] for r in rows] == ["High-Value Engaged", "Dormant", "Segment 7"]
    assert [len(r["a"]) for r in rows] == [3, 3, 1]


def test_empty_segments_are_listed(spark):
    df = spark.createDataFrame([(1,), (1,), (3,)], "segment_id int")
    rows = {r["segment_id"]: r for r in labels.segment_profiles(df).collect()}
    assert len(rows) == 5 and rows[0]["size"] == 0 and rows[0]["percentage"] == 0.0
    assert rows[1]["percentage"] == pytest.approx(200 / 3)


def test_unknown_segments_are_counted(spark):
    df = spark.createDataFrame([(1,), (None,), (9,), (9,)], "segment_id int")
    rows = {r["segment_id"]: (r["size"], r["percentage"]) for r in labels.segment_profiles(df).collect()}
    assert rows == {0: (0, 0.0), 1: (1, 25.0), 2: (0, 0.0), 3: (0, 0.0), 4: (0, 0.0), 9: (2, 50.0), None: (1, 25.0)}


def test_nearest_center_and_tie(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 2.1)], "i int, x double")
    out = labels.assign_segment(df, [F.col("x")], [[0.0], [2.0]]).orderBy("i").collect()
    assert [r["segment_id"] for r in out] == [0, 0, 1]
    assert out[2]["distance_to_center"] == pytest.approx(0.1)


def test_histogram_holds_every_row_and_the_maximum(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "predicted_clv double")
    rows = reports.histogram(df).collect()
    assert sum(r["customers"] for r in rows) == 101
    assert max(r["bin"] for r in rows) == 49
    same = spark.createDataFrame([(3.0,)] * 4, "predicted_clv double")
    assert [tuple(r) for r in reports.histogram(same).collect()] == [(0, 3.0, 4)]


def test_importance_ascends_after_the_cut(spark):
    df = spark.createDataFrame([(f"f{i}", float(i)) for i in range(15)], "feature string, importance double")
    assert [r["feature"] for r in reports.top_importance(df).collect()] == [f"f{i}" for i in range(5, 15)]
