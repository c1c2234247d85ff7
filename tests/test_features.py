import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from patronlens import schema
from patronlens.operators import features, serving
from patronlens.sources.tables import records_table
from test_clean import RECORD


@pytest.fixture(scope="module")
def stats(customers):
    return features.fit_features(customers)


def test_feature_table_has_the_listed_features_in_order(customers, stats):
    table = features.feature_table(customers, stats)
    assert table.columns == ["customer_id", *schema.FEATURES_REF, schema.CLV_TARGET, schema.CHURN_TARGET]
    assert table.count() == customers.count()


def test_engagement_stays_in_range(customers, stats):
    out = features.add_engagement_features(customers, stats)
    assert out.filter(~F.col("engagement_score").between(0, 100)).count() == 0


def test_rfm_scores_equal_pandas(customers, stats):
    pdf = customers.select("customer_id", "recency", "frequency", "monetary").toPandas().set_index("customer_id")
    codes = {c: pd.qcut(pdf[c], 5, labels=False, duplicates="drop") for c in pdf.columns}
    expected = (5 - codes["recency"]) + codes["frequency"] + codes["monetary"]
    got = features.add_rfm_scores(customers, stats).select("customer_id", "rfm_score").toPandas().set_index("customer_id")
    assert (got["rfm_score"].sort_index() == expected.sort_index()).all()


def test_recency_zero_has_no_segment_and_zero_tenure_no_velocity(spark, customers, stats):
    row = customers.limit(1).withColumns({"recency": F.lit(0), "tenure_days": F.lit(0)})
    out = features.add_features(row, stats).first()
    assert out["recency_segment"] is None and out["purchase_velocity"] is None
    assert out["clv_per_year"] == 0.0 and out["value_per_visit"] == 0.0


def test_zero_maximum_gives_no_engagement(customers, stats):
    flat = features.FeatureStats(**{**stats.__dict__, "max_visits": 0.0})
    out = features.add_engagement_features(customers, flat)
    assert out.filter(F.col("engagement_score").isNotNull()).count() == 0


def test_statistics_survive_the_round_trip(spark, stats, tmp_path):
    path = str(tmp_path / "stats")
    stats.to_table(spark).write.json(path)
    text = spark.read.schema("stats string").json(path).first()[0]
    assert features.FeatureStats.from_json(text) == stats


def test_labels_are_alphabetical_and_unseen_ones_fail(spark, stats):
    assert stats.account_types == ("Basic", "Enterprise", "Premium")
    df = spark.createDataFrame([("Premium",), ("Gold",)], "account_type string")
    with pytest.raises(PySparkException, match="unseen label"):
        features.encode_account_type(df, stats).collect()
    kept = features.encode_account_type(df, stats, unseen="keep").collect()
    assert [r[0] for r in kept] == [2, 3]
    assert features.encode_account_type(df, None).first()[0] == "Premium"


def test_any_number_of_labels(spark):
    df = spark.range(2000).select(F.format_string("%04d", "id").alias("account_type"), "id")
    labels = tuple(features.distinct_labels(df, "account_type"))
    coded = df.select("id", features.label_code("account_type", labels).alias("code"))
    assert coded.filter("code = id").count() == 2000


def test_scaling_uses_the_population_deviation_and_zero_for_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "x double, c double")
    scaler = features.fit_scaler(df, ["x", "c"])
    assert scaler.deviations["x"] == pytest.approx(3.5355, abs=1e-4)
    out = features.scale_features(df, scaler)
    assert out.agg(F.stddev_pop("x")).first()[0] == pytest.approx(1.0)
    assert {r["c"] for r in out.collect()} == {0.0}


def test_missing_columns_are_left_out(spark):
    df = spark.createDataFrame([(1, 2)], "recency int, age int")
    assert features.listed_columns(df, schema.FEATURES_REF) == ["age", "recency"]


def test_serving_form(spark):
    r = RECORD | {"support_tickets": 4}
    row = serving.serving_features(records_table(spark, [r])).first()
    assert row["account_type"] == 0 and row["rfm_score"] == 7
    score = r["email_open_rate"] * 0.3 + r["website_visits_per_month"] / 50 * 100 * 0.5 + (1 - 4 / 10) * 100 * 0.2
    assert row["engagement_score"] == pytest.approx(min(score, 100))
    assert row["purchase_velocity"] == pytest.approx(r["purchase_frequency"] / (r["tenure_days"] + 1))
    assert row["clv_per_year"] == pytest.approx(r["monetary"] / (r["tenure_days"] / 365 + 1))
    assert row["ltv_to_cac"] == pytest.approx(r["monetary"] / 100)
    assert row["recent_purchase_ratio"] == pytest.approx(r["frequency"] * 3 / (r["purchase_frequency"] + 1))
    assert list(row.asDict()) == ["customer_id", *schema.FEATURES_REF]
