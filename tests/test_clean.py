from pyspark.sql import functions as F

from patronlens.operators import clean
from patronlens.sources.tables import read_records_json, records_table

RECORD = {
    "age": 51,
    "account_type": "Basic",
    "tenure_days": 411,
    "recency": 98,
    "frequency": 0.73,
    "monetary": 1544.32,
    "email_open_rate": 41.5,
    "website_visits_per_month": 67.0,
    "support_tickets": 21,
    "avg_purchase_amount": 154.43,
    "purchase_frequency": 8.76,
    "days_since_last_purchase": 98,
}
INVALID = {"age": 12, "account_type": "Enterprise"}


def test_duplicates_keep_the_first_by_order(spark):
    rows = [("a", 2, 5.0), ("a", 1, 7.0), ("a", 1, 8.0), ("b", 3, None)]
    df = spark.createDataFrame(rows, "customer_id string, at int, x double").repartition(3)
    got = clean.drop_duplicate_keys(df, ["at"]).orderBy("customer_id").collect()
    assert [tuple(r) for r in got] == [("a", 1, 7.0), ("b", 3, None)]


def test_one_key_with_most_rows_is_combined_before_the_shuffle(spark):
    df = spark.range(10_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot").alias("customer_id"), "id"
    )
    got = clean.drop_duplicate_keys(df, ["id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan
    assert got.filter("customer_id = 'hot'").first()["id"] == 1
    assert got.count() == 3335


def test_clean_fills_caps_and_floors(spark):
    rows = [(f"c{i}", -5.0 if i == 0 else float(i), None if i == 1 else i, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "customer_id string, monetary double, age int, customer_lifetime_value double")
    got = {r["customer_id"]: r for r in clean.clean_customers(df.unionAll(df)).collect()}
    assert len(got) == 100
    assert got["c0"]["monetary"] == 0.0
    assert got["c1"]["age"] == 50.0
    assert abs(got["c99"]["customer_lifetime_value"] - 98.01) < 1e-9


def test_not_a_number_is_filled_like_null(spark):
    rows = [("a", 1.0), ("b", float("nan")), ("c", 3.0), ("d", None)]
    df = spark.createDataFrame(rows, "customer_id string, x double")
    filled = clean.fill_medians(df, clean.fit_medians(df)).orderBy("customer_id")
    assert [r["x"] for r in filled.collect()] == [1.0, 2.0, 3.0, 2.0]


def test_row_counts(spark):
    df = spark.range(10)
    assert tuple(clean.row_counts(df, df.filter("id < 4")).first()) == (10, 4)


def test_valid_and_invalid_records(spark):
    marked = clean.mark_violations(records_table(spark, [RECORD, INVALID, RECORD | {"account_type": "Gold"}]))
    bad = {r["account_type"]: r["violations"] for r in clean.quarantined_records(marked).collect()}
    assert clean.valid_records(marked).count() == 1
    assert len(bad["Enterprise"]) == 11 and "age" in bad["Enterprise"]
    assert bad["Gold"] == ["account_type"]


def test_range_limits_are_inclusive(spark):
    edge = [RECORD | {"age": a, "email_open_rate": o} for a, o in ((18, 0.0), (100, 100.0), (17, 0.0), (18, 100.1))]
    marked = clean.mark_violations(records_table(spark, edge)).collect()
    assert [r["violations"] for r in marked] == [[], [], ["age"], ["email_open_rate"]]


def test_not_a_number_is_a_violation(spark):
    marked = clean.mark_violations(records_table(spark, [RECORD | {"monetary": float("nan")}]))
    assert marked.first()["violations"] == ["monetary"]


def test_lines_that_are_no_record_are_kept(spark, tmp_path):
    import json

    lines = [json.dumps(RECORD), '{"age": ', json.dumps(RECORD | {"age": "x"}), json.dumps(RECORD | {"age": 35.5}), "no record"]
    (tmp_path / "records.json").write_text("\n".join(lines))
    marked = clean.mark_violations(read_records_json(spark, str(tmp_path)))
    assert marked.count() == 5 and clean.valid_records(marked).count() == 1
    kept = sorted(r["unread"] for r in clean.quarantined_records(marked).collect())
    assert kept == sorted(lines[1:])
    assert all("unread" in r["violations"] for r in clean.quarantined_records(marked).collect())
