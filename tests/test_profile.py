import datetime as dt

import pytest
from pyspark.sql import functions as F

from patronlens import schema
from patronlens.operators import profile


@pytest.fixture
def raw(spark):
    """One customer with a third of all rows and more, one with a single order, one with nothing."""
    customer = spark.createDataFrame([(1, "MACHINERY"), (2, "FURNITURE"), (3, "BUILDING")], "c_custkey long, c_mktsegment string")
    day = dt.datetime(2000, 1, 1)
    hot = [(1, 10.05, day + dt.timedelta(days=i % 100)) for i in range(1000)]
    orders = spark.createDataFrame([*hot, (2, 5000.0, day)], "o_custkey long, o_totalprice double, o_orderdate timestamp_ntz")
    kinds = ["view", "click", "purchase", "error", "signup"]
    events = spark.createDataFrame([(1, kinds[i % 5]) for i in range(100)], "user_id long, event_type string")
    return customer, orders.repartition(5), events


def test_profile_of_hot_single_and_absent(raw):
    rows = {r["customer_id"]: r for r in profile.customer_profile(*raw).collect()}
    hot, single, absent = (rows[f"CUST_00000{i}"] for i in (1, 2, 3))
    assert (hot["total_purchases"], hot["monetary"], hot["tenure_days"], hot["recency"]) == (1000, 10.05, 100, 1)
    assert hot["frequency"] == 20.0 and hot["purchase_frequency"] == 240.0
    assert (hot["email_open_rate"], hot["website_visits_per_month"], hot["support_tickets"]) == (50.0, 60.0, 20)
    assert (single["avg_purchase_amount"], single["recency"], single["account_type"]) == (5.0, 100, "Basic")
    assert (absent["total_purchases"], absent["tenure_days"], absent["recency"]) == (0, 1, 365)
    assert (absent["customer_lifetime_value"], absent["churned"]) == (0.0, 1)


def test_fixed_date_gives_the_same_days_without_a_scan(raw):
    fixed = profile.customer_profile(*raw, as_of=F.lit(dt.date(2000, 4, 10)))
    assert sorted(fixed.collect()) == sorted(profile.customer_profile(*raw).collect())


def test_declared_schema(customers):
    assert [(f.name, f.dataType) for f in customers.schema] == [(f.name, f.dataType) for f in schema.CUSTOMER]


def test_value_ranges(customers):
    row = customers.agg(
        F.min("age"), F.max("age"), F.min(schema.CLV_TARGET), F.count_if(~F.col("churned").isin(0, 1))
    ).first()
    assert row[0] >= 18 and row[1] <= 80 and row[2] >= 0 and row[3] == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_same_profile_for_any_partitioning(spark, folder, customers, parts):
    from checks.frames import tables

    again = profile.customer_profile(*[t.repartition(parts) for t in tables(spark, folder)])
    assert sorted(again.collect()) == sorted(customers.collect())
