import datetime as dt

import pytest
from pyspark.sql import functions as F

from patronlens.operators import history, profile

CUSTOMER = "c_custkey long, c_mktsegment string"
ORDERS = "o_custkey long, o_totalprice double, o_orderdate timestamp_ntz"
EVENTS = "user_id long, event_type string, ts timestamp_ntz"


@pytest.fixture
def raw(spark):
    """One customer with most rows, one with events only, one with nothing, an unknown one, rows without key, date or price."""
    day = dt.datetime(2000, 1, 15)
    customer = spark.createDataFrame([(1, "MACHINERY"), (2, "FURNITURE"), (3, None), (4, "BUILDING")], CUSTOMER)
    orders = [(1, 10.05 + i, day + dt.timedelta(days=i % 400)) for i in range(900)]
    orders += [(2, 5000.0, day + dt.timedelta(days=200)), (2, None, day), (9, 1.0, day), (None, 1.0, day), (2, 7.0, None)]
    kinds = ["view", "click", "purchase", "error", "signup", None]
    events = [(1, kinds[i % 6], day + dt.timedelta(days=i * 3)) for i in range(200)]
    events += [(4, "view", day + dt.timedelta(days=300)), (4, "error", None), (None, "view", day)]
    return customer, spark.createDataFrame(orders, ORDERS).repartition(5), spark.createDataFrame(events, EVENTS)


def rebuilt(raw, as_of):
    customer, orders, events = raw
    end = F.lit(as_of)
    past = profile.profile_measures(customer, orders.filter(F.col("o_orderdate") < end), events.filter(F.col("ts") < end), end)
    return {tuple(r) for r in profile.finish_profile(past).collect()}


def known_on(past, as_of):
    return {tuple(r) for r in profile.finish_profile(past.filter(F.col("as_of") == as_of)).collect()}


@pytest.mark.parametrize("months", [1, 5])
def test_every_date_equals_a_profile_built_for_it(raw, months):
    periods = history.periods_of(raw[1], raw[2], months)
    assert periods.first == dt.date(2000, 1, 1)
    past = history.profile_history(*raw, periods).cache()
    dates = [r[0] for r in past.select("as_of").distinct().orderBy("as_of").collect()]
    assert len(dates) == periods.count and past.count() == 4 * periods.count
    for as_of in [*dates[:3], dates[len(dates) // 2], dates[-1]]:
        assert known_on(past, as_of) == rebuilt(raw, as_of)


def test_rows_before_the_first_period_count_and_rows_after_the_last_do_not(raw):
    periods = history.Periods(dt.date(2000, 6, 1), 2)
    past = history.profile_history(*raw, periods)
    for as_of in (dt.date(2000, 7, 1), dt.date(2000, 8, 1)):
        assert known_on(past, as_of) == rebuilt(raw, as_of)


def test_no_dates_and_no_customers(spark, raw):
    customer, orders, events = raw
    assert history.periods_of(orders.limit(0), events.limit(0)) is None
    past = history.profile_history(customer.limit(0), orders, events, history.periods_of(orders, events))
    assert history.kpis_with_change(history.period_kpis(past)).collect() == []


def test_kpis_against_plain_python(spark):
    days = [dt.date(2000, m, 1) for m in (2, 3, 4)]
    values = {days[0]: [i * 137.11 for i in range(101)], days[1]: [5.0] * 40 + [7.0], days[2]: [0.0]}
    rows = [(d, v, i % 2) for d, vs in values.items() for i, v in enumerate(vs)]
    frame = spark.createDataFrame(rows, "as_of date, customer_lifetime_value double, churned int")
    out = history.kpis_with_change(history.period_kpis(frame.repartition(3))).orderBy("as_of").collect()
    for row in out:
        ordered = sorted(round(v * 100) for v in values[row["as_of"]])
        place = 0.75 * (len(ordered) - 1)
        low = int(place)
        upper = ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (place - low)
        assert row["total_customers"] == len(ordered)
        assert row["high_value_customers"] == sum(v > upper for v in ordered)
        assert row["avg_clv"] == pytest.approx(sum(ordered) / len(ordered) / 100)
    assert out[0]["total_customers_delta"] is None
    assert [r["total_customers_delta"] for r in out[1:]] == [-60, -40]


def test_tables_are_scanned_once(raw):
    past = history.profile_history(*raw, history.Periods(dt.date(2000, 1, 1), 24))
    plan = past._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 3


@pytest.mark.parametrize("months", [1, 5])
def test_spans_hold_what_every_period_holds(spark, raw, months):
    """Rows stand for all periods without a change; KPIs over them are those over all periods, on years after the last event too."""
    periods = history.Periods(dt.date(2000, 1, 1), 96 // months, months)
    customer, orders, events = raw
    orders = orders.unionAll(spark.createDataFrame([(4, 30.0, dt.datetime(2004, 7, 1)), (3, 90.0, dt.datetime(2001, 1, 1))], ORDERS))
    past, spans = history.profile_history(customer, orders, events, periods), history.profile_spans(customer, orders, events, periods)
    measures = ["custkey", "customer_lifetime_value", "churned", "tenure_days", "recency", "frequency", "monetary", "email_open_rate"]
    again = spans.withColumn("as_of", F.explode(F.sequence("as_of", "until", F.make_interval(months=F.lit(months)))))
    every = sorted(map(tuple, past.select("as_of", *measures).collect()))
    assert sorted(map(tuple, again.select("as_of", *measures).collect())) == every
    assert len(every) == 4 * periods.count and spans.count() < len(every) * 0.9
    kpis = [sorted(map(tuple, history.period_kpis(t, months=months).collect())) for t in (past, spans)]
    assert kpis[0] == kpis[1] and len(kpis[0]) == periods.count
