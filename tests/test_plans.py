"""Properties of the physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from checks.frames import profile, rule_scores, tables
from patronlens.operators import evaluate, profile as prof
from patronlens.sources import sinks
from patronlens.sources import tables as sources
from patronlens.staging import shared_folder, stage


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_only_needed_columns_are_read(spark, folder):
    plan = plan_of(profile(spark, folder))
    schemas = set(re.findall(r"ReadSchema: (\S+)", plan))
    assert "struct<c_custkey:bigint,c_mktsegment:string>" in schemas
    assert "struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in schemas
    assert "struct<user_id:bigint,event_type:string>" in schemas
    assert "PushedFilters: [In(event_type, [click,error,purchase,view])" in plan


@pytest.mark.parametrize("query", [profile, rule_scores])
def test_no_cross_join_and_no_python(spark, folder, query):
    plan = plan_of(query(spark, folder))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "Window"):
        assert bad not in plan


def test_large_sides_are_joined_on_the_shuffle_of_the_aggregates(spark, folder):
    """Without broadcast the aggregates keep their partitioning and only the customers are shuffled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(profile(spark, folder).filter("total_purchases >= 0"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastExchange" not in plan
    by_key = re.findall(r"Arguments: hashpartitioning\((\w+)", plan)
    assert sorted(by_key) == ["custkey", "o_custkey", "user_id"]


def test_bucketed_orders_need_no_shuffle(spark, folder, tmp_path):
    _, orders, _ = tables(spark, folder)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/bucketed'")
    try:
        sinks.write_bucketed(orders, "bucketed.orders", "o_custkey", 8)
        totals = prof.order_totals(spark.table("bucketed.orders"))
        assert "Exchange" not in plan_of(totals)
        assert sorted(totals.collect()) == sorted(prof.order_totals(orders).collect())
    finally:
        spark.sql("DROP DATABASE bucketed CASCADE")


def test_auc_accumulates_per_range(spark, folder):
    plan = plan_of(evaluate.auc_roc(rule_scores(spark, folder), "true_churn", "churn_probability"))
    assert re.search(r"hashpartitioning\(bucket", plan)


def test_staged_tables_go_to_the_shared_folder(spark):
    df = stage(spark.range(5).select("id", F.lit(1).alias("x")), "t")
    assert df.inputFiles()[0].replace("file://", "").startswith(shared_folder(spark).replace("file://", ""))


def test_csv_must_fit_the_schema(spark, tmp_path):
    bad = str(tmp_path / "bad")
    spark.createDataFrame([("CUST_1", "young")], "customer_id string, age string").write.option("header", True).csv(bad)
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.read_customers_csv(spark, bad).collect()
