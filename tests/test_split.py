import pytest
from pyspark.sql import functions as F

from patronlens.operators import split


def test_hash_split_does_not_depend_on_partitioning(customers):
    first = {r[0] for r in split.test_part(split.mark_hash_split(customers)).select("customer_id").collect()}
    again = {
        r[0] for r in split.test_part(split.mark_hash_split(customers.repartition(11))).select("customer_id").collect()
    }
    assert first == again and 0 < len(first) < customers.count()


def test_parts_are_complete_and_disjoint(customers):
    marked = split.mark_hash_split(customers)
    assert split.test_part(marked).count() + split.train_part(marked).count() == customers.count()


@pytest.mark.parametrize("percent", [0, 20, 50, 100])
def test_stratified_share_is_exact(spark, percent):
    df = spark.range(1000).select(
        F.concat(F.lit("c"), "id").alias("customer_id"), (F.col("id") % 7 == 0).cast("int").alias("label")
    )
    marked = split.mark_stratified_split(df, "label", percent)
    rows = marked.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert {r["label"]: r["t"] for r in rows} == {r["label"]: (r["n"] * percent + 50) // 100 for r in rows}


def test_folds_cover_everything(customers):
    sizes = split.mark_folds(customers, 3).groupBy("fold").count().collect()
    assert {r["fold"] for r in sizes} == {0, 1, 2}
    assert sum(r["count"] for r in sizes) == customers.count()


def test_rows_without_key_or_label_are_in_one_part(spark):
    rows = [(f"c{i}" if i % 3 else None, i % 2 if i % 5 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "customer_id string, label int")
    for marked in (split.mark_hash_split(df), split.mark_stratified_split(df, "label")):
        assert split.train_part(marked).count() + split.test_part(marked).count() == 150
    marked = split.mark_stratified_split(df, "label")
    sizes = {r["label"]: (r["n"], r["t"]) for r in marked.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert all(t == (n * 20 + 50) // 100 for n, t in sizes.values()) and None in sizes
    assert split.mark_folds(df).filter("fold is null").count() == 0


def test_more_labels_than_any_limit(spark):
    df = spark.range(6000).select(F.concat(F.lit("c"), "id").alias("customer_id"), (F.col("id") % 3000).alias("label"))
    marked = split.mark_stratified_split(df, "label", 50)
    assert marked.groupBy("label").agg(F.count_if("is_test").alias("t")).filter("t <> 1").count() == 0


def test_hot_label(spark):
    df = spark.range(30_000).select(F.concat(F.lit("c"), "id").alias("customer_id"), (F.col("id") > 29_990).cast("int").alias("label"))
    marked = split.mark_stratified_split(df, "label", 20)
    assert {r[0]: r[1] for r in marked.filter("is_test").groupBy("label").count().collect()} == {0: 5998, 1: 2}
