import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from patronlens.operators.categories import encode_by_table, label_table


def test_codes_are_alphabetical_places_for_very_many_labels(spark):
    n = 300_000
    df = spark.range(n * 2).select(F.format_string("k%07d", F.col("id") * 7919 % n).alias("k"))
    table = label_table(df, "k")
    wrong = table.filter(F.col("label") != F.format_string("k%07d", F.col("code")))
    assert table.count() == n and wrong.count() == 0
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan


def test_nulls_ties_unseen_labels_and_clashing_names(spark):
    fitted = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("",), ("é",), ("Z",)], "k string")
    table = label_table(fitted, "k")
    assert {r["label"]: r["code"] for r in table.collect()} == {"": 0, "Z": 1, "a": 2, "b": 3, "é": 4}
    rows = [(1, "b", "x", "p"), (2, None, "x", "q"), (3, "new", "y", None), (4, "a", None, "r")]
    df = spark.createDataFrame(rows, "id int, k string, label string, fitted_code_ string")
    out = encode_by_table(df, "k", table, "keep")
    assert out.columns == df.columns
    assert {r["id"]: r["k"] for r in out.collect()} == {1: 3, 2: None, 3: 5, 4: 2}
    assert {r["id"]: r["fitted_code_"] for r in out.collect()} == {1: "p", 2: "q", 3: None, 4: "r"}
    with pytest.raises(PySparkException, match="unseen label in k: new"):
        encode_by_table(df, "k", table).collect()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string")
    table = label_table(none, "k")
    assert table.count() == 0 and encode_by_table(none, "k", table).count() == 0
    df = spark.createDataFrame([("a",), (None,)], "k string")
    assert [r[0] for r in encode_by_table(df, "k", table, "keep").orderBy("k").collect()] == [None, 0]


def test_saved_table_gives_the_same_codes(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    label_table(df, "k").write.parquet(str(tmp_path / "labels"))
    again = spark.read.parquet(str(tmp_path / "labels"))
    assert sorted(r[0] for r in encode_by_table(df, "k", again).collect()) == [0, 1, 2]
