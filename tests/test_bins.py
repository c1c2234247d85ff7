import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patronlens.functions import clip, cut, qcut_code, qcut_label, quantile_edges, round_half_even, safe_divide


def column(spark, values):
    """One column ``x`` with its position, so that the order can be restored."""
    rows = [(i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "i int, x double")


def evaluate(df, expression):
    return [row[0] for row in df.orderBy("i").select(expression).collect()]


def test_cut_is_right_closed_and_excludes_the_lowest_edge(spark):
    df = column(spark, [0.0, 5.0, 5.1, 15.0, 16.0, None])
    got = evaluate(df, cut("x", [0, 5, 9, 12, 15], ["a", "b", "c", "d"]))
    assert got == [None, "a", "b", "d", None, None]


def test_cut_needs_one_label_less_than_bins():
    with pytest.raises(ValueError):
        cut("x", [0, 1, 2], ["a"])


def test_qcut_merges_equal_edges(spark):
    df = column(spark, [0.0, 0, 0, 1, 2, 3, 4, 5, 6, 7])
    edges = quantile_edges(df, {"x": 5})["x"]
    assert evaluate(df, qcut_code("x", edges)) == [0, 0, 0, 0, 1, 1, 2, 2, 3, 3]


def test_qcut_of_one_row_is_null(spark):
    df = column(spark, [15.0])
    assert evaluate(df, qcut_code("x", quantile_edges(df, {"x": 5})["x"])) == [None]
    assert evaluate(df, qcut_label("x", quantile_edges(df, {"x": 4})["x"], ["a", "b", "c", "d"])) == [None]


def test_qcut_labels_of_merged_edges_are_the_lowest(spark):
    df = column(spark, [0.0, 0.0, 0.0, 0.0, 1.0])
    edges = quantile_edges(df, {"x": 4})["x"]
    assert evaluate(df, qcut_label("x", edges, ["a", "b", "c", "d"])) == ["a"] * 5


@pytest.mark.parametrize("seed", range(6))
def test_qcut_equals_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 12, 101).astype(float) if seed % 2 else rng.normal(size=101).round(2)
    values[rng.integers(0, 101, 5)] = np.nan
    df = column(spark, [None if np.isnan(v) else float(v) for v in values])
    edges = quantile_edges(df, {"x": 5})["x"]
    expected = pd.qcut(values, 5, labels=False, duplicates="drop")
    got = evaluate(df, qcut_code("x", edges))
    assert [None if np.isnan(e) else int(e) for e in expected] == got


def test_qcut_clamps_unseen_values_to_the_outer_bins(spark):
    df = column(spark, [-100.0, 100.0])
    assert evaluate(df, qcut_code("x", [0.0, 1.0, 2.0])) == [0, 1]


def test_clip_keeps_null(spark):
    df = column(spark, [-1.0, 0.5, 9.0, None])
    assert evaluate(df, clip("x", 0.0, 1.0)) == [0.0, 0.5, 1.0, None]


def test_safe_divide_and_try_divide(spark):
    df = column(spark, [0.0, 2.0])
    assert evaluate(df, safe_divide(F.lit(1.0), "x")) == [0.0, 0.5]
    assert evaluate(df, F.try_divide(F.lit(1.0), "x")) == [None, 0.5]


def test_rounding_equals_numpy(spark):
    values = [0.125, 2.675, 1.005, 123.4565, -0.375, 1.5, 2.5]
    assert evaluate(column(spark, values), round_half_even("x", 2)) == list(np.round(values, 2))
