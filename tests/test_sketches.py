"""Sketches per load date give nearly the quantiles of the whole table."""

import numpy as np
import pytest

from patronlens.functions import sketches
from patronlens.staging import staged


def rank_errors(values, quantiles, ranks):
    """How far each wanted rank lies outside the ranks that its value has, as a share of the rows."""
    ordered = np.sort(values)
    low, high = (np.searchsorted(ordered, quantiles, side) / len(ordered) for side in ("left", "right"))
    return np.maximum(np.maximum(low - ranks, ranks - high), 0)


@pytest.fixture(scope="module")
def columns():
    rng = np.random.default_rng(4)
    n = 60_000
    return {
        "skewed": rng.lognormal(3, 3, n),
        "tied": np.where(rng.random(n) < 0.34, 365.0, rng.integers(0, 400, n)),
        "rising": np.arange(n, dtype=float),
        "constant": np.full(n, 2.0),
    }


@pytest.fixture(scope="module")
def kept(spark, columns):
    days = np.arange(60_000) * 12 // 60_000
    rows = zip(days.tolist(), *[c.tolist() for c in columns.values()])
    df = spark.createDataFrame(rows, "day long, " + ", ".join(f"{c} double" for c in columns))
    with staged(sketches.column_sketches(df, list(columns), ["day"]), "sketches") as table:
        yield table


def test_ranks_within_the_error(kept, columns):
    ranks = np.linspace(0, 1, 41)
    found = sketches.sketched_quantiles(kept, {c: ranks for c in columns})
    for name, values in columns.items():
        assert rank_errors(values, np.array(found[name]), ranks).max() <= sketches.RANK_ERROR, name


def test_a_choice_of_dates(kept, columns):
    """Merging the sketches of some dates is a sketch of their rows, without reading them again."""
    some = kept.where("day >= 6")
    found = sketches.sketched_quantiles(some, {"rising": [0.0, 0.5, 1.0]})["rising"]
    assert found[0] == 30_000 and found[2] == 59_999 and abs(found[1] - 45_000) <= sketches.RANK_ERROR * 30_000
    assert {r["n"] for r in sketches.merge_sketches(some).collect()} == {30_000}


def test_merging_twice_is_merging_once(kept):
    halves = sketches.merge_sketches(kept.withColumn("half", kept.day % 2), ["half"])
    assert {r["n"] for r in sketches.merge_sketches(halves).collect()} == {60_000}


def test_edges(kept):
    found = sketches.sketched_edges(kept, {"constant": 5, "tied": 4, "skewed": 10})
    assert found["constant"] == [2.0] and 365.0 in found["tied"] and len(found["skewed"]) == 11


def test_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None)], "x double, y double")
    kept = sketches.column_sketches(df, ["x", "y"])
    assert sketches.sketched_quantiles(kept, {"x": [0, 1], "y": [0.5]}) == {"x": [1.0, 3.0], "y": [None]}
    assert sketches.sketched_quantiles(sketches.column_sketches(df.limit(0), ["x"]), {"x": [0.5]}) == {"x": [None]}
