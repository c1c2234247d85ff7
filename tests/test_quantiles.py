import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronlens.functions import exact_quantiles, order_statistics, quantile_edges
from patronlens.functions import quantiles as module


def frame(spark, **columns):
    names = list(columns)
    rows = [tuple(None if v is None else float(v) for v in row) for row in zip(*columns.values())]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(7)


def test_known_values(spark):
    df = frame(spark, x=[1, 2, 3, 10])
    assert exact_quantiles(df, {"x": ["0.99", "0.75"]})["x"] == pytest.approx([9.79, 4.75])


def test_empty_and_null_columns(spark):
    df = frame(spark, x=[None, None], y=[1, None])
    assert exact_quantiles(df, {"x": ["0.5"], "y": ["0.5"]}) == {"x": [None], "y": [1.0]}
    assert exact_quantiles(df.limit(0), {"x": ["0.5"]}) == {"x": [None]}


@pytest.mark.parametrize("buckets", [2, 16, 1024])
def test_equals_numpy_however_few_buckets(spark, monkeypatch, buckets):
    monkeypatch.setattr(module, "BUCKETS", buckets)
    rng = np.random.default_rng(1)
    n = 4000 if buckets > 2 else 300
    columns = {
        "smooth": rng.lognormal(3, 2, n),
        "hot": np.where(rng.random(n) < 0.4, 365.0, rng.integers(0, 365, n)),
        "constant": np.full(n, 2.0),
        "few": rng.integers(0, 3, n),
        "negative": -rng.lognormal(3, 2, n),
    }
    df = frame(spark, **columns)
    points = [Fraction(i, 5) for i in range(6)] + [Fraction(99, 100)]
    got = exact_quantiles(df, {name: points for name in columns})
    for name, values in columns.items():
        expected = np.quantile(values, [float(p) for p in points])
        assert got[name] == pytest.approx(list(expected), rel=1e-12)


def test_every_rank_of_a_tied_column(spark):
    values = sorted([0.0] * 5 + [1.0] * 3 + [2.0, 3.0, 3.0])
    df = frame(spark, x=values)
    got = order_statistics(df, {"x": F.col("x")}, {"x": range(len(values))})
    assert [got["x", i] for i in range(len(values))] == values


def test_values_of_every_size(spark):
    values = sorted([-math.inf, -1.7e308, -1e-300, -5e-324, 0.0, 5e-324, 1e-323, 1e-20, 1.0, 1 + 2**-52, 1e300, 1.7e308, math.inf])
    got = order_statistics(frame(spark, x=values), {"x": F.col("x")}, {"x": range(len(values))})
    assert [got["x", i] for i in range(len(values))] == values


def test_nan_is_missing(spark):
    values = [float("nan"), 5.0, None, 1.0, 3.0, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_quantiles(df, {"x": ["0", "0.5", "1"]})["x"] == [1.0, 3.0, 5.0]
    edges = quantile_edges(df, {"x": 4})["x"]
    assert edges == sorted(edges) and not any(map(math.isnan, edges))


def test_many_partitions(spark):
    df = spark.range(0, 20_000, 1, 300).select(F.pmod(F.col("id") * 7919, F.lit(20_000)).cast("double").alias("x"))
    assert exact_quantiles(df, {"x": ["0.25", "0.5"]})["x"] == [4999.75, 9999.5]


def spread(n, seed=2):
    rng = np.random.default_rng(seed)
    return {
        "decades": 10.0 ** rng.uniform(-307, 308, n),
        "both signs": rng.choice([-1.0, 1.0], n) * 10.0 ** rng.uniform(-300, 300, n),
        "tiny": 10.0 ** rng.uniform(-323, -300, n),
        "negative": -(10.0 ** rng.uniform(-300, 300, n)),
        "near one": 1 + rng.integers(0, 10**6, n) * 2.0**-52,
        "near a power": np.where(rng.random(n) < 0.5, 1e300, 1) * (1 + rng.integers(0, 99, n) * 2.0**-52),
        "constant": np.full(n, -7.5),
        "tied": rng.integers(-2, 3, n).astype(float),
        "with infinities": np.where(rng.random(n) < 0.2, rng.choice([-np.inf, np.inf], n), rng.normal(size=n)),
        "zeros": np.where(rng.random(n) < 0.8, 0.0, 10.0 ** rng.uniform(-320, 300, n)),
    }


@pytest.mark.parametrize("name", list(spread(1)))
def test_seven_passes_are_enough(spark, monkeypatch, name):
    rounds, plain = [], module._round
    monkeypatch.setattr(module, "_round", lambda *args: rounds.append(1) or plain(*args))
    values = spread(3000)[name]
    df = frame(spark, x=values).coalesce(2)
    ranks = list(range(0, 3000, 333))
    found = order_statistics(df, {"x": F.col("x")}, {"x": ranks})
    assert [found["x", r] for r in ranks] == np.sort(values)[ranks].tolist()
    assert len(rounds) <= 7


def test_buckets_never_fall(spark):
    """However the zero, the powers of two and the ends lie."""
    values = sorted({0.0, 5e-324, -5e-324, 1.0, -1.0, 1e308, -1e308, *(s * 2.0**e * m for s in (1, -1) for e in range(-1070, 1020, 7) for m in (1, 1.5))})
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    for low, high in ((-1e308, 1e308), (0.0, 1e308), (-1.0, 1.0), (5e-324, 1.0), (-1e308, -5e-324), (1.0, 16.5)):
        span = module._Span("x", low, high, 0, ())
        rows = df.where((F.col("x") >= low) & (F.col("x") <= high)).select("x", span.bucket(F.col("x")).alias("b")).collect()
        buckets = [r["b"] for r in sorted(rows, key=lambda r: r["x"])]
        assert buckets == sorted(buckets) and len(set(buckets)) > 1
