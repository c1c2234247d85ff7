import numpy as np
import pytest

from patronlens.operators import evaluate
from patronlens.operators.moments import correlation_matrix


def scores(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y_true int, probability double").repartition(6)


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("digits", [1, 2, 6])
@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_auc_equals_brute_force(spark, digits, ranges):
    rng = np.random.default_rng(digits)
    y = rng.integers(0, 2, 400)
    p = np.clip(rng.normal(0.4 + 0.2 * y, 0.3), 0, 1).round(digits)
    got = evaluate.auc_roc(scores(spark, y, p), ranges=ranges).first()[0]
    assert got == pytest.approx(brute_auc(y, p), abs=1e-12)


def test_auc_with_one_hot_score(spark):
    y = np.array([0, 1] * 200 + [1, 0])
    p = np.array([0.5] * 400 + [0.9, 0.1])
    assert evaluate.auc_roc(scores(spark, y, p)).first()[0] == pytest.approx(brute_auc(y, p))


def test_auc_of_one_class_is_undefined(spark):
    assert evaluate.auc_roc(scores(spark, [1, 1], [0.2, 0.3])).first()[0] is None


def test_undefined_precision_is_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y_true int, y_pred int")
    row = evaluate.classification_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_regression_metrics(spark):
    y, p = np.array([1.0, 2.0, 4.0, 0.0]), np.array([1.5, 2.0, 3.0, 1.0])
    row = evaluate.regression_metrics(spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y_true double, y_pred double")).first()
    e = y - p
    assert row["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
    assert row["r2"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert row["mape"] == pytest.approx(100 * np.abs(e[:3] / y[:3]).mean())


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(3)
    labels = np.repeat([0, 1, 2], [30, 50, 1])
    x = rng.normal(size=(81, 2)) + labels[:, None] * [3, 1]
    rows = [(int(c), float(a), float(b)) for c, (a, b) in zip(labels, x)]
    return labels, x, spark.createDataFrame(rows, "segment_id int, a double, b double").repartition(4)


def test_cluster_quality_by_hand(clusters):
    labels, x, df = clusters
    centers = np.array([x[labels == c].mean(axis=0) for c in range(3)])
    sizes = np.bincount(labels)
    between = (sizes * ((centers - x.mean(axis=0)) ** 2).sum(axis=1)).sum() / 2
    within = sum(((x[labels == c] - centers[c]) ** 2).sum() for c in range(3)) / (81 - 3)
    assert evaluate.calinski_harabasz(df, ["a", "b"]).first()[0] == pytest.approx(between / within)
    spread = [np.linalg.norm(x[labels == c] - centers[c], axis=1).mean() for c in range(3)]
    worst = [
        max((spread[i] + spread[j]) / np.linalg.norm(centers[i] - centers[j]) for j in range(3) if j != i)
        for i in range(3)
    ]
    assert evaluate.davies_bouldin(df, ["a", "b"]).first()[0] == pytest.approx(np.mean(worst))


def test_silhouette_by_hand(clusters):
    labels, x, df = clusters
    d = ((x[:, None] - x) ** 2).sum(axis=2)
    values = []
    for i, c in enumerate(labels):
        own = (labels == c).sum() - 1
        if not own:
            values.append(0.0)
            continue
        a = d[i, labels == c].sum() / own
        b = min(d[i, labels == o].mean() for o in range(3) if o != c)
        values.append((b - a) / max(a, b))
    assert evaluate.silhouette_squared(df, ["a", "b"]) == pytest.approx(np.mean(values))


def test_constant_feature_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 6.5)], "x double, c double, y double")
    got = {(r[0], r[1]): r[2] for r in correlation_matrix(df, ["x", "c", "y"]).collect()}
    assert got["x", "c"] is None and got["c", "c"] == 1.0
    assert got["x", "y"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1])


def test_rows_without_a_label_are_in_no_cluster(clusters, spark):
    labels, x, df = clusters
    with_nulls = df.unionByName(spark.createDataFrame([(None, 50.0, 50.0)] * 5, "segment_id int, a double, b double"))
    for metric in (evaluate.calinski_harabasz, evaluate.davies_bouldin):
        assert metric(with_nulls, ["a", "b"]).first()[0] == pytest.approx(metric(df, ["a", "b"]).first()[0])
    assert evaluate.silhouette_squared(with_nulls, ["a", "b"]) == pytest.approx(evaluate.silhouette_squared(df, ["a", "b"]))
    assert evaluate.cluster_count(with_nulls).first()[0] == 3


def test_one_cluster_has_no_score(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0)], "segment_id int, a double")
    assert evaluate.calinski_harabasz(df, ["a"]).first()[0] is None
    assert evaluate.davies_bouldin(df, ["a"]).first()[0] is None


def test_many_clusters(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 2))
    rows = [(i % 150, float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "segment_id int, a double, b double")
    member = np.arange(600) % 150
    centers = np.array([x[member == c].mean(axis=0) for c in range(150)])
    spread = np.array([np.linalg.norm(x[member == c] - centers[c], axis=1).mean() for c in range(150)])
    gaps = np.linalg.norm(centers[:, None] - centers, axis=2) + np.eye(150) * 1e9
    assert evaluate.davies_bouldin(df, ["a", "b"]).first()[0] == pytest.approx(((spread[:, None] + spread) / gaps).max(axis=1).mean())


def test_missing_predictions_leave_all_terms(spark):
    whole = [(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)]
    df = spark.createDataFrame([*whole, (100.0, None), (None, 3.0)], "y_true double, y_pred double")
    assert evaluate.regression_metrics(df).first() == evaluate.regression_metrics(spark.createDataFrame(whole, "y_true double, y_pred double")).first()


def plain_silhouette(points, labels):
    points, scores = np.array(points, float), []
    for i, own in enumerate(labels):
        apart = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        mean = {c: apart[[j for j, other in enumerate(labels) if other == c and j != i]] for c in set(labels)}
        if not len(mean[own]):
            scores.append(0.0)
            continue
        a, b = mean[own].mean(), min(m.mean() for c, m in mean.items() if c != own)
        scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(scores))


def clustered(spark, points, labels):
    rows = [(i, *map(float, p), None if c is None else int(c)) for i, (p, c) in enumerate(zip(points, labels))]
    return spark.createDataFrame(rows, "customer_id long, x double, y double, segment_id int").repartition(5)


def test_exact_silhouette(spark, monkeypatch):
    rng = np.random.default_rng(8)
    labels = [*rng.integers(0, 4, 299).tolist(), 9]  # one cluster of a single point
    points = rng.normal(size=(300, 2)) + np.array([[3 * c, -c] for c in labels])
    points[:20] = points[20:40]
    df = clustered(spark, points, labels)
    expected = plain_silhouette(points, labels)
    assert evaluate.silhouette(df, ["x", "y"]) == pytest.approx(expected, abs=1e-12)
    monkeypatch.setattr(evaluate, "TILE_ROWS", 7)
    assert evaluate.silhouette(df, ["x", "y"]) == pytest.approx(expected, abs=1e-12)


def test_silhouette_of_few_clusters(spark):
    assert evaluate.silhouette(clustered(spark, [(0, 0), (1, 1)], [1, 1]), ["x", "y"]) is None
    assert evaluate.silhouette(clustered(spark, [(0, 0), (1, 1)], [None, None]), ["x", "y"]) is None
    assert evaluate.silhouette(clustered(spark, [(0, 0), (0, 0), (0, 0)], [1, 1, 2]), ["x", "y"]) == 0.0
    assert evaluate.silhouette(clustered(spark, [(0, 0), (5, 5), (0, 1)], [1, None, 2]), ["x", "y"]) == 0.0


def test_silhouette_of_a_sample(spark):
    """The bound of the sample is kept, and the sample does not depend on the partitions."""
    rng = np.random.default_rng(9)
    labels = rng.integers(0, 3, 4000).tolist()
    points = rng.normal(size=(4000, 2)) + np.array([[6 * c, 0] for c in labels])
    df = clustered(spark, points, labels)
    some = evaluate.silhouette(df, ["x", "y"], rows=500)
    assert some == pytest.approx(evaluate.silhouette(df.repartition(3), ["x", "y"], rows=500), abs=1e-12)
    assert some == pytest.approx(evaluate.silhouette(df, ["x", "y"]), abs=0.03)
