import numpy as np
from helpers import docs_of, prose, with_clashes

from patronlens.llm import forest

LABELS = "doc_id long, quality int, bin string, n_words string"


def brute(text):
    text = text or ""
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    lines = [line for line in text.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else repeated(windows)
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def repeated(windows):
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    return twice


def labels_of(spark, rows):
    return spark.createDataFrame([(i, q, "x", "y") for i, q in rows], LABELS)


def test_given_documents(spark, folder, documents, document_rows):
    found = forest.quality_rules(documents, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    counts = sorted((r["doc_id"], *(r[c] for c in forest.COUNTS[:5])) for r in found)
    assert counts == sorted((i, *brute(t)) for i, t in document_rows)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["anomaly"] <= 1


def test_labelled_documents(spark, folder):
    """Next to no good document that passes the rules is lost; junk is."""
    large = folder.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{large}/labels.parquet")
    found = forest.quality_rules(spark.read.parquet(f"{large}/documents.parquet"), labels).where("not base_failed")
    rate = {r["quality"]: r["kept"] for r in found.join(labels, "doc_id").groupBy("quality").agg({"kept": "count"}).collect() for r in [{"quality": r[0], "kept": r[1]}]}
    kept = {r[0]: r[1] for r in found.where("kept").join(labels, "doc_id").groupBy("quality").count().collect()}
    assert kept[1] >= (1 - forest.GOOD_LOSS) * rate[1]
    assert kept.get(0, 0) <= 0.1 * rate[0]


def test_odd_rows(spark, odd_docs, odd_rows):
    found = forest.quality_rules(odd_docs, labels_of(spark, [(5, 1), (5, 0), (None, 1), (9, None), (99, 1)])).collect()
    assert sorted(((r["doc_id"], *(r[c] for c in forest.COUNTS[:5])) for r in found), key=str) == sorted(((i, *brute(t)) for i, t in odd_rows), key=str)
    assert [r["kept"] for r in found if r["doc_id"] == 5] == [True]


def test_empty_tables(spark, no_docs):
    assert forest.quality_rules(no_docs, labels_of(spark, [])).count() == 0
    docs = with_clashes(docs_of(spark, [(i, prose(i, 50)) for i in range(20)]))
    assert forest.quality_rules(docs, labels_of(spark, [])).where("kept").count() == 20
    assert forest.quality_rules(docs, labels_of(spark, [(1, 0)])).where("kept").count() == 20


def test_outliers_have_short_paths():
    random = np.random.default_rng(0)
    rows = np.vstack([random.normal(0, 1, (2000, 4)), random.normal(9, 0.5, (20, 4))])
    score = forest.Forest(rows).anomaly(rows)
    assert score[2000:].min() > np.quantile(score[:2000], 0.97)


def brute_path(tree, row, depth):
    column, value, child, path = tree
    node = 0
    for _ in range(depth):
        if not child[node]:
            break
        node = child[node] + (row[column[node]] > value[node])
    return path[node]


def test_path_lengths():
    random = np.random.default_rng(2)
    rows = random.normal(0, 1, (300, 3))
    grown = forest.Forest(rows, trees=5, tree_rows=64)
    mean = np.array([np.mean([brute_path(t, r, grown.depth) for t in grown.trees]) for r in rows])
    assert np.allclose(grown.anomaly(rows), 2.0 ** (-mean / forest.mean_path(64)))


def test_constant_rows():
    same = np.ones((50, 3))
    assert np.ptp(forest.Forest(same).anomaly(same)) == 0
    assert len(forest.Forest(np.empty((0, 3))).anomaly(np.ones((2, 3)))) == 2


def test_calibration(spark):
    rows = [(i, 20, 0, i % 100) for i in range(1000)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_repeat_words long, bin long")
    assert forest.calibrate(scored, labels_of(spark, [(i, 1) for i in range(1000)]), good_loss=0.05) == 94
    assert forest.calibrate(scored, labels_of(spark, [(i, 0) for i in range(1000)])) == forest.BINS
