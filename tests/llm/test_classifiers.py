import numpy as np
import pytest
from helpers import docs_of, prose, with_clashes

from patronlens.llm import attention, toxicity
from patronlens.llm.learning import sample_labels

LABELS = "doc_id long, quality int, toxic int, label string, place string"


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], LABELS)


@pytest.fixture(scope="module")
def large(spark, folder):
    path = folder.replace("sf0.001", "sf0.1")
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


def held_out_rows(scored, labels, label):
    joined = scored.join(labels, "doc_id").where("held_out").collect()
    return np.array([[r["score"], r["predicted"], r[label]] for r in joined])


def area(rows):
    """Chance that a row of label 1 has the higher score."""
    good, bad = rows[rows[:, 2] == 1, 0], rows[rows[:, 2] == 0, 0]
    return np.mean((good[:, None] > bad) + 0.5 * (good[:, None] == bad))


def test_toxicity_held_out(large):
    rows = held_out_rows(toxicity.score_toxicity(*large), large[1], "toxic")
    assert area(rows) > 0.93
    toxic, clean = rows[rows[:, 2] == 1], rows[rows[:, 2] == 0]
    assert toxic[:, 1].mean() > 0.85 and clean[:, 1].mean() < 0.01
    assert ((rows[:, 0] >= 0.5) == (rows[:, 1] == 1)).all() and rows[:, 0].min() >= 0 and rows[:, 0].max() <= 1


def test_quality_held_out(large):
    rows = held_out_rows(attention.score_quality(*large), large[1], "quality")
    assert area(rows) > 0.98
    good, bad = rows[rows[:, 2] == 1], rows[rows[:, 2] == 0]
    assert good[:, 1].mean() > 0.99 and bad[:, 1].mean() < 0.1
    assert ((rows[:, 0] >= 0.3) == (rows[:, 1] == 1)).all() and rows[:, 0].min() >= 0 and rows[:, 0].max() <= 1


@pytest.mark.parametrize("score, label", [(toxicity.score_toxicity, "toxic"), (attention.score_quality, "quality")])
class TestOddInput:
    def test_odd_rows(self, spark, odd_docs, odd_rows, score, label):
        labels = labels_of(spark, [(i, i % 2, i % 2) for i in range(12)] + [(1, 0, 0), (None, 1, 1), (2, None, None), (99, 1, 1)])
        found = score(odd_docs, labels).collect()
        assert sorted((r["doc_id"] for r in found), key=str) == sorted((i for i, _ in odd_rows), key=str)
        assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in found)

    def test_no_documents(self, spark, no_docs, score, label):
        assert score(no_docs, labels_of(spark, [(1, 1, 1), (2, 0, 0)])).count() == 0

    def test_no_labels(self, spark, odd_docs, score, label):
        assert {r["score"] for r in score(odd_docs, labels_of(spark, [])).collect()} == {0.0}

    def test_one_class(self, spark, score, label):
        docs = with_clashes(docs_of(spark, [(i, prose(i, 20)) for i in range(30)]))
        assert {r["score"] for r in score(docs, labels_of(spark, [(i, 1, 1) for i in range(30)])).collect()} == {1.0}
        assert {r["score"] for r in score(docs, labels_of(spark, [(i, 0, 0) for i in range(30)])).collect()} == {0.0}


def test_labels_of_held_out_rows_are_not_read(spark, folder, documents):
    import zlib

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = [r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    wrong = labels.selectExpr("doc_id", f"if(doc_id in ({','.join(map(str, out))}), 1 - quality, quality) quality", "toxic")
    a = {r["doc_id"]: r["score"] for r in attention.score_quality(documents, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in attention.score_quality(documents, wrong).collect()}
    assert a == b
    assert {r["doc_id"] for r in attention.score_quality(documents, labels).where("held_out").collect()} == {
        r["doc_id"] for r in documents.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    }


def test_sample_is_bounded(spark):
    labels = labels_of(spark, [(i % 900, 1, i % 2) for i in range(3000)])
    chosen = sample_labels(labels, "toxic", 100).collect()
    assert len(chosen) == 100 == len({r["id"] for r in chosen})
    assert sample_labels(labels, "toxic", 10_000).count() < 900


def test_toxic_words():
    words = toxicity.Words({b"vequar": 4.0, b" lowe": 3.0})

    def features(text):
        return dict(zip(toxicity.FEATURES, words.features(text.encode())))

    assert features("You are an IDIOT, you.")["written"] == 20 and features("You are an IDIOT, you.")["near"] == 20
    assert features("plain words here")["hits"] == 0
    assert features("some 1d10t here")["hidden"] == 1 and features("some i.d.i.o.t here")["hidden"] == 1
    assert features("vequar")["learned"] == 100 and features("loweish")["begins"] == 100 and features("lowe")["begins"] == 0
    assert features("loweish")["strongest"] == 3.0
    assert features("WHAT!!! no?")["marks"] == 2.0 and features("")["words"] == 0


def test_attention_slopes():
    """Slopes of one step against differences."""
    random = np.random.default_rng(0)
    x, starts, y = random.normal(0, 1, (9, 5)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    model = attention.Attention(x)

    def loss():
        p = model.score(x, starts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    before = {k: v.copy() if v.shape else float(v) for k, v in model.weights.items()}
    slopes = {}
    for k in ("W", "V", "U", "w", "c"):
        at = tuple(0 for _ in before[k].shape)
        values = []
        for step in (1e-5, -1e-5):
            model.weights[k] = before[k].copy()
            model.weights[k][at] += step
            values.append(loss())
        model.weights[k] = before[k]
        slopes[k] = (values[0] - values[1]) / 2e-5 + attention.DECAY * before[k][at]
    epochs, attention.EPOCHS = attention.EPOCHS, 1
    try:
        model.fit(x, starts, y)
    finally:
        attention.EPOCHS = epochs
    for k, slope in slopes.items():
        at = tuple(0 for _ in before[k].shape)
        # The first step of the optimiser has the length of the rate and the sign of the slope.
        assert np.sign(before[k][at] - model.weights[k][at]) == np.sign(slope)


def test_attention_finds_the_one_bad_passage():
    random = np.random.default_rng(1)
    bags, labels = [], []
    for i in range(300):
        bag = random.normal(0, 1, (random.integers(1, 8), 6))
        if i % 2:
            bag[random.integers(len(bag)), 0] += 5
        bags.append(bag)
        labels.append(float(i % 2))
    x, starts = np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1]
    model = attention.Attention(x[: starts[200]])
    model.fit(x[: starts[200]], starts[:200], np.array(labels[:200]))
    found = model.score(x[starts[200] :], starts[200:] - starts[200]) > 0.5
    assert np.mean(found == np.array(labels[200:])) > 0.9


def test_long_documents_leave_the_others_in_the_sample(spark, monkeypatch):
    """The sample is bounded by passages of each document, not by documents."""
    monkeypatch.setattr(attention, "LEARN_PASSAGES", 120)
    rows = [(i, prose(i, 40_000 if i % 10 == 0 else 100) + (" ### $$$" * 20 if i % 2 else "")) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = attention.train(docs_of(spark, rows), labels, "doc_id", "text", "quality")
    assert isinstance(model, attention.Attention)
    sizes = [5, 1, 900, 3]
    assert attention._most(sizes, 909) == 900 and attention._most(sizes, 20) == 11 and attention._most(sizes, 2) == 1
