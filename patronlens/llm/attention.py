"""Quality classifier: attention over passages, learned from labels of whole documents.

A document is a bag of passages of ``PASSAGE`` words, all of them. A passage becomes a vector of dense statistics,
and a small layer encodes it: h = tanh(W x). Gated attention weighs the passages, a ~ exp(w (tanh(V h) * sigmoid(U h))),
and the score is a logistic function of the weighted mean of h. All of it is learned together from document
labels, on at most ``LEARN_DOCS`` documents with ``LEARN_PASSAGES`` passages, of the longest documents passages at even steps; every document is scored whole.

Nulls: a null text is empty; a text without words is one passage whose statistics are 0. Null labels are not
learned from, of several labels of an id the largest counts, of several texts the first in order. Without labels of both kinds the score is the share of good ones
(0 without any). Repeated rows are scored alike, an empty table gives an empty result. Columns that
are not asked for are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronlens.llm.learning import held_out, sample_labels
from patronlens.llm.store import forget, keep
from patronlens.llm.text import utf8_values

PASSAGE = 64
LEARN_DOCS = 6_000
LEARN_PASSAGES = 100_000
ENCODED, GATED = 24, 12
EPOCHS, RATE, DECAY = 120, 0.02, 1e-4
THRESHOLD = 0.3
SYMBOLS, MARKS, STOPS, DIGITS, UPPER = b"#*$%&|<>@_^~=+", b"!?", b".,;:", b"0123456789", bytes(range(65, 91))
HIGH = bytes(range(128, 256))
COLUMNS = 14


def statistics(words: list[bytes], doc_words: int) -> list[float]:
    """Statistics of one passage; the last one is the length of its document."""
    n = len(words)
    if not n:
        return [0.0] * COLUMNS
    data = b" ".join(words)
    size = len(data) - n + 1
    sizes = list(map(len, words))
    mean = size / n

    def held(characters: bytes) -> int:
        return len(data) - len(data.translate(None, characters))

    return [
        mean,
        (sum(s * s for s in sizes) / n - mean * mean) ** 0.5 if n > 1 else 0.0,
        held(UPPER) / size,
        held(SYMBOLS) / n,
        held(MARKS) / n,
        held(STOPS) / n,
        held(DIGITS) / size,
        held(HIGH) / size,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(s <= 2 for s in sizes) / n,
        max(sizes) / 20,
        n / PASSAGE,
        float(np.log1p(doc_words)),
    ]


def passages(data: bytes) -> list[list[float]]:
    words = data.split()
    return [statistics(words[i : i + PASSAGE], len(words)) for i in range(0, max(1, len(words)), PASSAGE)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Attention:
    """The network; bags are rows of ``x`` that follow each other and begin at ``starts``."""

    def __init__(self, x: np.ndarray, seed: int = 3):
        random = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        shapes = {"W": (x.shape[1], ENCODED), "b": (ENCODED,), "V": (ENCODED, GATED), "U": (ENCODED, GATED), "w": (GATED,), "c": (ENCODED,), "d": ()}
        self.weights = {k: random.normal(0, 1, s) / max(1, s[0] if s else 1) ** 0.5 * (k not in "bd") for k, s in shapes.items()}

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        p = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        sizes = np.diff([*starts, len(x)])
        logits = (v * u) @ p["w"]
        power = np.exp(logits - np.repeat(np.maximum.reduceat(logits, starts), sizes))
        a = power / np.repeat(np.add.reduceat(power, starts), sizes)
        pooled = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return z, h, v, u, a, sizes, pooled, pooled @ p["c"] + p["d"]

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return _sigmoid(self._forward(x, starts)[-1])

    def fit(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> None:
        moments = {k: [np.zeros_like(w), np.zeros_like(w)] for k, w in self.weights.items()}
        for epoch in range(1, EPOCHS + 1):
            p = self.weights
            z, h, v, u, a, sizes, pooled, out = self._forward(x, starts)
            error = (_sigmoid(out) - y) / len(y)
            spread = np.repeat(error, sizes)
            to_pooled = spread[:, None] * p["c"]
            share = (h * to_pooled).sum(axis=1)
            to_logit = a * (share - np.repeat(np.add.reduceat(a * share, starts), sizes))
            to_gate = to_logit[:, None] * p["w"]
            dv, du = to_gate * u * (1 - v * v), to_gate * v * u * (1 - u)
            dh = (a[:, None] * to_pooled + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
            slopes = {"W": z.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ to_logit, "c": pooled.T @ error, "d": error.sum()}
            for k, slope in slopes.items():
                slope = slope + DECAY * p[k]
                m = moments[k]
                m[0], m[1] = 0.9 * m[0] + 0.1 * slope, 0.999 * m[1] + 0.001 * slope * slope
                p[k] = p[k] - RATE * (m[0] / (1 - 0.9**epoch)) / (np.sqrt(m[1] / (1 - 0.999**epoch)) + 1e-8)


def _bags(docs: DataFrame) -> DataFrame:
    """``id, label, n, x``: all passages of every document of ``docs`` (id, label, t), row by row in one array."""
    schema = T.StructType([docs.schema["id"], docs.schema["label"], T.StructField("n", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [passages(data) for data in utf8_values(batch.column(2))]
            arrays = [
                batch.column(0), batch.column(1), pa.array(list(map(len, bags)), pa.int64()),
                pa.array([[v for row in bag for v in row] for bag in bags], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "label", "n", "x"])

    return docs.select("id", "label", "t").mapInArrow(run, schema)


def _most(sizes: list[int], limit: int) -> int:
    """The most passages that each document can give so that all together stay within ``limit``; one at least."""
    most, left = 1, limit
    for rank, n in enumerate(sorted(sizes)):
        share = left // (len(sizes) - rank)
        if n > share:
            return max(1, share)
        most, left = n, left - n
    return most


def train(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label: str) -> Attention | float:
    """The network, or the share of good documents if there is nothing to tell apart."""
    spark = docs.sparkSession
    chosen, chosen_path = keep(sample_labels(labels, label, LEARN_DOCS, id_column), "sample")
    # At most LEARN_DOCS ids.
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("t")).join(F.broadcast(chosen), "id")
    one_each = texts.groupBy("id", "label").agg(F.min("t").alias("t"))
    bags, bags_path = keep(_bags(one_each), "bags")
    most = _most([r["n"] for r in bags.select("n").collect()], LEARN_PASSAGES)
    taken = F.least("n", F.lit(most))
    # Passages of a longer document are taken at even steps.
    spread = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.slice("x", F.floor(i * F.col("n") / most).cast("int") * COLUMNS + 1, COLUMNS)))
    some = bags.select(F.xxhash64("id").alias("p"), "label", taken.alias("n"), F.when(F.col("n") > most, spread).otherwise(F.col("x")).alias("x"))
    rows = sorted(some.collect(), key=lambda r: (r["p"], r["n"]))
    forget(spark, chosen_path, bags_path)
    y = np.array([r["label"] for r in rows])
    if not len(rows) or y.min() == y.max():
        return float(y.mean()) if len(rows) else 0.0
    x = np.concatenate([np.array(r["x"]).reshape(-1, COLUMNS) for r in rows])
    starts = np.cumsum([0, *[r["n"] for r in rows][:-1]])
    model = Attention(x)
    model.fit(x, starts, y)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "quality") -> DataFrame:
    """``id_column, held_out, score, predicted`` and ``n_passages`` of every document."""
    model = train(docs, labels, id_column, text_column, label)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model) if isinstance(model, Attention) else {"share": model})
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("t"))
    schema = T.StructType([source.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        network = Attention.__new__(Attention)
        vars(network).update(parts)
        for batch in batches:
            bags = [passages(data) for data in utf8_values(batch.column(1))]
            sizes = np.array(list(map(len, bags)), np.int64)
            if "share" in parts or not len(bags):
                scores = np.full(len(bags), parts.get("share", 0.0))
            else:
                scores = network.score(np.array([row for bag in bags for row in bag]), np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(sizes)], names=["id", "score", "n_passages"])

    scored = source.mapInArrow(run, schema)
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select(F.col("id").alias(id_column), held_out("id").alias("held_out"), "score", predicted, "n_passages")
