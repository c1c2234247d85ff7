"""Quality rules: base rules on counts, and an isolation forest on the same statistics.

Anomalous documents end on short paths of trees that split at random. Each tree is grown on
``TREE_ROWS`` documents of a sample of all documents (``TREES * TREE_ROWS`` rows at most, chosen by hash, a
property of the method); every document is scored. The threshold is calibrated on all labelled rows: the
lowest at which no more than ``GOOD_LOSS`` of the good ones that pass the base rules are lost.

Nulls: a null text has no words and fails the base rules. Without labels, or without good ones, the forest
rejects nothing. Repeated rows are scored alike; labels that are repeated for an id count as good if any is. An empty table
gives an empty result. Columns of documents that are not asked for are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronlens.llm.store import keep
from patronlens.llm.text import utf8_values

TREES = 100
TREE_ROWS = 256
SAMPLE_ROWS = TREES * TREE_ROWS
GOOD_LOSS = 0.005
SEED = 7
BINS = 1000
WINDOW = 5
# Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_bare"]
UPPER = bytes(range(65, 91))
MARKS = b"!?"
# Words of one ASCII character that is no letter and no digit.
BARE = {bytes([b]) for b in range(33, 127) if not bytes([b]).isalnum()}


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five that stand twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = end = 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def counts_of(data: bytes, code_points: int) -> tuple[int, ...]:
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    blanks = len(data) - sum(map(len, words))

    def held(characters: bytes) -> int:
        return len(data) - len(data.translate(None, characters))

    return (
        len(words), code_points - blanks, held(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), held(UPPER), held(MARKS), sum(map(BARE.__contains__, words)),
    )


def rule_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and the counts of every document."""
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            rows = [counts_of(d, n) for d, n in zip(utf8_values(batch.column(1)), sizes)]
            columns = list(zip(*rows)) or [[]] * len(COUNTS)
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in columns]]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", *COUNTS])

    fields = [T.StructField("id", source.schema["id"].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS]]
    return source.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_column)


def statistics() -> list[Column]:
    """Rates that do not depend on the length of a text."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    characters = F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.col("word_chars") / words,
        F.col("n_symbols") / words,
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / words,
        F.col("n_upper") / characters,
        F.col("n_marks") / words,
        F.col("n_bare") / words,
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def mean_path(rows: int) -> float:
    """Mean length of an unsuccessful search in a tree of that many rows."""
    if rows < 2:
        return 0.0
    return 1.0 if rows == 2 else 2 * (math.log(rows - 1) + 0.5772156649) - 2 * (rows - 1) / rows


class Forest:
    """Trees as arrays: split column and value, first child (the second follows), path length in leaves."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.trees = []
        rows = min(tree_rows, len(sample))
        self.scale = mean_path(rows) or 1.0
        self.depth = max(1, math.ceil(math.log2(max(rows, 2))))
        for _ in range(trees if rows else 0):
            self.trees.append(self._grow(sample[random.choice(len(sample), rows, replace=False)], random))

    def _grow(self, rows: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, ...]:
        column, value, child, path = [0], [0.0], [0], [0.0]
        waiting = [(0, rows, 0)]
        while waiting:
            node, part, depth = waiting.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.nonzero(high > low)[0]
            if depth == self.depth or not len(open_):
                path[node] = depth + mean_path(len(part))
                continue
            column[node] = int(random.choice(open_))
            value[node] = float(random.uniform(low[column[node]], high[column[node]]))
            child[node] = len(column)
            left = part[:, column[node]] <= value[node]
            for side in (part[left], part[~left]):
                waiting.append((len(column), side, depth + 1))
                column.append(0), value.append(0.0), child.append(0), path.append(0.0)
        return np.array(column), np.array(value), np.array(child), np.array(path)

    def anomaly(self, rows: np.ndarray) -> np.ndarray:
        """Score in 0..1, higher for shorter paths."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for column, value, child, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                inner = child[node] > 0
                right = rows[each, column[node]] > value[node]
                node = np.where(inner, child[node] + right, node)
            total += path[node]
        return 2.0 ** (-total / max(1, len(self.trees)) / self.scale)


def _sample(counts: DataFrame, rows: int) -> np.ndarray:
    """At most ``rows`` documents, chosen by hash; only about twice as many reach the driver."""
    total = counts.count()
    share = min(1.0, 2 * rows / max(total, 1))
    place = F.xxhash64(*counts.columns)
    limit = int(share * 2.0**64) - 2**63
    chosen = counts if share == 1.0 else counts.where(place < F.lit(min(limit, 2**63 - 1)))
    found = chosen.select(place.alias("place"), *[s.alias(f"s{i}") for i, s in enumerate(statistics())])
    values = sorted(tuple(r) for r in found.orderBy("place").limit(rows).collect())
    return np.array([v[1:] for v in values], dtype=float).reshape(len(values), len(statistics()))


def _scored(counts: DataFrame, forest: Forest) -> DataFrame:
    """``counts`` with ``bin``, the anomaly score in thousandths."""
    shared = counts.sparkSession.sparkContext.broadcast(vars(forest))
    columns = len(statistics())

    @F.pandas_udf("long")
    def bin_of(*values):
        held = Forest.__new__(Forest)
        vars(held).update(shared.value)
        return pd.Series(np.floor(held.anomaly(np.stack([v.to_numpy() for v in values], axis=1)) * BINS).astype("int64"))

    rates = counts.withColumns({f"s{i}": s.cast("double") for i, s in enumerate(statistics())})
    return rates.withColumn("bin", bin_of(*[f"s{i}" for i in range(columns)])).drop(*[f"s{i}" for i in range(columns)])


def calibrate(scored: DataFrame, labels: DataFrame, id_column: str = "doc_id", good_loss: float = GOOD_LOSS) -> int:
    """The largest bin that is kept."""
    known = labels.where("quality is not null").groupBy(id_column).agg(F.max("quality").alias("quality"))
    good = scored.where(~base_failed()).join(known.where("quality = 1"), id_column)
    bins = sorted(tuple(r) for r in good.groupBy("bin").count().collect())  # 1001 at most
    lost, allowed = 0, good_loss * sum(n for _, n in bins)
    for bin_, n in reversed(bins):
        if lost + n > allowed:
            return bin_
        lost += n
    return BINS


def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, the counts, ``base_failed``, ``anomaly`` (0..1) and ``kept``."""
    counts, _ = keep(rule_counts(docs, id_column, text_column), "counts")
    scored, _ = keep(_scored(counts, Forest(_sample(counts, SAMPLE_ROWS))), "scored")
    limit = calibrate(scored, labels, id_column)
    failed = base_failed()
    return scored.select(
        id_column, *COUNTS, failed.alias("base_failed"), (F.col("bin") / BINS).alias("anomaly"),
        (~failed & (F.col("bin") <= limit)).alias("kept"),
    )
