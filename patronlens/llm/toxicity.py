"""Toxicity: boosted trees over dense features, with isotonic calibration.

The features are rates per word: hits in a written lexicon, hits in a lexicon learned from labelled rows
(whole words and beginnings of words), hits close to a second-person word, capitals, marks, symbols, and
words written to get around a lexicon. Lexicon, trees and calibration learn from three separate parts of at most
``LEARN_ROWS`` labelled rows that are not held out; everything is scored.

Nulls: a null text is empty; an empty text has a score like any other (all rates are 0). Labels that are null are
not learned from, of several labels of an id the largest counts, of several texts the first in order. If the rows to learn from hold one class only, every score is the
share of toxic ones (0 without any). Repeated rows are scored alike, an empty table gives an empty result.
Columns that are not asked for are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronlens.llm.learning import held_out, sample_labels
from patronlens.llm.store import forget, keep
from patronlens.llm.text import blank_words, utf8_values

LEARN_ROWS = 40_000
LEXICON_TERMS = 5_000
LEAST_Z = 3.0
BEGINNINGS = (4, 5, 6)
TREES, DEPTH, STEP = 20, 4, 0.2
NEAR = 5
CACHED_WORDS = 200_000

INSULTS = """
idiot idiots idiotic moron morons moronic loser losers scum scumbag worthless trash garbage clown clowns pathetic disgusting
stupid stupidity dumb dumbass fool fools jerk jerks imbecile cretin retard retarded freak creep pig pigs rat vermin
filth filthy scumbags bastard bitch whore slut asshole arsehole shit bullshit fuck fucking fucker crap hate hateful
ugly despicable disgrace useless parasite coward liar nazi
idiota idiotas estupido estúpido imbécil tonto basura asqueroso asco patético mierda puta cabrón inútil escoria payaso
crétin connard connasse salaud salope merde ordure débile abruti dégueulasse minable bouffon nul
blöd blödmann dumm dummkopf trottel depp arschloch scheiße scheisse abschaum versager widerlich erbärmlich wertlos hurensohn
"""
SECOND_PERSON = """
you your yours yourself yourselves u ur youre
tu te ti tus tuyo vos vosotros usted ustedes
toi ton ta tes vous votre vos
du dich dir dein deine deinen euch euer ihr
"""
# What stands for letters in words that are written to get around a lexicon.
DISGUISES = [bytes.maketrans(b"0134578@$!+|", letters) for letters in (b"oieastbasiti", b"oleastbasiti")]
MIXED = re.compile(rb"[a-z\x80-\xff][0-9@$!*.\-_+|]+[a-z\x80-\xff]|^[0-9@$!*]+[a-z\x80-\xff]{2}")
ROWS = 256
EDGES = bytes(b for b in range(33, 128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
UPPER = bytes(range(65, 91))
WRITTEN, LEARNED, BEGINS, SECOND, DISGUISED, HIDDEN = (1 << i for i in range(6))
FEATURES = [
    "written", "learned", "begins", "hits", "weight", "strongest", "near", "second", "disguised", "hidden",
    "upper", "marks", "symbols", "words",
]


def terms_of(word: bytes) -> list[bytes]:
    """What the learned lexicon may hold of a word: the word, and its beginnings (behind a blank)."""
    return [word, *(b" " + word[:n] for n in BEGINNINGS if len(word) > n)]


def bare(token: bytes) -> bytes:
    return token.strip(EDGES)


def count_terms(docs: DataFrame) -> DataFrame:
    """``term, toxic, clean``: how many texts of ``docs`` (t, label) hold a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[bytes, list[int]] = {}
            for data, label in zip(utf8_values(batch.column(0)), batch.column(1).to_pylist()):
                words = {bare(w) for w in blank_words(data)} - {b""}
                for term in set(chain.from_iterable(map(terms_of, words))):
                    counts.setdefault(term, [0, 0])[label > 0] += 1
            clean, toxic = zip(*counts.values()) if counts else ((), ())
            arrays = [pa.array(list(counts), pa.binary()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["term", "toxic", "clean"])

    partial = docs.mapInArrow(run, "term binary, toxic long, clean long")
    return partial.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(docs: DataFrame) -> dict[bytes, float]:
    """Log-odds of the terms that mark toxic texts most surely, ``LEXICON_TERMS`` at most."""
    sizes = docs.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") == 0)).first()
    if not all(sizes):
        return {}
    toxic, clean = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(toxic / (sizes[0] + 1)) - F.log(clean / (sizes[1] + 1))
    terms = count_terms(docs).where("toxic >= 3").withColumn("odds", odds)
    sure = terms.withColumn("z", F.col("odds") / F.sqrt(1 / toxic + 1 / clean)).where(F.col("z") >= LEAST_Z)
    return {bytes(t): o for t, o in sure.orderBy(F.desc("z"), "term").limit(LEXICON_TERMS).select("term", "odds").collect()}


class Words:
    """Flags and weight of a token, looked up once per distinct token."""

    def __init__(self, learned: dict[bytes, float]):
        self.learned = learned
        self.insults = {w.encode() for w in INSULTS.split()}
        self.second = {w.encode() for w in SECOND_PERSON.split()}
        self.kinds: dict[tuple[int, float], int] = {(0, 0.0): 0}
        self.known: dict[bytes, int] = {}

    def _flags(self, token: bytes) -> tuple[int, float]:
        word = bare(token)
        found = [self.learned[t] for t in terms_of(word) if t in self.learned] if word else []
        flags = WRITTEN * (word in self.insults) | LEARNED * (word in self.learned) | SECOND * (word in self.second)
        flags |= BEGINS * (len(found) > (word in self.learned))
        if MIXED.search(word):
            plain = {word.translate(letters, b"*.-_") for letters in DISGUISES}
            flags |= DISGUISED | HIDDEN * bool(plain & self.insults or plain & self.learned.keys())
        return flags, max(found, default=0.0)

    def places(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        new = set(tokens).difference(known)
        if new:
            if len(known) > CACHED_WORDS:
                known.clear()
                new = set(tokens)
            for token in new:
                known[token] = self.kinds.setdefault(self._flags(token), len(self.kinds))
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def features(self, data: bytes) -> list[float]:
        tokens = blank_words(data)
        n = max(1, len(tokens))
        places = self.places(tokens)
        letters = max(1, len(data))
        upper = len(data) - len(data.translate(None, UPPER))
        marks = data.count(b"!") + data.count(b"?")
        symbols = sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|")))
        rest = [upper / letters, marks / n, symbols / n, float(np.log1p(len(tokens)))]
        if not places.any():
            return [0.0] * 10 + rest
        kinds = np.array([f for f, _ in self.kinds])[places]
        weights = np.array([w for _, w in self.kinds])[places]

        def count(flag: int) -> int:
            return int(np.count_nonzero(kinds & flag))

        hits = np.nonzero(kinds & (WRITTEN | LEARNED | BEGINS | HIDDEN))[0]
        second = np.nonzero(kinds & SECOND)[0]
        near = 0
        if len(hits) and len(second):
            at = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hits), np.abs(hits - second[np.maximum(at - 1, 0)]))
            near = int(np.count_nonzero(gap <= NEAR))
        return [
            100 * count(WRITTEN) / n, 100 * count(LEARNED) / n, 100 * count(BEGINS) / n, float(np.log1p(len(hits))),
            100 * float(weights.sum()) / n, float(weights.max()), 100 * near / n, 100 * len(second) / n,
            100 * count(DISGUISED) / n, float(count(HIDDEN)), *rest,
        ]


def with_features(docs: DataFrame, learned: dict[bytes, float], text_column: str) -> DataFrame:
    """``docs`` with its columns renamed ``c0, c1, ...``, and the features of every row's text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_column)
    source = docs.withColumn(text_column, F.col(text_column).cast("string")).toDF(*names)
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            rows = [words.features(data) for data in utf8_values(batch.column(at))]
            columns = list(zip(*rows)) or [[]] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.float64()) for c in columns]], names=[*names, *FEATURES])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, *[T.StructField(f, T.DoubleType()) for f in FEATURES]]))


def _both(rows: DataFrame) -> bool:
    return rows.select("label").distinct().count() == 2


class Scorer:
    """Lexicon, trees and curve, or one share for all where the labels say nothing."""

    def __init__(self, learned: dict[bytes, float], share: float, trees=None, curve=None):
        self.learned, self.share, self.trees, self.curve = learned, share, trees, curve
        self.assemble = VectorAssembler(inputCols=FEATURES, outputCol="vector")

    def raw(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(self.assemble.transform(rows)).withColumn("raw", F.round(vector_to_array("probability")[1], 3))

    def add_scores(self, docs: DataFrame, text_column: str, name: str) -> DataFrame:
        """``docs`` and its score in the column ``name``, in one pass over the rows."""
        rows = with_features(docs, self.learned, text_column)
        if self.trees is None:
            scored = rows.withColumn("score", F.lit(self.share))
        else:
            scored = self.raw(rows)
            scored = self.curve.transform(scored) if self.curve else scored.withColumn("score", F.col("raw"))
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score"))
        kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
        return scored.select(*kept, score.alias(name))


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic") -> Scorer:
    """A scorer from ``LEARN_ROWS`` labelled ids at most; of rows with one id the smallest text counts."""
    spark = docs.sparkSession
    chosen, chosen_path = keep(sample_labels(labels, label, LEARN_ROWS, id_column), "sample")
    part = F.pmod(F.xxhash64("place"), F.lit(10))  # 0..3 lexicon, 4..7 trees, 8..9 calibration
    # At most LEARN_ROWS ids, so they fit everywhere.
    some = F.broadcast(chosen.select("id", "label", part.alias("part")))
    to_read = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("t")).join(some, "id")
    texts, texts_path = keep(to_read.groupBy("id", "label", "part").agg(F.min("t").alias("t")), "learning")
    learned = learn_lexicon(texts.where("part < 4").select("t", "label"))
    share = float(chosen.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0])
    rest = with_features(texts.where("part >= 4").select("label", "part", "t"), learned, "t")
    rest = rest.withColumnsRenamed({"c0": "label", "c1": "part"}).drop("c2")
    training, training_path = keep(rest.coalesce(8), "training")
    fit, tune = training.where("part < 8"), training.where("part >= 8")
    scorer = Scorer(learned, share)
    if _both(fit):
        trees = GBTClassifier(labelCol="label", featuresCol="vector", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=5, checkpointInterval=-1)
        scorer.trees = trees.fit(scorer.assemble.transform(fit).select("vector", "label"))
        if _both(tune):
            # 1001 rows at most, however many were labelled.
            bins = scorer.raw(tune).groupBy("raw").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
            curve = IsotonicRegression(labelCol="label", featuresCol="raw", weightCol="weight", predictionCol="score")
            scorer.curve = curve.fit(bins.coalesce(1))
    forget(spark, chosen_path, texts_path, training_path)
    return scorer


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic"
) -> DataFrame:
    """``id_column, held_out, score`` (0..1, calibrated) and ``predicted`` of every document."""
    scorer = learn(docs, labels, id_column, text_column, label)
    scored = scorer.add_scores(docs.select(id_column, text_column), text_column, "score")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select(id_column, held_out(id_column).alias("held_out"), "score", predicted)


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic"
) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; each is judged by its own text, and no text is shuffled."""
    scorer = learn(docs, labels, id_column, text_column, label)
    return scorer.add_scores(docs, text_column, "_score").where("_score < 0.5").drop("_score")
