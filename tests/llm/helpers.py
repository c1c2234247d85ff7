import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside or return.
CLASHING = ["id", "bits", "t", "label", "words", "spans", "n_words", "component_id", "score", "kept", "doc", "hash", "ids", "first", "n"]


def docs_of(spark, rows):
    """``documents`` of (doc_id, text) rows."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def with_clashes(docs):
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def prose(seed, n):
    """Words that hardly ever meet twice in a row."""
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(n))
