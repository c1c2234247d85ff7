"""Which labelled rows a model may learn from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that no model learns from; a null id counts as the text "null"."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("null"))) % 5 == 0


def sample_labels(labels: DataFrame, label: str, rows: int, id_column: str = "doc_id") -> DataFrame:
    """``id, label, place``: at most ``rows`` labelled ids to learn from, chosen by hash.

    Null ids and null labels are left out; of several labels of an id the largest counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    one = known.groupBy(F.col(id_column).alias("id")).agg(F.max(label).cast("double").alias("label"))
    placed = one.withColumn("place", F.xxhash64("id", F.lit(label)))
    share = min(1.0, 1.5 * rows / max(placed.count(), 1))
    if share < 1.0:
        placed = placed.where(F.col("place") < F.lit(int(share * 2.0**64) - 2**63))
    return placed.orderBy("place", "id").limit(rows)
