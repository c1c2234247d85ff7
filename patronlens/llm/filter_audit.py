"""Filter interaction audit: what every filter removes under each order of five filters, by Lehmer ranks.

1. Masks. Every row gets one bit for each filter that it fails. Four of them show in the text; the fifth, a text that a
   smaller id has too, is found by digests: rows are counted per (digest, part), of which one row is left for every map
   task, and only the rows of the smallest id of a digest do not fail it.
2. Intervals. Orders are ranked as their letters sort. All orders with one prefix of ``k`` letters stand side by side,
   ``(5 - k)!`` of them from the rank that the Lehmer code of the prefix gives. A mask is removed at step ``k`` exactly under the
   prefixes whose last letter is the first one that it fails, so each mask and step covers a few intervals of ranks.
3. Differences. The documents of a mask are added at the start of each interval and taken off at its end; a sum along
   the 120 ranks gives what each step removes under every order. All other columns follow from that and from the counts of the masks.

Nulls: a null text is empty; a null part is the empty string; a row with a null id has no label, is a copy of none and makes
no copies. Rows that share id and text are no copies of each other and all count. Labels: several rows of one id count by their largest
value, null is no label. An empty table has no parts and gives no rows. Other columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronlens.llm.text import utf8_values

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITAL_PERCENT = 2
MARKS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
CONTINUATION = bytes(range(128, 192))
COPY = 1 << FILTERS.index("E")
SALTS = 1024


def text_mask(data: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = data.split()
    n = len(words)
    points = len(data.translate(None, CONTINUATION))
    capitals = len(data) - len(data.translate(None, CAPITALS))
    fails = (
        n < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT_PERCENT * n,
        100 * capitals > MOST_CAPITAL_PERCENT * points,
        len(data.translate(None, MARKS)) < len(data),
    )
    return sum(fail << i for i, fail in enumerate(fails))


def text_masks(docs: DataFrame, id_column: str, text_column: str, part_column: str) -> DataFrame:
    """``id, part, digest, mask`` of every row, with the bits that show in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(hashlib.sha256(t).digest(), text_mask(t)) for t in utf8_values(batch.column(2))]
            digests, masks = zip(*found) if found else ((), ())
            columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "digest", "mask"])

    part = F.coalesce(F.col(part_column).cast("string"), F.lit(""))
    source = docs.select(F.col(id_column).alias("id"), part.alias("part"), F.col(text_column).cast("string").alias("t"))
    schema = T.StructType([source.schema["id"], source.schema["part"], T.StructField("digest", T.BinaryType()), T.StructField("mask", T.IntegerType())])
    return source.mapInArrow(run, schema)


def mask_counts(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "source",
) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part with each set of failed filters."""
    # Repeated rows are one row from here on.
    rows = text_masks(docs, id_column, text_column, part_column).groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    flags = labels.groupBy(F.col(id_column).alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    # Rows without an id match no label; they are spread over the tasks of the join.
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS))).otherwise(0)
    rows, flags = rows.withColumn("salt", spread), flags.where("label_id is not null").withColumn("label_salt", F.lit(0).cast("long"))
    joined = rows.join(flags, (F.col("id") == F.col("label_id")) & (F.col("salt") == F.col("label_salt")), "left")
    joined = joined.select("id", "part", "digest", "mask", "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    counts = ("n", "good", "toxic")
    texts = joined.groupBy("digest", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in counts],
        F.min("id").alias("least"),
        *[F.min_by(c, "id").alias(f"first_{c}") for c in counts],
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("without_id"),
    )
    # One row for each part that has the text.
    least = F.min("least").over(Window.partitionBy("digest"))
    texts = texts.withColumn("is_first", F.coalesce(F.col("least") == least, F.lit(False)))

    def first(column: str) -> Column:
        found = F.when(F.col("is_first"), F.col(f"first_{column}")).otherwise(0)
        return found + F.col("without_id") if column == "n" else found

    kinds = F.array(
        F.struct(F.col("mask"), *[first(c).alias(c) for c in counts]),
        F.struct((F.col("mask") + COPY).alias("mask"), *[(F.col(c) - first(c)).alias(c) for c in counts]),
    )
    both = texts.select("part", F.explode(kinds).alias("k")).select("part", "k.*").where("n > 0")
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in counts])


def removal_intervals(mask: int, filters: int = len(FILTERS)) -> list[tuple[int, int, int]]:
    """``step, first rank, rank behind the last`` of all runs of orders under which ``mask`` is removed at ``step``."""
    found = []

    def walk(used: int, rank: int, step: int) -> None:
        size = factorial(filters - step)
        for digit, letter in enumerate(f for f in range(filters) if not used >> f & 1):
            low = rank + digit * size
            if mask >> letter & 1:
                found.append((step, low, low + size))
            else:
                walk(used | 1 << letter, low, step + 1)

    if mask:
        walk(0, 0, 1)
    return found


def interval_ends(filters: int = len(FILTERS)) -> list[tuple[int, int, int, int]]:
    """``mask, step, rank, change``: where the intervals of all masks begin and end; runs that meet have no end between them."""
    changes: Counter = Counter()
    for mask in range(1 << filters):
        for step, low, high in removal_intervals(mask, filters):
            changes[mask, step, low] += 1
            changes[mask, step, high] -= 1
    return [(*key, change) for key, change in sorted(changes.items()) if change and key[2] < factorial(filters)]


def _ends(spark: SparkSession) -> DataFrame:
    """Rows that depend on the number of filters only: some hundreds."""
    return F.broadcast(spark.createDataFrame(interval_ends(), "mask int, step int, rank int, change int"))


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order and step for ``counts`` (part, mask, n, good, toxic; one row per part and mask)."""
    size, orders = len(FILTERS), ["".join(p) for p in permutations(FILTERS)]
    changes = counts.join(_ends(counts.sparkSession), "mask").groupBy("part", "step", "rank")
    changes = changes.agg(*[F.sum(F.col(c) * F.col("change")).alias(c) for c in ("n", "good", "toxic")])

    def fails(i: int) -> Column:
        return F.col("mask").bitwiseAND(1 << i) != 0

    parts = counts.groupBy("part").agg(
        F.sum("n").alias("documents"),
        F.array(*[F.coalesce(F.sum(F.when(fails(i), F.col("n"))), F.lit(0)) for i in range(size)]).alias("fails"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == 1 << i, F.col("n"))), F.lit(0)) for i in range(size)]).alias("only"),
    )
    place = F.explode(F.sequence(F.lit(0), F.lit(size * len(orders) - 1)))
    cells = parts.withColumn("cell", place).withColumn("rank", F.floor(F.col("cell") / size).cast("int"))
    cells = cells.withColumn("step", (F.col("cell") % size + 1).cast("int"))
    cells = cells.withColumn("filter_order", F.element_at(F.array(*map(F.lit, orders)), F.col("rank") + 1))
    cells = cells.withColumn("letter", F.instr(F.lit(FILTERS), F.expr("substring(filter_order, step, 1)")))
    # From here on a part is in one partition, with a row for each cell.
    filled = cells.repartition("part").join(changes, ["part", "step", "rank"], "left")
    along_ranks = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    along_steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    names = {"n": "removed", "good": "good_lost", "toxic": "toxic_lost"}
    summed = filled.select(
        "part", "filter_order", "rank", "step", "letter", "documents", "fails", "only",
        *[F.sum(F.coalesce(c, F.lit(0))).over(along_ranks).alias(name) for c, name in names.items()],
    )
    summed = summed.withColumn("gone", F.sum("removed").over(along_steps))
    summed = summed.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
    return summed.select(
        "part", "filter_order", "step", (F.col("documents") - F.col("gone")).alias("kept"), "removed",
        (F.element_at("fails", F.col("letter")) - F.col("removed")).alias("redundant"),
        F.element_at("only", F.col("letter")).alias("unique_fails"), "good_lost", "toxic_lost", "shapley",
    )
