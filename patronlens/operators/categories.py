"""Codes of a category column with any number of labels; no label passes the driver.

For the few account types a literal list is enough (:mod:`patronlens.operators.features`). Here the fitted labels are a table,
which is saved and read like any other: ``label`` and ``code``, its place in code-point order from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronlens.functions.windows import over_few_rows
from patronlens.staging import stage


def label_table(df: DataFrame, column: str) -> DataFrame:
    """Distinct labels with their codes; null is no label, an empty table has none.

    The labels are cut into ranges as the shuffle has partitions, written with the number of their range, and numbered inside
    it; the only table in one task has a row per range.
    """
    labels = df.select(F.col(column).alias("label")).filter(F.col("label").isNotNull()).distinct()
    ranges = stage(labels.repartitionByRange("label").withColumn("part", F.spark_partition_id()), "labels")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(over_few_rows().orderBy("part")) - F.col("n")
    starts = sizes.select("part", before.alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("label")) - 1
    return ranges.join(starts, "part").select("label", (F.col("start") + place).alias("code"))


def encode_by_table(df: DataFrame, column: str, table: DataFrame, unseen: str = "error") -> DataFrame:
    """Replace the column by the code of its value; null stays null.

    An unseen label fails, or becomes the number of labels with ``unseen="keep"``. Joined by value: Spark broadcasts the
    labels only below the session's threshold, and splits a label that many rows share otherwise (adaptive skew join).
    """
    label, code = "fitted_label_", "fitted_code_"
    while label in df.columns or code in df.columns:
        label, code = label + "_", code + "_"
    codes = table.select(F.col("label").alias(label), F.col("code").alias(code))
    value = F.col(column)
    if unseen == "keep":
        other = table.agg(F.count("*")).scalar()
    else:
        other = F.raise_error(F.concat(F.lit(f"unseen label in {column}: "), value.cast("string"))).cast("long")
    found = F.coalesce(F.col(code), F.when(value.isNotNull(), other))
    joined = df.join(codes, df[column] == codes[label], "left")
    return joined.withColumn(column, found).drop(label, code)
