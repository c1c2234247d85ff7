"""Readers. Schemas are declared; a CSV table of unknown columns can be read with types inferred from all of its values."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronlens import schema

# Marks of a missing value in CSV text.
MISSING_MARKS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]
WHOLE = r"^[ \t]*[+-]?[0-9]+[ \t]*$"
DECIMAL = r"^[ \t]*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI]nf(inity)?)[ \t]*$"
TRUTH = ["True", "TRUE", "true"], ["False", "FALSE", "false"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the source tables of the profile."""
    return spark.read.schema(schema.SOURCE_TABLES[name]).parquet(os.path.join(folder, f"{name}.parquet"))


def read_customers_csv(spark: SparkSession, path: str) -> DataFrame:
    """Customer table from CSV with a header; a malformed line fails the read instead of turning null."""
    return (
        spark.read.schema(schema.CUSTOMER)
        .option("header", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def _known(column: str) -> Column:
    """The text of a value; null where it marks a missing one."""
    text = F.col(f"`{column}`")
    return F.when(~text.isin(MISSING_MARKS), text)


def infer_types(text: DataFrame, dates: bool = True) -> dict[str, str]:
    """The narrowest type that holds all values of each text column, from one aggregate over the whole table.

    ``boolean``; ``bigint`` if no value is missing, else ``double``; ``double``; ``date`` (ISO days, if asked for); else ``string``. Columns
    without a value are ``double``, truth values beside missing ones ``string``. Which rows come first or where files end decides nothing.
    """
    wanted = []
    for i, column in enumerate(text.columns):
        value = _known(column)
        whole = value.rlike(WHOLE) & F.trim(value).try_cast("bigint").isNotNull()
        kinds = {
            "n": F.count(value), "truth": F.count_if(value.isin([*TRUTH[0], *TRUTH[1]])), "whole": F.count_if(whole),
            "decimal": F.count_if(value.rlike(DECIMAL)),
            "day": F.count_if(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & value.try_cast("date").isNotNull()),
        }
        wanted += [count.alias(f"{kind}{i}") for kind, count in kinds.items()]
    row = text.agg(F.count(F.lit(1)).alias("rows"), *wanted).first()

    def kind_of(i: int) -> str:
        n, is_full = row[f"n{i}"], row[f"n{i}"] == row["rows"]
        if not n:
            return "double"
        if row[f"truth{i}"] == n:
            return "boolean" if is_full else "string"
        if row[f"whole{i}"] == n and is_full:
            return "bigint"
        if row[f"decimal{i}"] == n:
            return "double"
        return "date" if dates and row[f"day{i}"] == n else "string"

    return {column: kind_of(i) for i, column in enumerate(text.columns)}


def read_csv_inferred(spark: SparkSession, path: str, dates: bool = True, multi_line: bool = False) -> DataFrame:
    """A CSV table with a header and types inferred from every value.

    Large files are read in parts; only with ``multi_line``, for values with line breaks, each file is read whole by one task.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"', "enforceSchema": False, "nullValue": "\0", "emptyValue": ""}
    text = spark.read.options(**options).csv(path)
    types = infer_types(text, dates)

    def typed(column: str, kind: str) -> Column:
        value = _known(column)
        if kind == "boolean":
            value = value.isin(TRUTH[0])
        return (F.trim(value).cast(kind) if kind in ("bigint", "double") else value.cast(kind)).alias(column)

    return text.select(*[typed(column, kind) for column, kind in types.items()])


def read_customers_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.CUSTOMER).parquet(path)


def read_records_json(spark: SparkSession, path: str) -> DataFrame:
    """Scoring records, one JSON object per line; a missing field is null and fails validation later.

    A line that is no JSON object, or has a value of another type, keeps its text in ``schema.UNREAD``: one bad
    record of a batch is put aside, while a customer table with a bad line is not read at all.
    """
    return spark.read.schema(schema.SCORING_TEXT).option("columnNameOfCorruptRecord", schema.UNREAD).json(path)


def records_table(
    spark: SparkSession, records: Iterable[Mapping], struct: T.StructType = schema.SCORING
) -> DataFrame:
    """A table from records already in memory, such as the body of one request."""
    doubles = {f.name for f in struct if f.dataType == T.DoubleType()}

    def value(record: Mapping, name: str):
        found = record.get(name)
        return float(found) if name in doubles and found is not None else found

    rows = [tuple(value(record, name) for name in struct.names) for record in records]
    return spark.createDataFrame(rows, struct)
