"""Cleaning of customer tables and validation of scoring records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronlens import schema
from patronlens.functions import clip, exact_quantiles, present
from patronlens.staging import stage, staged

# Columns that cannot be negative.
NON_NEGATIVE = ["tenure_days", "total_purchases", "monetary", "customer_lifetime_value", "avg_purchase_amount"]

KEY_ROWS = "rows_of_key"


def drop_duplicate_keys(df: DataFrame, order_by: Sequence[str] = (), key: str = "customer_id") -> DataFrame:
    """One row per key: the first by ``order_by``, then by the remaining columns.

    An aggregate instead of a window: copies of a key collapse in the map tasks, so a key with a third
    of all rows does not land whole in one task.
    """
    return counted_keys(df, order_by, key).drop(KEY_ROWS)


def counted_keys(df: DataFrame, order_by: Sequence[str] = (), key: str = "customer_id") -> DataFrame:
    """:func:`drop_duplicate_keys` with the rows of each key in ``KEY_ROWS``, so that one pass gives the table and its counts."""
    rest = [c for c in df.columns if c != key and c not in order_by]
    ordered = F.struct(*order_by, *rest)
    return df.groupBy(key).agg(F.min(ordered).alias("row"), F.count(F.lit(1)).alias(KEY_ROWS)).select(
        *[F.col(c) if c == key else F.col(f"row.{c}").alias(c) for c in df.columns], KEY_ROWS
    )


def counts_of_keys(counted: DataFrame) -> DataFrame:
    """Rows before and after the duplicates went, as one row; ``counted`` is read once, and with it the table before."""
    return counted.agg(F.coalesce(F.sum(KEY_ROWS), F.lit(0)).alias("rows_before"), F.count(F.lit(1)).alias("rows_after"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


@dataclass(frozen=True)
class CleanStats:
    """Column medians and the cap on lifetime value."""

    medians: dict[str, float | None]
    clv_cap: float | None


def fit_medians(df: DataFrame) -> dict[str, float | None]:
    """Exact median of every numeric column."""
    names = numeric_columns(df)
    found = exact_quantiles(df, {c: ["0.5"] for c in names})
    return {name: values[0] for name, values in found.items()}


def fill_medians(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """Missing values become the median; filled columns are doubles, as a median may fall between two integers."""
    return df.withColumns({c: F.coalesce(present(c), F.lit(m)) for c, m in medians.items() if m is not None})


def fit_clv_cap(df: DataFrame) -> float | None:
    """99th percentile of lifetime value."""
    return exact_quantiles(df, {schema.CLV_TARGET: ["0.99"]})[schema.CLV_TARGET][0]


def cap_lifetime_value(df: DataFrame, cap: float | None) -> DataFrame:
    if schema.CLV_TARGET not in df.columns or cap is None:
        return df
    return df.withColumn(schema.CLV_TARGET, clip(schema.CLV_TARGET, high=cap))


def floor_at_zero(df: DataFrame, columns: Sequence[str] = NON_NEGATIVE) -> DataFrame:
    """No negative values in the given columns that exist."""
    return df.withColumns({c: clip(c, low=0) for c in columns if c in df.columns})


def fit_clean(deduplicated: DataFrame) -> CleanStats:
    """Statistics in the order of use: medians first, then the cap on the filled lifetime values."""
    medians = fit_medians(deduplicated)
    if schema.CLV_TARGET not in deduplicated.columns:
        return CleanStats(medians, None)
    only_clv = {schema.CLV_TARGET: medians[schema.CLV_TARGET]}
    return CleanStats(medians, fit_clv_cap(fill_medians(deduplicated.select(schema.CLV_TARGET), only_clv)))


def apply_clean(deduplicated: DataFrame, stats: CleanStats) -> DataFrame:
    """Fill, cap and floor with fitted statistics."""
    return (
        deduplicated.transform(fill_medians, stats.medians)
        .transform(cap_lifetime_value, stats.clv_cap)
        .transform(floor_at_zero)
    )


def clean_customers(df: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """Deduplicate, fill, cap and floor, in this order; the result is a staged table."""
    with staged(drop_duplicate_keys(df, order_by), "deduplicated") as deduplicated:
        return stage(apply_clean(deduplicated, fit_clean(deduplicated)), "cleaned")


def row_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after cleaning, as one row."""
    tagged = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    return tagged.agg(F.count_if(F.col("b") == 1).alias("rows_before"), F.count_if(F.col("a") == 1).alias("rows_after"))


# Allowed ranges of a scoring record, (column, lowest, highest).
RANGE_RULES = [
    ("age", 18, 100),
    ("tenure_days", 0, None),
    ("recency", 0, None),
    ("frequency", 0, None),
    ("monetary", 0, None),
    ("email_open_rate", 0, 100),
    ("website_visits_per_month", 0, None),
    ("support_tickets", 0, None),
    ("avg_purchase_amount", 0, None),
    ("purchase_frequency", 0, None),
    ("days_since_last_purchase", 0, None),
]


def broken_range_rules() -> Column:
    """Names of the numeric fields that are missing or out of range."""
    broken = []
    for name, low, high in RANGE_RULES:
        c = F.col(name)
        bad = c.isNull() | F.isnan(c.cast("double")) | (c < low)
        if high is not None:
            bad = bad | (c > high)
        broken.append(F.when(bad, name))
    return F.array_compact(F.array(*broken))


def broken_account_rule() -> Column:
    """``account_type`` where it is missing or not a known type."""
    c = F.col("account_type")
    known = c.isin(list(schema.ACCOUNT_TYPE_MULTIPLIER))
    return F.array_compact(F.array(F.when(c.isNull() | ~known, "account_type")))


def mark_violations(records: DataFrame) -> DataFrame:
    """Add ``violations``, the names of the fields that break a rule.

    A record that was read from text and did not fit (``schema.UNREAD`` holds the text) breaks the rule of that name too.
    """
    broken = [broken_range_rules(), broken_account_rule()]
    if schema.UNREAD in records.columns:
        broken.append(F.array_compact(F.array(F.when(F.col(schema.UNREAD).isNotNull(), schema.UNREAD))))
    return records.withColumn("violations", F.concat(*broken))


def valid_records(marked: DataFrame) -> DataFrame:
    return marked.filter(F.size("violations") == 0).drop("violations", schema.UNREAD)


def quarantined_records(marked: DataFrame) -> DataFrame:
    """Rejected rows with the reason; the batch goes on without them."""
    return marked.filter(F.size("violations") > 0)
