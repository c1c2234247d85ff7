"""One profile row per customer from the customer, order and event tables.

Orders and events are aggregated before the joins, so only one row per customer and side is joined
and a customer with very many orders is combined in the map tasks. Amounts are summed as whole cents:
the sum does not depend on the order of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens import schema
from patronlens.functions import clip, exact_quantiles, round_half_even, safe_divide

# Upper bounds of the measures.
MAX_TENURE = 1825
MAX_RECENCY = 365
MAX_FREQUENCY = 20
MAX_CLV = 50000

# Which market segments stand for which account type.
ACCOUNT_TYPE_SEGMENTS = {
    "Basic": ["HOUSEHOLD", "FURNITURE"],
    "Premium": ["AUTOMOBILE", "BUILDING"],
    "Enterprise": ["MACHINERY"],
}


def order_totals(orders: DataFrame) -> DataFrame:
    """Purchases, spend in cents, first and last order date per customer."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return orders.groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.count("*").cast("int").alias("total_purchases"),
        F.sum(cents).alias("total_cents"),
        F.min("o_orderdate").cast("date").alias("first_order"),
        F.max("o_orderdate").cast("date").alias("last_order"),
    )


def event_totals(events: DataFrame) -> DataFrame:
    """Views, clicks, visits and error reports per user."""
    kind = F.col("event_type")
    return (
        events.filter(kind.isin("view", "click", "purchase", "error"))
        .groupBy(F.col("user_id").alias("custkey"))
        .agg(
            F.count_if(kind == "view").alias("views"),
            F.count_if(kind == "click").alias("clicks"),
            F.count_if(kind != "error").alias("visits"),
            F.count_if(kind == "error").alias("errors"),
        )
    )


def day_after_last_order(orders: DataFrame) -> Column:
    """Scalar subquery over the date column only; pass a fixed date instead to make re-runs repeatable."""
    return orders.agg(F.date_add(F.max("o_orderdate").cast("date"), 1)).scalar()


def account_type(market_segment: Column | str = "c_mktsegment") -> Column:
    """Account type of a market segment."""
    c = F.col(market_segment) if isinstance(market_segment, str) else market_segment
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, segments in ACCOUNT_TYPE_SEGMENTS.items():
        out = out.when(c.isin(segments), name)
    return out


def type_multiplier(account: Column | str = "account_type") -> Column:
    """Purchase multiplier of an account type."""
    c = F.col(account) if isinstance(account, str) else account
    pairs = schema.ACCOUNT_TYPE_MULTIPLIER.items()
    return reduce(lambda out, pair: out.when(c == pair[0], pair[1]), pairs, F.when(F.lit(False), F.lit(None).cast("double")))


def add_purchases(df: DataFrame) -> DataFrame:
    """Count, mean and total of purchases; a customer without orders has 0 of each."""
    n = F.coalesce("total_purchases", F.lit(0))
    cents = F.coalesce("total_cents", F.lit(0))
    return df.withColumns(
        {
            "total_purchases": n,
            "avg_purchase_amount": safe_divide(cents, n * F.lit(100000.0)),
            "monetary": cents / F.lit(100000.0),
        }
    )


def add_dates(df: DataFrame, as_of: Column) -> DataFrame:
    """Tenure and recency in days; without orders they stand at the unfavourable bound."""
    days = {"days_first": F.datediff("today", "first_order"), "days_last": F.datediff("today", "last_order")}
    return df.withColumn("today", as_of).withColumns(days).withColumns(
        {
            "tenure_days": F.coalesce(clip("days_first", 1, MAX_TENURE), F.lit(1)),
            "recency": F.coalesce(clip("days_last", 0, MAX_RECENCY), F.lit(MAX_RECENCY)),
        }
    )


def add_frequency(df: DataFrame) -> DataFrame:
    """Purchases per month and per year, days since the last one."""
    monthly = clip(F.try_divide(F.col("total_purchases"), F.col("tenure_days") / 30), 0.0, float(MAX_FREQUENCY))
    return df.withColumns(
        {
            "frequency": monthly,
            "purchase_frequency": monthly * 12,
            "days_since_last_purchase": F.col("recency"),
        }
    )


def add_engagement_counts(df: DataFrame) -> DataFrame:
    """Open rate in percent, visits per month and tickets; 0 for customers without events."""
    zero = F.lit(0)
    return df.withColumns(
        {
            "email_open_rate": safe_divide(F.col("views") * F.lit(100.0), F.col("views") + F.col("clicks")),
            "website_visits_per_month": F.coalesce("visits", zero).cast("double"),
            "support_tickets": F.coalesce("errors", zero).cast("int"),
        }
    )


def add_lifetime_value(df: DataFrame) -> DataFrame:
    """Retention factor and lifetime value."""
    retention = 1 - (F.col("recency") / 365) * 0.3
    value = F.col("avg_purchase_amount") * F.col("frequency") * 12 * (F.col("tenure_days") / 365) * retention
    return df.withColumns(
        {"retention_factor": retention, "customer_lifetime_value": clip(value, 0.0, float(MAX_CLV))}
    )


def add_churn(df: DataFrame) -> DataFrame:
    """Churn score and label; the noise term is a fixed function of the customer key."""
    noise = (F.col("custkey") * 37 % 100) / 100
    behaviour = (
        (F.col("recency") / 365) * 0.4
        + (1 - F.col("email_open_rate") / 100) * 0.3
        + (F.col("support_tickets") / 10) * 0.2
    )
    score = behaviour + noise * 0.1
    return df.withColumns(
        {
            "behaviour_score": behaviour,
            "churn_score": score,
            "churned": F.when(score > 0.5, 1).otherwise(0),
        }
    )


def profile_measures(
    customer: DataFrame, orders: DataFrame, events: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """Every measure before rounding, keyed by ``custkey``."""
    as_of = day_after_last_order(orders) if as_of is None else as_of
    base = customer.select(
        F.col("c_custkey").alias("custkey"),
        (F.col("c_custkey") % 63 + 18).cast("int").alias("age"),
        account_type().alias("account_type"),
    )
    joined = base.join(order_totals(orders), "custkey", "left").join(event_totals(events), "custkey", "left")
    return (
        joined.transform(add_purchases)
        .transform(add_dates, as_of)
        .transform(add_frequency)
        .transform(add_engagement_counts)
        .transform(add_lifetime_value)
        .transform(add_churn)
    )


def customer_id(key: Column | str = "custkey") -> Column:
    return F.format_string("CUST_%06d", F.col(key) if isinstance(key, str) else key)


ROUNDED = [
    "avg_purchase_amount",
    "frequency",
    "monetary",
    "email_open_rate",
    "website_visits_per_month",
    "customer_lifetime_value",
    "purchase_frequency",
]


def finish_profile(measures: DataFrame) -> DataFrame:
    """The customer table: formatted id, amounts and rates to two digits, declared column order."""
    ready = measures.withColumns({"customer_id": customer_id(), **{c: round_half_even(c, 2) for c in ROUNDED}})
    return ready.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.CUSTOMER])


def customer_profile(
    customer: DataFrame, orders: DataFrame, events: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """The 16-column customer table."""
    return finish_profile(profile_measures(customer, orders, events, as_of))


def dataset_summary(profile: DataFrame) -> DataFrame:
    """Rows, churn rate and mean lifetime value."""
    return profile.agg(
        F.count("*").alias("customers"),
        F.avg("churned").alias("churn_rate"),
        F.avg(schema.CLV_TARGET).alias("average_clv"),
    )


def account_type_counts(profile: DataFrame) -> DataFrame:
    """Customers per account type, largest first."""
    return profile.groupBy("account_type").agg(F.count("*").alias("customers")).orderBy(F.desc("customers"), "account_type")


def describe_column(staged: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of one column."""
    low, middle, high = exact_quantiles(staged, {column: ["0.25", "0.5", "0.75"]})[column]
    return staged.agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).cast("double").alias("min"),
        F.lit(low).cast("double").alias("p25"),
        F.lit(middle).cast("double").alias("p50"),
        F.lit(high).cast("double").alias("p75"),
        F.max(column).cast("double").alias("max"),
    )
