"""Customer profiles at the end of every period, all dates from one scan of orders and events.

What a customer does in a period is summed first (combined in the map tasks), the sums are cumulated per customer, and each
cumulated row is repeated over the periods until the next one with something new. A customer with a third of all orders costs one
row per map task and period, and a window holds one customer's periods only. No date reads the tables again.

A row without a date or key is in no period. What lies before the first period counts from the first one on; what lies
after the last one does not count. A customer without any row stands in every period with empty sums.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens import schema
from patronlens.functions import round_half_even
from patronlens.functions.windows import over_few_rows
from patronlens.operators import profile
from patronlens.staging import stage

SUMS = ["total_purchases", "total_cents", "views", "clicks", "visits", "errors"]
KPIS = ["total_customers", "avg_clv", "churn_rate", "high_value_customers"]
CELL = 4096


@dataclass(frozen=True)
class Periods:
    """``count`` periods of ``months`` months each; the first begins on the first day of a month."""

    first: dt.date
    count: int
    months: int = 1

    def end(self, place: Column) -> Column:
        """The day after a period: a profile of that day knows the whole period and nothing later."""
        return F.add_months(F.lit(self.first), (place + 1) * self.months)

    def place(self, day: Column) -> Column:
        """Number of the period of a date, from 0."""
        months = (F.year(day) - self.first.year) * 12 + F.month(day) - self.first.month
        return F.greatest(F.floor(months / self.months).cast("int"), F.lit(0))


def periods_of(orders: DataFrame, events: DataFrame, months: int = 1) -> Periods | None:
    """All periods from the first to the last date of both tables; none without any date."""
    days = orders.select(F.col("o_orderdate").cast("date").alias("day")).unionAll(
        events.select(F.col("ts").cast("date").alias("day"))
    )
    first, last = days.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return None
    between = (last.year - first.year) * 12 + last.month - first.month
    return Periods(first.replace(day=1), between // months + 1, months)


def activity(orders: DataFrame, events: DataFrame, periods: Periods) -> DataFrame:
    """One row per customer and period in which the customer did something."""
    kind, end = F.col("kind"), periods.end(F.lit(periods.count - 1))
    bought = orders.filter(F.col("o_custkey").isNotNull() & (F.col("o_orderdate") < end)).select(
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.lit("order").alias("kind"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )
    done = events.filter(
        F.col("event_type").isin("view", "click", "purchase", "error") & F.col("user_id").isNotNull() & (F.col("ts") < end)
    ).select(
        F.col("user_id").alias("custkey"),
        F.col("ts").cast("date").alias("day"),
        F.col("event_type").alias("kind"),
        F.lit(None).cast("long").alias("cents"),
    )
    ordered = F.when(kind == "order", F.col("day"))
    return (
        bought.unionByName(done)
        .groupBy("custkey", periods.place(F.col("day")).alias("place"))
        .agg(
            F.count(ordered).alias("total_purchases"),
            F.sum("cents").alias("total_cents"),
            F.min(ordered).alias("first_order"),
            F.max(ordered).alias("last_order"),
            F.count_if(kind == "view").alias("views"),
            F.count_if(kind == "click").alias("clicks"),
            F.count_if(kind.isin("view", "click", "purchase")).alias("visits"),
            F.count_if(kind == "error").alias("errors"),
        )
    )


def cumulated(active: DataFrame, periods: Periods) -> DataFrame:
    """Sums up to each row's period, and the periods ``since``..``until`` for which the row is the last known state.

    The first row of a customer also covers the empty periods before it.
    """
    order = Window.partitionBy("custkey").orderBy("place")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return active.select(
        "custkey",
        "place",
        *[F.sum(c).over(so_far).alias(c) for c in SUMS],
        F.min("first_order").over(so_far).alias("first_order"),
        F.max("last_order").over(so_far).alias("last_order"),
        F.when(F.lag("place").over(order).isNull(), 0).otherwise(F.col("place")).alias("since"),
        (F.lead("place", 1, periods.count).over(order) - 1).alias("until"),
    )


def _each_period(periods: Periods) -> Column:
    """Every period of a state as a span of its own."""
    place = F.sequence(F.coalesce("since", F.lit(0)), F.coalesce("until", F.lit(periods.count - 1)))
    return F.transform(place, lambda at: F.struct(at.alias("at"), at.alias("upto")))


def _spans(periods: Periods) -> Column:
    """The periods of a state, those that cannot differ in any measure as one span.

    These are the ones before a customer does anything, and those for which tenure and recency both stand at their bounds.
    """
    since, place, until = (F.col(c) for c in ("since", "place", "until"))

    def span(at: Column, upto: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), upto.cast("int").alias("upto"))

    none = F.array().cast("array<struct<at:int,upto:int>>")
    full_tenure = periods.place(F.date_add("first_order", profile.MAX_TENURE))
    settled = F.coalesce(F.greatest(full_tenure, periods.place(F.date_add("last_order", profile.MAX_RECENCY))), F.lit(0))
    last_moving, first_settled = F.least(until, settled - 1), F.greatest(place, settled)
    parts = F.concat(
        F.when(since < place, F.array(span(since, place - 1))).otherwise(none),
        F.when(place <= last_moving, F.transform(F.sequence(place, last_moving), lambda at: span(at, at))).otherwise(none),
        F.when(first_settled <= until, F.array(span(first_settled, until))).otherwise(none),
    )
    return F.when(place.isNull(), F.array(span(F.lit(0), F.lit(periods.count - 1)))).otherwise(parts)


def _measured(customer: DataFrame, orders: DataFrame, events: DataFrame, periods: Periods, spans: Column) -> DataFrame:
    """Every measure of each span, with ``as_of`` and ``until`` of its first and last period."""
    states = cumulated(activity(orders, events, periods), periods)
    base = customer.select(
        F.col("c_custkey").alias("custkey"),
        (F.col("c_custkey") % 63 + 18).cast("int").alias("age"),
        profile.account_type().alias("account_type"),
    )
    dense = base.join(states, "custkey", "left").withColumn("span", F.explode(spans)).withColumns({"at": F.col("span.at"), "upto": F.col("span.upto")})
    known = F.col("at") >= F.col("place")
    values = {c: F.when(known, F.col(c)) for c in [*SUMS, "first_order", "last_order"]}
    values["total_purchases"] = values["total_purchases"].cast("int")
    return (
        dense.withColumns(values)
        .transform(profile.add_purchases)
        .transform(profile.add_dates, periods.end(F.col("at")))
        .withColumns({"as_of": F.col("today"), "until": periods.end(F.col("upto"))})
        .drop("span", "upto")
        .transform(profile.add_frequency)
        .transform(profile.add_engagement_counts)
        .transform(profile.add_lifetime_value)
        .transform(profile.add_churn)
    )


def profile_history(customer: DataFrame, orders: DataFrame, events: DataFrame, periods: Periods) -> DataFrame:
    """Every measure of :func:`profile.profile_measures` before rounding, per customer and period, with ``as_of``."""
    return _measured(customer, orders, events, periods, _each_period(periods)).drop("until")


def profile_spans(customer: DataFrame, orders: DataFrame, events: DataFrame, periods: Periods) -> DataFrame:
    """:func:`profile_history` with one row for successive periods without any change, from ``as_of`` to ``until``, except for tenure and
    recency in days beyond their bounds.
    """
    return _measured(customer, orders, events, periods, _spans(periods))


def period_kpis(history: DataFrame, percent: int = 75, months: int = 1) -> DataFrame:
    """Customers, mean lifetime value, churn rate and customers above the percentile of lifetime value, per ``as_of``.

    The rows are those of :func:`profile_history` or, if they have ``until``, of :func:`profile_spans` over periods of ``months``.
    They are evaluated once, into counts of equal values in cents over the same periods. The percentile is exact and interpolated;
    what lies above it are the values above that of the lower of its two ranks. That one is found in cells of 4096 cents, of which there
    are at most 1221 a period as values are bounded, and then inside one cell: no task sees all values of a period, and only the
    values of these cells are repeated over the periods of a span.
    """
    cents = F.round(round_half_even(schema.CLV_TARGET, 2) * 100).cast("long")
    until = F.col("until" if "until" in history.columns else "as_of")
    counted = stage(
        history.groupBy("as_of", until.alias("until"), cents.alias("cents"))
        .agg(F.count("*").alias("n"), F.sum("churned").alias("churned"))
        .withColumn("cell", F.floor(F.col("cents") / CELL)),
        "value_counts",
    )
    periods = F.explode(F.sequence("as_of", "until", F.make_interval(months=F.lit(months))))
    sums = ["cell_rows", "churned", "cents"]
    cells = stage(
        counted.groupBy("as_of", "until", "cell")
        .agg(F.sum("n").alias("cell_rows"), F.sum("churned").alias("churned"), F.sum(F.col("cents") * F.col("n")).alias("cents"))
        .select(periods.alias("as_of"), "cell", *sums)
        .groupBy("as_of", "cell")
        .agg(*[F.sum(c).alias(c) for c in sums]),
        "value_cells",
    )
    period = Window.partitionBy("as_of")
    valued = cells.filter(F.col("cell").isNotNull())
    ranked = valued.select(
        "as_of",
        "cell",
        "cell_rows",
        (F.sum("cell_rows").over(period.orderBy("cell")) - F.col("cell_rows")).alias("below"),
        (F.sum("cell_rows").over(period) - 1).alias("last"),
    ).withColumn("low", F.floor(F.col("last") * percent / 100))
    holding = ranked.filter((F.col("below") <= F.col("low")) & (F.col("below") + F.col("cell_rows") > F.col("low")))
    # One row per period.
    wanted = F.broadcast(holding.withColumnRenamed("as_of", "date"))
    inside = counted.join(wanted, "cell").filter(F.col("date").between(F.col("as_of"), F.col("until")))
    values = inside.groupBy("date", "cell", "below", "low", "last", "cents").agg(F.sum("n").alias("n"))
    up_to = F.col("below") + F.sum("n").over(Window.partitionBy("date", "cell").orderBy("cents"))
    placed = values.withColumn("up_to", up_to)
    # The limit lies at or above the value of the lower rank and, unless they are equal, below that of the next one.
    here = (F.col("low") < F.col("up_to")) & (F.col("low") >= F.col("up_to") - F.col("n"))
    limits = placed.groupBy("date").agg(F.max(F.when(here, F.col("last") + 1 - F.col("up_to"))).alias("above"))
    totals = cells.groupBy("as_of").agg(
        F.sum("cell_rows").alias("total_customers"),
        (F.sum("cents") / F.sum(F.when(F.col("cell").isNotNull(), F.col("cell_rows"))) / 100).alias("avg_clv"),
        (F.sum("churned") / F.sum("cell_rows")).alias("churn_rate"),
    )
    return totals.join(limits, F.col("as_of") == F.col("date"), "left").select(
        "as_of", "total_customers", "avg_clv", "churn_rate", F.coalesce("above", F.lit(0)).alias("high_value_customers")
    )


def kpis_with_change(kpis: DataFrame) -> DataFrame:
    """Each KPI with its change to the period before (``<name>_delta``; null in the first period)."""
    before = over_few_rows().orderBy("as_of")
    return kpis.withColumns({f"{c}_delta": F.col(c) - F.lag(c).over(before) for c in KPIS})
