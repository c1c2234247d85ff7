"""Customer features, training form.

``fit_features`` reads the customer table once for the statistics the features need; everything
after that is a narrow projection over literals. The fitted statistics are kept and reused, so new
rows are scored with the edges and maxima of the training data.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens import schema
from patronlens.functions import clip, cut, present, qcut_code, qcut_label, quantile_edges, safe_divide


@dataclass(frozen=True)
class FeatureStats:
    """What is fitted: quantile edges, maxima, the category order, and what fills missing features."""

    recency_edges: tuple[float, ...]
    frequency_edges: tuple[float, ...]
    monetary_edges: tuple[float, ...]
    clv_edges: tuple[float, ...]
    max_visits: float | None
    max_tickets: float | None
    account_types: tuple[str, ...]
    fills: dict[str, float] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> FeatureStats:
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})

    def to_table(self, spark: SparkSession) -> DataFrame:
        """One row, ready for ``write``."""
        return spark.createDataFrame(
            [(self.to_json(),)], "stats string"
        )


def distinct_labels(df: DataFrame, column: str) -> list[str]:
    """Alphabetical distinct values of a category column."""
    return sorted(row[0] for row in df.select(column).filter(F.col(column).isNotNull()).distinct().collect())


def fit_features(customers: DataFrame) -> FeatureStats:
    """Fit on a staged customer table (it is read several times); NaN counts as missing."""
    bins = {"recency": schema.RFM_QUANTILES, "frequency": schema.RFM_QUANTILES, "monetary": schema.RFM_QUANTILES}
    if schema.CLV_TARGET in customers.columns:
        bins[schema.CLV_TARGET] = len(schema.VALUE_TIERS)
    whole = customers.agg(
        F.max(present("website_visits_per_month")).alias("max_visits"),
        F.max(present("support_tickets")).alias("max_tickets"),
    ).first()
    edges = quantile_edges(customers, bins)
    return FeatureStats(
        recency_edges=tuple(edges["recency"]),
        frequency_edges=tuple(edges["frequency"]),
        monetary_edges=tuple(edges["monetary"]),
        clv_edges=tuple(edges.get(schema.CLV_TARGET, ())),
        max_visits=whole["max_visits"],
        max_tickets=whole["max_tickets"],
        account_types=tuple(distinct_labels(customers, "account_type")),
    )


def add_rfm_scores(df: DataFrame, stats: FeatureStats) -> DataFrame:
    """Recency score 1..5 (recent is high), frequency and monetary scores 0..4, their sum and its segment."""
    scored = df.withColumns(
        {
            "recency_score": schema.RFM_QUANTILES - qcut_code("recency", stats.recency_edges),
            "frequency_score": qcut_code("frequency", stats.frequency_edges),
            "monetary_score": qcut_code("monetary", stats.monetary_edges),
        }
    ).withColumn("rfm_score", F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score"))
    return scored.withColumn("rfm_segment", cut("rfm_score", schema.RFM_SEGMENT_BINS, schema.RFM_SEGMENT_LABELS))


def engagement_score(max_visits: float | None, max_tickets: float | None) -> Column:
    """Weighted opens, visits and (inverted) tickets, 0..100; null where a maximum is 0."""
    visits = F.try_divide(F.col("website_visits_per_month"), F.lit(max_visits).cast("double"))
    tickets = F.try_divide(F.col("support_tickets"), F.lit(max_tickets).cast("double"))
    score = F.col("email_open_rate") * 0.3 + (visits * 100) * 0.5 + (1 - tickets) * 100 * 0.2
    return clip(score, 0.0, 100.0)


def add_engagement_features(df: DataFrame, stats: FeatureStats) -> DataFrame:
    """Engagement score and level, purchase velocity, spend per visit."""
    months = F.col("tenure_days") / 30
    scored = df.withColumns(
        {
            "engagement_score": engagement_score(stats.max_visits, stats.max_tickets),
            "purchase_velocity": F.try_divide("total_purchases", "tenure_days"),
            "value_per_visit": safe_divide("monetary", F.col("website_visits_per_month") * months),
        }
    )
    return scored.withColumn("activity_level", cut("engagement_score", schema.ACTIVITY_BINS, schema.ACTIVITY_LABELS))


def add_temporal_features(df: DataFrame) -> DataFrame:
    """Tenure and recency segments, share of recent purchases."""
    ratio = F.when(F.col("total_purchases") > 0, F.col("frequency") * 3 / F.col("total_purchases")).otherwise(0.0)
    return df.withColumns(
        {
            "tenure_segment": cut("tenure_days", schema.TENURE_BINS, schema.TENURE_LABELS),
            "recency_segment": cut("recency", schema.RECENCY_BINS, schema.RECENCY_LABELS),
            "recent_purchase_ratio": clip(ratio, 0.0, 2.0),
        }
    )


def add_value_features(df: DataFrame, stats: FeatureStats) -> DataFrame:
    """Lifetime value per year, value tier, value to acquisition cost."""
    return df.withColumns(
        {
            "clv_per_year": safe_divide(schema.CLV_TARGET, F.col("tenure_days") / 365),
            "value_tier": qcut_label(schema.CLV_TARGET, stats.clv_edges, schema.VALUE_TIERS),
            "ltv_to_cac": F.col(schema.CLV_TARGET) / schema.ACQUISITION_COST,
        }
    )


def label_code(column: str, labels: tuple[str, ...], unseen: str = "error") -> Column:
    """Position of the label; an unseen one fails, or becomes ``len(labels)`` with ``unseen="keep"``."""
    c = F.col(column)
    place = F.array_position(F.lit(list(labels)) if labels else F.array().cast("array<string>"), c)
    if unseen == "keep":
        other = F.lit(len(labels))
    else:
        other = F.raise_error(F.concat(F.lit(f"unseen label in {column}: "), c)).cast("int")
    return F.when(place > 0, (place - 1).cast("int")).when(c.isNotNull(), other)


def encode_account_type(df: DataFrame, stats: FeatureStats | None, unseen: str = "error") -> DataFrame:
    """Replace the account type by its fitted code; without fitted labels the column stays as it is."""
    if "account_type" not in df.columns or stats is None:
        return df
    return df.withColumn("account_type", label_code("account_type", stats.account_types, unseen))


def listed_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    present = set(df.columns)
    return [name for name in wanted if name in present]


def add_features(df: DataFrame, stats: FeatureStats) -> DataFrame:
    """All engineered columns, account type still as text."""
    return (
        df.transform(add_rfm_scores, stats)
        .transform(add_engagement_features, stats)
        .transform(add_temporal_features)
        .transform(add_value_features, stats)
    )


def feature_table(df: DataFrame, stats: FeatureStats, features: list[str] | None = None) -> DataFrame:
    """Key, the ordered model features and the labels."""
    ready = add_features(df, stats).transform(encode_account_type, stats)
    chosen = listed_columns(ready, features or schema.FEATURES_REF)
    labels = [name for name in (schema.CLV_TARGET, schema.CHURN_TARGET) if name in ready.columns]
    return ready.select("customer_id", *chosen, *labels)


def fit_fills(table: DataFrame, names: list[str]) -> tuple[dict[str, float], dict[str, int]]:
    """Mean of every feature (0 if it is always missing), and how many rows miss it, in one aggregate."""
    row = table.agg(
        *[F.coalesce(F.avg(present(n)), F.lit(0.0)).alias(f"m{i}") for i, n in enumerate(names)],
        *[F.count_if(present(n).isNull()).alias(f"c{i}") for i, n in enumerate(names)],
    ).first()
    return dict(zip(names, row[: len(names)])), dict(zip(names, row[len(names) :]))


def fill_features(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    """Missing features (null and NaN) become their fitted value, so that a model loses no row."""
    present_ones = {n: F.coalesce(present(n), F.lit(value)) for n, value in fills.items() if n in df.columns}
    return df.withColumns(present_ones) if present_ones else df


@dataclass(frozen=True)
class ScaleStats:
    """Mean and population deviation per feature."""

    means: dict[str, float]
    deviations: dict[str, float]


def fit_scaler(df: DataFrame, features: list[str]) -> ScaleStats:
    """All means and deviations in one aggregate."""
    row = df.agg(
        *[F.avg(name).alias(f"m{i}") for i, name in enumerate(features)],
        *[F.stddev_pop(name).alias(f"s{i}") for i, name in enumerate(features)],
    ).first()
    n = len(features)
    return ScaleStats(dict(zip(features, row[:n])), dict(zip(features, row[n:])))


def scale_features(df: DataFrame, stats: ScaleStats) -> DataFrame:
    """(x - mean) / deviation for each fitted feature, 0 where the feature does not vary."""
    scaled = {}
    for name, mean in stats.means.items():
        deviation = stats.deviations[name]
        centred = F.col(name) - F.lit(mean)
        scaled[name] = centred / F.lit(deviation) if deviation else centred * F.lit(0.0)
    return df.withColumns(scaled)
