"""Customer features, scoring form: column arithmetic on one record, no statistics needed.

The scoring form uses other formulas than the training form under the same names; ``feature_skew``
measures by how much they differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens import schema
from patronlens.functions import clip
from patronlens.operators.features import FeatureStats, add_features, encode_account_type, listed_columns

# The scales of the scoring form. A single record has no quantiles: 5 - 2 for recency, 2 for frequency, 2 for monetary.
NEUTRAL_RFM_SCORE = 7
VISITS_SCALE = 50
TICKETS_SCALE = 10


def serving_account_code(account: Column | str = "account_type") -> Column:
    c = F.col(account) if isinstance(account, str) else account
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for name, code in schema.ACCOUNT_TYPE_SERVING_CODE.items():
        out = out.when(c == name, code)
    return out


def serving_columns() -> dict[str, Column]:
    """The features that the scoring form computes."""
    engagement = (
        F.col("email_open_rate") * 0.3
        + (F.col("website_visits_per_month") / VISITS_SCALE * 100) * 0.5
        + (1 - F.col("support_tickets") / TICKETS_SCALE) * 100 * 0.2
    )
    return {
        "account_type": serving_account_code(),
        "rfm_score": F.lit(NEUTRAL_RFM_SCORE),
        "engagement_score": clip(engagement, 0.0, 100.0),
        "purchase_velocity": F.col("purchase_frequency") / (F.col("tenure_days") + 1),
        "clv_per_year": F.col("monetary") / (F.col("tenure_days") / 365 + 1),
        "ltv_to_cac": F.col("monetary") / schema.ACQUISITION_COST,
        "recent_purchase_ratio": F.col("frequency") * 3 / (F.col("purchase_frequency") + 1),
    }


def serving_features(records: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Key (if any) and the ordered features of each record."""
    ready = records.withColumns(serving_columns())
    keys = ["customer_id"] if "customer_id" in records.columns else []
    return ready.select(*keys, *listed_columns(ready, features or schema.FEATURES_REF))


def feature_skew(customers: DataFrame, stats: FeatureStats) -> DataFrame:
    """Mean absolute difference between training and scoring form, one row per feature."""
    serving = {f"serving_{name}": column for name, column in serving_columns().items()}
    names = list(serving_columns())
    both = (
        add_features(customers.withColumns(serving), stats)
        .transform(encode_account_type, stats)
    )
    wide = both.agg(*[F.avg(F.abs(F.col(n) - F.col(f"serving_{n}"))).alias(n) for n in names])
    return wide.unpivot([], names, "feature", "mean_abs_difference")
