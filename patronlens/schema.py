"""Column contracts and business constants."""

from __future__ import annotations

from pyspark.sql import types as T

# The customer table.
CUSTOMER = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("account_type", T.StringType()),
        T.StructField("tenure_days", T.IntegerType()),
        T.StructField("total_purchases", T.IntegerType()),
        T.StructField("avg_purchase_amount", T.DoubleType()),
        T.StructField("recency", T.IntegerType()),
        T.StructField("frequency", T.DoubleType()),
        T.StructField("monetary", T.DoubleType()),
        T.StructField("email_open_rate", T.DoubleType()),
        T.StructField("website_visits_per_month", T.DoubleType()),
        T.StructField("support_tickets", T.IntegerType()),
        T.StructField("customer_lifetime_value", T.DoubleType()),
        T.StructField("churned", T.IntegerType()),
        T.StructField("days_since_last_purchase", T.IntegerType()),
        T.StructField("purchase_frequency", T.DoubleType()),
    ]
)

# The source tables of the profile.
SOURCE_TABLES = {
    "customer": T.StructType(
        [
            T.StructField("c_custkey", T.LongType()),
            T.StructField("c_name", T.StringType()),
            T.StructField("c_nationkey", T.IntegerType()),
            T.StructField("c_acctbal", T.DoubleType()),
            T.StructField("c_mktsegment", T.StringType()),
        ]
    ),
    "orders": T.StructType(
        [
            T.StructField("o_orderkey", T.LongType()),
            T.StructField("o_custkey", T.LongType()),
            T.StructField("o_orderstatus", T.StringType()),
            T.StructField("o_totalprice", T.DoubleType()),
            T.StructField("o_orderdate", T.TimestampNTZType()),
            T.StructField("o_orderpriority", T.StringType()),
        ]
    ),
    "events": T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("ts", T.TimestampNTZType()),
            T.StructField("user_id", T.LongType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("props", T.StringType()),
        ]
    ),
}

# What a scoring request carries, besides an optional customer_id.
SCORING_FIELDS = [
    "age",
    "account_type",
    "tenure_days",
    "recency",
    "frequency",
    "monetary",
    "email_open_rate",
    "website_visits_per_month",
    "support_tickets",
    "avg_purchase_amount",
    "purchase_frequency",
    "days_since_last_purchase",
]

SCORING = T.StructType(
    [T.StructField("customer_id", T.StringType())]
    + [T.StructField(name, CUSTOMER[name].dataType) for name in SCORING_FIELDS]
)

# Text of a record that could not be read as declared; such records go to quarantine with it.
UNREAD = "unread"
SCORING_TEXT = T.StructType([*SCORING.fields, T.StructField(UNREAD, T.StringType())])

# A scored record: three nested answers, or the record and the rules it breaks.
SCORED = (
    "customer_id string, "
    "clv struct<customer_lifetime_value:double,clv_segment:string,confidence:string>, "
    "churn struct<churn_probability:double,churn_prediction:int,risk_category:string,top_risk_factors:array<string>>, "
    "segment struct<segment_id:int,segment_name:string,distance_to_center:double,recommended_actions:array<string>>, "
    f"record {SCORING_TEXT.simpleString()}, violations array<string>, outcome string"
)

CLV_TARGET = "customer_lifetime_value"
CHURN_TARGET = "churned"

# Model features in the order the vectors use.
FEATURES_REF = [
    "age",
    "account_type",
    "tenure_days",
    "recency",
    "frequency",
    "monetary",
    "email_open_rate",
    "website_visits_per_month",
    "support_tickets",
    "avg_purchase_amount",
    "purchase_frequency",
    "days_since_last_purchase",
    "rfm_score",
    "engagement_score",
    "purchase_velocity",
    "clv_per_year",
    "ltv_to_cac",
    "recent_purchase_ratio",
]

# clv_per_year and ltv_to_cac are computed from the CLV label; leave them out to train on it honestly.
FEATURES_SAFE = [name for name in FEATURES_REF if name not in ("clv_per_year", "ltv_to_cac")]

# Business bins and labels.
RFM_QUANTILES = 5
RFM_SEGMENT_BINS = [0, 5, 9, 12, 15]
RFM_SEGMENT_LABELS = ["At Risk", "Developing", "Established", "Champions"]
ACTIVITY_BINS = [0, 25, 50, 75, 100]
ACTIVITY_LABELS = ["Low", "Medium", "High", "Very High"]
TENURE_BINS = [0, 90, 365, 730, 1825]
TENURE_LABELS = ["New", "Regular", "Loyal", "VIP"]
RECENCY_BINS = [0, 30, 90, 180, 365]
RECENCY_LABELS = ["Very Recent", "Recent", "Moderate", "Dormant"]
VALUE_TIERS = ["Bronze", "Silver", "Gold", "Platinum"]
CLV_SEGMENTS = ["Low Value", "Medium Value", "High Value", "Premium Value"]
CLV_SEGMENT_LIMITS = [2000, 5000, 10000]
RISK_BINS = [0, 0.25, 0.5, 0.75, 1.0]
RISK_LABELS = ["Low Risk", "Medium Risk", "High Risk", "Critical Risk"]
ACQUISITION_COST = 100
CHURN_THRESHOLD = 0.5
AT_RISK_THRESHOLD = 0.7
RETENTION_BASELINE = 0.75
HIGH_VALUE_PERCENTILE = 75
RANDOM_SEED = 42

# Account types with their purchase multiplier and the code the scoring form uses.
ACCOUNT_TYPE_MULTIPLIER = {"Basic": 1.0, "Premium": 2.0, "Enterprise": 3.5}
ACCOUNT_TYPE_SERVING_CODE = {"Basic": 0, "Premium": 1, "Enterprise": 2}

# Segment names by segment id, and three actions for each.
SEGMENT_NAMES = ["High-Value Engaged", "Loyal Regulars", "At-Risk", "New Prospects", "Dormant"]
SEGMENT_ACTIONS = [
    [
        "Offer exclusive VIP benefits and early access to new products",
        "Implement loyalty rewards program with premium tiers",
        "Provide personalized concierge service",
    ],
    [
        "Send personalized product recommendations based on purchase history",
        "Offer bundle deals and cross-sell opportunities",
        "Implement referral incentive programs",
    ],
    [
        "Launch win-back campaigns with special offers",
        "Conduct satisfaction surveys to identify pain points",
        "Provide re-engagement incentives and discounts",
    ],
    [
        "Offer onboarding tutorials and welcome bonuses",
        "Send educational content about product benefits",
        "Provide first-purchase discounts",
    ],
    [
        "Send reactivation emails with compelling offers",
        "Highlight new features and improvements",
        "Offer time-limited comeback discounts",
    ],
]
DEFAULT_ACTIONS = ["Analyze segment characteristics for custom strategy"]

# Model settings.
CLV_PARAMS = {
    "maxIter": 200,
    "stepSize": 0.05,
    "maxDepth": 6,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "seed": RANDOM_SEED,
}
CHURN_PARAMS = {
    "numTrees": 150,
    "maxDepth": 10,
    "minInstancesPerNode": 10,
    "featureSubsetStrategy": "sqrt",
    "seed": RANDOM_SEED,
}
SEGMENT_PARAMS = {"k": 5, "maxIter": 300, "restarts": 10, "seed": RANDOM_SEED}
