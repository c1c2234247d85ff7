"""The registered queries as SQL for DuckDB, written from the definitions and not from the Spark code."""

from __future__ import annotations

from checks.frames import CENTER_FEATURES, CENTERS
from patronlens import schema


def r(expression: str, digits: int = 4) -> str:
    """Rounded, without a negative zero."""
    value = f"round({expression}, {digits})"
    return f"CASE WHEN {value} = 0 THEN 0.0 ELSE {value} END"


def half_even(expression: str, digits: int = 2) -> str:
    factor = f"{10.0**digits}"
    return f"(round_even(({expression}) * {factor}::DOUBLE, 0) / {factor}::DOUBLE)"


def bounded(expression: str, low=None, high=None) -> str:
    cases = ""
    if low is not None:
        cases += f" WHEN ({expression}) < {low} THEN {low}"
    if high is not None:
        cases += f" WHEN ({expression}) > {high} THEN {high}"
    return f"(CASE{cases} ELSE ({expression}) END)"


def fixed_bin(expression: str, bins: list, labels: list[str]) -> str:
    cases = " ".join(
        f"WHEN {expression} > {low} AND {expression} <= {high} THEN '{label}'"
        for low, high, label in zip(bins[:-1], bins[1:], labels)
    )
    return f"CASE {cases} END"


def edges(expression: str, bins: int, where: str = "") -> str:
    points = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"list_distinct(quantile_cont(({expression})::DOUBLE, [{points}]){where})"


def bin_code(expression: str, edge_list: str) -> str:
    return (
        f"(CASE WHEN {expression} IS NULL OR len({edge_list}) < 2 THEN NULL "
        f"ELSE greatest(len(list_filter({edge_list}, lambda v: v < {expression})) - 1, 0) END)::INTEGER"
    )


def bin_label(expression: str, edge_list: str, labels: list[str]) -> str:
    names = ", ".join(f"'{label}'" for label in labels)
    return f"([{names}])[{bin_code(expression, edge_list)} + 1]"


MEASURES = """
ord AS (
  SELECT o_custkey, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents,
         min(o_orderdate)::DATE AS first_order, max(o_orderdate)::DATE AS last_order
  FROM orders GROUP BY o_custkey),
today AS (SELECT max(o_orderdate)::DATE + 1 AS d FROM orders),
ev AS (
  SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks,
         count(*) FILTER (event_type IN ('view', 'click', 'purchase')) AS visits,
         count(*) FILTER (event_type = 'error') AS errors
  FROM events GROUP BY user_id),
m1 AS (
  SELECT c_custkey AS custkey, (18 + c_custkey % 63)::INTEGER AS age,
         CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'Basic'
              WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Premium'
              WHEN c_mktsegment = 'MACHINERY' THEN 'Enterprise' END AS account_type,
         coalesce(n, 0)::INTEGER AS total_purchases,
         coalesce(cents / (n * 100000.0::DOUBLE), 0) AS avg_purchase_amount,
         coalesce(cents, 0) / 100000.0::DOUBLE AS monetary,
         coalesce(least(greatest(date_diff('day', first_order, d), 1), 1825), 1)::INTEGER AS tenure_days,
         CASE WHEN last_order IS NULL THEN 365
              ELSE least(greatest(date_diff('day', last_order, d), 0), 365) END::INTEGER AS recency,
         coalesce(100.0::DOUBLE * views / nullif(views + clicks, 0), 0) AS email_open_rate,
         coalesce(visits, 0)::DOUBLE AS website_visits_per_month, coalesce(errors, 0)::INTEGER AS support_tickets
  FROM customer CROSS JOIN today LEFT JOIN ord ON o_custkey = c_custkey LEFT JOIN ev ON user_id = c_custkey),
m2 AS (
  SELECT *, recency AS days_since_last_purchase,
         least(greatest(total_purchases / (tenure_days / 30), 0.0::DOUBLE), 20.0::DOUBLE) AS frequency,
         1 - (recency / 365) * 0.3::DOUBLE AS retention_factor,
         (recency / 365) * 0.4::DOUBLE + (1 - email_open_rate / 100) * 0.3::DOUBLE
           + (support_tickets / 10) * 0.2::DOUBLE AS behaviour_score
  FROM m1),
m3 AS (
  SELECT *, frequency * 12 AS purchase_frequency,
         least(greatest(avg_purchase_amount * frequency * 12 * (tenure_days / 365) * retention_factor, 0.0::DOUBLE),
               50000.0::DOUBLE) AS customer_lifetime_value,
         behaviour_score + ((custkey * 37 % 100) / 100) * 0.1::DOUBLE AS churn_score
  FROM m2),
m AS (SELECT *, (churn_score > 0.5::DOUBLE)::INTEGER AS churned FROM m3)"""

ROUNDED = [
    "avg_purchase_amount",
    "frequency",
    "monetary",
    "email_open_rate",
    "website_visits_per_month",
    "customer_lifetime_value",
    "purchase_frequency",
]
PROFILE_COLUMNS = ", ".join(
    f"{half_even(f.name)} AS {f.name}" if f.name in ROUNDED else f.name
    for f in schema.CUSTOMER
    if f.name != "customer_id"
)
PROFILE = f"""{MEASURES},
p AS (SELECT format('CUST_{{:06d}}', custkey) AS customer_id, {PROFILE_COLUMNS} FROM m)"""

ALL_COLUMNS = ", ".join(schema.CUSTOMER.names)
SCORING_COLUMNS = ", ".join(schema.SCORING.names)

DIRTY = f"""{PROFILE},
copies AS (
  SELECT *, 0 AS copy FROM p UNION ALL
  SELECT * REPLACE (avg_purchase_amount + 1 AS avg_purchase_amount), 1 AS copy
  FROM p WHERE substr(customer_id, 6)::BIGINT % 50 = 0),
numbered AS (SELECT *, substr(customer_id, 6)::BIGINT AS k FROM copies),
dirty AS (
  SELECT * EXCLUDE (k) REPLACE (
    CASE WHEN k % 17 <> 0 THEN monetary END AS monetary,
    CASE WHEN k % 13 <> 0 THEN support_tickets END AS support_tickets,
    CASE WHEN k % 97 = 0 THEN -5 ELSE age END AS age,
    CASE WHEN k % 89 = 0 THEN -3 ELSE tenure_days END AS tenure_days,
    CASE WHEN k % 83 = 0 THEN 100.5::DOUBLE ELSE email_open_rate END AS email_open_rate,
    CASE WHEN k % 101 = 0 THEN 'Gold' ELSE account_type END AS account_type)
  FROM numbered),
dedup AS (
  SELECT * EXCLUDE (place, copy) FROM
    (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY copy) AS place FROM dirty) WHERE place = 1)"""

# What all values of a column of the customer file are; two whole columns have holes in the dirty one and become doubles.
WITH_HOLES = ["monetary", "support_tickets"]


def _inferred(name: str, kind: str) -> str:
    if kind == "string":
        shown, total = "string", f"sum(length({name}))::DOUBLE"
    else:
        shown, total = "bigint" if kind == "int" and name not in WITH_HOLES else "double", f"sum({name}::DOUBLE)"
    return f"SELECT '{name}' AS name, '{shown}' AS type, count({name}) AS present, {r(total, 2)} AS total FROM dirty"


INFERRED = " UNION ALL ".join(_inferred(name, kind) for name, kind in [*((f.name, f.dataType.simpleString()) for f in schema.CUSTOMER), ("copy", "int")])

NUMERIC = [f.name for f in schema.CUSTOMER if f.name not in ("customer_id", "account_type")]
MEDIANS = ", ".join(f"median({c}::DOUBLE) AS {c}" for c in NUMERIC)


def filled(source: str, medians: str) -> str:
    columns = ", ".join(
        f"coalesce(s.{c}::DOUBLE, q.{c}) AS {c}" if c in NUMERIC else f"s.{c}" for c in schema.CUSTOMER.names
    )
    return f"SELECT {columns} FROM {source} s, {medians} q"


FILLED = f"""{DIRTY},
med AS (SELECT {MEDIANS} FROM dedup),
filled AS ({filled("dedup", "med")})"""

NON_NEGATIVE = ["tenure_days", "total_purchases", "monetary", "customer_lifetime_value", "avg_purchase_amount"]

RANGES = [
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


def range_list() -> str:
    tests = []
    for name, low, high in RANGES:
        upper = f" OR {name} > {high}" if high is not None else ""
        tests.append(f"CASE WHEN {name} IS NULL OR {name} < {low}{upper} THEN '{name}' END")
    return f"concat_ws(',', {', '.join(tests)})"


ACCOUNT_TEST = "CASE WHEN account_type IS NULL OR account_type NOT IN ('Basic', 'Premium', 'Enterprise') THEN 'account_type' END"
ACCOUNT_LIST = f"coalesce({ACCOUNT_TEST}, '')"
ALL_VIOLATIONS = f"concat_ws(',', nullif({range_list()}, ''), {ACCOUNT_TEST})"


def features_over(source: str, prefix: str = "", fitted_on: str | None = None) -> str:
    """CTEs from a customer table to the engineered columns, statistics taken from ``fitted_on``."""
    fitted_on = fitted_on or source
    return f"""
{prefix}e AS (
  SELECT {edges("recency", 5)} AS re, {edges("frequency", 5)} AS fe, {edges("monetary", 5)} AS me,
         {edges("customer_lifetime_value", 4)} AS ce,
         max(website_visits_per_month) AS max_visits, max(support_tickets)::DOUBLE AS max_tickets
  FROM {fitted_on}),
{prefix}codes AS (
  SELECT account_type AS label, (dense_rank() OVER (ORDER BY account_type) - 1)::INTEGER AS code
  FROM (SELECT DISTINCT account_type FROM {fitted_on})),
{prefix}f1 AS (
  SELECT s.*, 5 - {bin_code("recency", "re")} AS recency_score, {bin_code("frequency", "fe")} AS frequency_score,
         {bin_code("monetary", "me")} AS monetary_score, code AS account_code,
         {bounded("email_open_rate * 0.3::DOUBLE + (website_visits_per_month / nullif(max_visits, 0) * 100) * 0.5::DOUBLE + (1 - support_tickets / nullif(max_tickets, 0)) * 100 * 0.2::DOUBLE", 0, 100)} AS engagement_score,
         total_purchases / nullif(tenure_days, 0) AS purchase_velocity,
         coalesce(monetary / nullif(website_visits_per_month * (tenure_days / 30), 0), 0) AS value_per_visit,
         {fixed_bin("tenure_days", schema.TENURE_BINS, schema.TENURE_LABELS)} AS tenure_segment,
         {fixed_bin("recency", schema.RECENCY_BINS, schema.RECENCY_LABELS)} AS recency_segment,
         least(greatest(CASE WHEN total_purchases > 0 THEN frequency * 3 / total_purchases ELSE 0 END, 0), 2)::DOUBLE
           AS recent_purchase_ratio,
         coalesce(customer_lifetime_value / nullif(tenure_days / 365, 0), 0) AS clv_per_year,
         {bin_label("customer_lifetime_value", "ce", schema.VALUE_TIERS)} AS value_tier,
         customer_lifetime_value / 100 AS ltv_to_cac
  FROM {source} s CROSS JOIN {prefix}e LEFT JOIN {prefix}codes ON label = s.account_type),
{prefix}f2 AS (SELECT *, recency_score + frequency_score + monetary_score AS rfm_score FROM {prefix}f1),
{prefix}f AS (
  SELECT *, {fixed_bin("rfm_score", schema.RFM_SEGMENT_BINS, schema.RFM_SEGMENT_LABELS)} AS rfm_segment,
         {fixed_bin("engagement_score", schema.ACTIVITY_BINS, schema.ACTIVITY_LABELS)} AS activity_level
  FROM {prefix}f2),
{prefix}ft AS (
  SELECT customer_id, {", ".join("account_code AS account_type" if c == "account_type" else c for c in schema.FEATURES_REF)},
         customer_lifetime_value, churned
  FROM {prefix}f)"""


FEATURES = f"{PROFILE},{features_over('p')}"

HASH8 = "('0x' || substr(md5(customer_id), 1, 8))::BIGINT"
HASH11 = "('0x' || substr(md5(customer_id), 9, 11))::BIGINT"

CLEANED = f"""{FILLED},
cap AS (SELECT quantile_cont(customer_lifetime_value, 0.99) AS cap FROM filled),
capped AS (SELECT * REPLACE (least(customer_lifetime_value, cap) AS customer_lifetime_value) FROM filled, cap),
cleaned AS (SELECT {", ".join(f"{bounded(c, low=0)} AS {c}" if c in NON_NEGATIVE else c for c in schema.CUSTOMER.names)} FROM capped)"""
MISSING = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in schema.FEATURES_REF)

STRATIFIED = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY churned ORDER BY {HASH8} % 100, {HASH11}) AS place,
        count(*) OVER (PARTITION BY churned) AS n FROM p),
      marked AS (SELECT *, place <= (n * 20 + 50) // 100 AS churn_test, {HASH8} % 100 < 20 AS clv_test FROM placed)"""

SERVING = f"""
sv AS (
  SELECT customer_id, age,
         CASE account_type WHEN 'Basic' THEN 0 WHEN 'Premium' THEN 1 WHEN 'Enterprise' THEN 2 END AS account_type,
         tenure_days, recency, frequency, monetary, email_open_rate, website_visits_per_month, support_tickets,
         avg_purchase_amount, purchase_frequency, days_since_last_purchase,
         3 + 2 + 2 AS rfm_score,
         {bounded("email_open_rate * 0.3::DOUBLE + (website_visits_per_month / 50 * 100) * 0.5::DOUBLE + (1 - support_tickets / 10) * 100 * 0.2::DOUBLE", 0, 100)} AS engagement_score,
         purchase_frequency / (tenure_days + 1) AS purchase_velocity,
         monetary / (tenure_days / 365 + 1) AS clv_per_year,
         monetary / 100 AS ltv_to_cac,
         frequency * 3 / (purchase_frequency + 1) AS recent_purchase_ratio
  FROM p)"""


def scaled(source: str, fitted_on: str, names: list[str]) -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in names)
    columns = ", ".join(
        r(f"CASE WHEN s_{c} = 0 THEN 0 ELSE ({c} - m_{c}) / s_{c} END") + f" AS {c}" for c in names
    )
    return f"SELECT customer_id, {columns} FROM {source}, (SELECT {stats} FROM {fitted_on})"


def center_distance(center: list[float]) -> str:
    squares = " + ".join(f"({c} - {x}::DOUBLE) * ({c} - {x}::DOUBLE)" for c, x in zip(CENTER_FEATURES, center))
    return f"sqrt({squares})"


NAME_LIST = ", ".join(f"'{n}'" for n in schema.SEGMENT_NAMES)
NAME = f"coalesce(([{NAME_LIST}])[segment_id + 1], 'Segment ' || segment_id)"
ACTION_LIST = ", ".join("'" + "; ".join(a) + "'" for a in schema.SEGMENT_ACTIONS)

SCORES = f"""{MEASURES},
s1 AS (
  SELECT format('CUST_{{:06d}}', custkey) AS customer_id, account_type, tenure_days, monetary,
         {half_even("customer_lifetime_value")} AS true_clv,
         {half_even(bounded("avg_purchase_amount * frequency * 12 * (tenure_days / 365)", 0, 50000))} AS predicted_clv,
         churned AS true_churn, {bounded("behaviour_score", 0, 1)} AS churn_probability,
         recency / 365 AS recency_share, frequency / 20 AS frequency_share, email_open_rate / 100 AS open_share
  FROM m),
s2 AS (SELECT *, (churn_probability >= 0.5)::INTEGER AS churn_prediction,
         {fixed_bin("churn_probability", schema.RISK_BINS, schema.RISK_LABELS)} AS risk_category,
         [{", ".join(center_distance(c) for c in CENTERS)}] AS gaps FROM s1),
s AS (SELECT * EXCLUDE (gaps), list_min(gaps) AS distance_to_center,
         (list_position(gaps, list_min(gaps)) - 1)::INTEGER AS segment_id FROM s2)"""

CLUSTERS = f"""{SCORES},
long AS (UNPIVOT (SELECT customer_id, segment_id, {", ".join(CENTER_FEATURES)} FROM s)
         ON {", ".join(CENTER_FEATURES)} INTO NAME feature VALUE x),
cm AS (SELECT segment_id, feature, count(*) AS n, avg(x) AS c, var_pop(x) AS v, sum(x) AS total, sum(x * x) AS sq
       FROM long GROUP BY ALL)"""


def plain(columns: str, source: str = "m", ctes: str = MEASURES) -> str:
    return f"WITH {ctes} SELECT {columns} FROM {source}"


def scores(columns: str, tail: str = "") -> str:
    return f"WITH {SCORES} SELECT {columns} FROM s {tail}"


def features(columns: str) -> str:
    return f"WITH {FEATURES} SELECT customer_id, {columns} FROM f"


SPLIT = f"split AS (SELECT *, {HASH8} % 100 < 20 AS is_test FROM {{}})"
CLV_SEGMENT = "CASE WHEN {0} < 2000 THEN 'Low Value' WHEN {0} < 5000 THEN 'Medium Value' WHEN {0} < 10000 THEN 'High Value' ELSE 'Premium Value' END"
ERROR = "(true_clv - predicted_clv)"
TP, FP, FN, TN = (
    f"count(*) FILTER (true_churn = {t} AND churn_prediction = {p})" for t, p in ((1, 1), (0, 1), (1, 0), (0, 0))
)
P75_TRUE = "(SELECT quantile_cont(true_clv, 0.75) FROM s)"
HV_PRECISION = f"""coalesce(count(*) FILTER (predicted_clv >= {P75_TRUE} AND true_clv >= {P75_TRUE})
  / nullif(count(*) FILTER (predicted_clv >= {P75_TRUE}), 0), 0)::DOUBLE"""


def two_digits(expression: str) -> str:
    return f"printf('%.2f', {half_even(expression)})"


def correlation_query() -> str:
    names = schema.FEATURES_REF
    rows = []
    for i, a in enumerate(names):
        for b in names[i:]:
            value = "1.0::DOUBLE" if a == b else f"corr({a}, {b})"
            rows.append(f"{{'a': '{a}', 'b': '{b}', 'c': {value}}}")
    return f"""WITH {FEATURES},
pairs AS (SELECT unnest([{", ".join(rows)}]) AS x FROM ft),
both_ways AS (SELECT x.a AS feature_a, x.b AS feature_b, x.c AS c FROM pairs
              UNION ALL SELECT x.b, x.a, x.c FROM pairs WHERE x.a <> x.b)
SELECT feature_a, feature_b, {r("c")} AS correlation FROM both_ways"""




def history(months: int) -> str:
    """The measures rebuilt for the day after every period of so many months."""
    days = """bounds AS (SELECT date_trunc('month', min(day)) AS lo, max(day) AS hi FROM
  (SELECT o_orderdate AS day FROM orders UNION ALL SELECT ts FROM events)),
grid AS (SELECT (unnest(generate_series(lo, hi, INTERVAL {0} MONTH)) + INTERVAL {0} MONTH)::DATE AS d FROM bounds)"""
    rebuilt = (
        MEASURES.replace("SELECT o_custkey, count(*)", "SELECT d AS od, o_custkey, count(*)")
        .replace("FROM orders GROUP BY o_custkey", "FROM orders JOIN grid ON o_orderdate < d GROUP BY d, o_custkey")
        .replace("today AS (SELECT max(o_orderdate)::DATE + 1 AS d FROM orders),\n", "")
        .replace("SELECT user_id, count(*)", "SELECT d AS ed, user_id, count(*)")
        .replace("FROM events GROUP BY user_id", "FROM events JOIN grid ON ts < d WHERE event_type <> 'signup' GROUP BY d, user_id")
        .replace("SELECT c_custkey AS custkey", "SELECT d AS as_of, c_custkey AS custkey")
        .replace("CROSS JOIN today", "CROSS JOIN grid")
        .replace("ON o_custkey = c_custkey", "ON o_custkey = c_custkey AND od = d")
        .replace("ON user_id = c_custkey", "ON user_id = c_custkey AND ed = d")
    )
    return f"{days.format(months)},{rebuilt}"


HISTORY_COLUMNS = ["custkey", "account_type", "total_purchases", "tenure_days", "recency", "support_tickets", "churned"]
HISTORY_ROUNDED = [c for c in ROUNDED if c != "purchase_frequency"]

MONTHLY = """months AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, count(*) AS n, sum(o_totalprice) AS v
  FROM orders GROUP BY 1)"""

SKEWED = ["account_type", "rfm_score", "engagement_score", "purchase_velocity", "clv_per_year", "ltv_to_cac", "recent_purchase_ratio"]

ORACLE: dict[str, str] = {
    # binning primitives
    "quantile_bins": f"""WITH {PROFILE}, e AS (SELECT {edges("recency", 5)} AS re, {edges("frequency", 5)} AS fe,
      {edges("monetary", 5)} AS me, {edges("tenure_days", 5)} AS te FROM p)
      SELECT customer_id, {bin_code("recency", "re")} AS recency_bin, {bin_code("frequency", "fe")} AS frequency_bin,
      {bin_code("monetary", "me")} AS monetary_bin, {bin_code("tenure_days", "te")} AS tenure_days_bin FROM p, e""",
    "quantile_labels": f"""WITH {PROFILE}, e AS (SELECT {edges("recency", 4)} AS re, {edges("monetary", 4)} AS me FROM p)
      SELECT customer_id, {bin_label("monetary", "me", schema.VALUE_TIERS)} AS monetary_tier,
      {bin_label("recency", "re", schema.VALUE_TIERS)} AS recency_tier FROM p, e""",
    "fixed_bins": f"""WITH {PROFILE} SELECT customer_id,
      {fixed_bin("tenure_days", schema.TENURE_BINS, schema.TENURE_LABELS)} AS tenure_bin,
      {fixed_bin("total_purchases", [0, 5, 10, 15], ["few", "some", "many"])} AS purchases_bin,
      {fixed_bin("email_open_rate", schema.ACTIVITY_BINS, schema.ACTIVITY_LABELS)} AS open_bin FROM p""",
    "clipped_values": f"""WITH {DIRTY} SELECT customer_id, copy, {bounded("monetary", 500, 2000)}::DOUBLE AS monetary_clipped,
      {bounded("age", low=18)} AS age_floored, {bounded("support_tickets", high=5)} AS tickets_capped FROM dirty""",
    "guarded_division": f"""WITH {PROFILE} SELECT customer_id,
      coalesce(monetary / nullif(website_visits_per_month, 0), 0) AS per_visit,
      coalesce(total_purchases / nullif(support_tickets, 0), 0) AS per_ticket FROM p""",
    # sources and sinks
    "csv_round_trip": plain(ALL_COLUMNS, "p", PROFILE),
    "csv_inferred": f"WITH {DIRTY} {INFERRED}",
    "parquet_round_trip": plain(ALL_COLUMNS, "p", PROFILE),
    "json_records": plain(SCORING_COLUMNS, "p", PROFILE),
    # customer profile
    "profile_purchases": plain("custkey, total_purchases, avg_purchase_amount, monetary"),
    "profile_dates": plain("custkey, tenure_days, recency"),
    "profile_frequency": plain("custkey, frequency, purchase_frequency, days_since_last_purchase"),
    "profile_engagement": plain("custkey, email_open_rate, website_visits_per_month, support_tickets"),
    "profile_multiplier": plain("""custkey, account_type, CASE account_type WHEN 'Basic' THEN 1.0 WHEN 'Premium' THEN 2.0
      WHEN 'Enterprise' THEN 3.5 END::DOUBLE AS type_multiplier"""),
    "profile_lifetime_value": plain("custkey, retention_factor, customer_lifetime_value"),
    "profile_churn": plain("custkey, churn_score, churned"),
    "customer_profile": plain(ALL_COLUMNS, "p", PROFILE),
    "dataset_summary": f"""WITH {PROFILE} SELECT count(*) AS customers, {r("avg(churned)")} AS churn_rate,
      {r("avg(customer_lifetime_value)")} AS average_clv FROM p""",
    "account_type_counts": f"WITH {PROFILE} SELECT account_type, count(*) AS customers FROM p GROUP BY account_type",
    "clv_description": f"""WITH {PROFILE}, x AS (SELECT customer_lifetime_value AS v FROM p)
      SELECT count(v) AS count, {r("avg(v)")} AS mean, {r("stddev_samp(v)")} AS std, {r("min(v)")} AS min,
      {r("quantile_cont(v, 0.25)")} AS p25, {r("quantile_cont(v, 0.5)")} AS p50, {r("quantile_cont(v, 0.75)")} AS p75,
      {r("max(v)")} AS max FROM x""",
    # cleaning
    "deduplicated": f"WITH {DIRTY} SELECT {ALL_COLUMNS} FROM dedup",
    "medians_filled": f"WITH {FILLED} SELECT {ALL_COLUMNS} FROM filled",
    "clv_capped": f"""WITH {PROFILE} SELECT customer_id,
      {r("least(customer_lifetime_value, (SELECT quantile_cont(customer_lifetime_value, 0.99) FROM p))")}
      AS customer_lifetime_value FROM p""",
    "floored_at_zero": f"""WITH {DIRTY} SELECT customer_id,
      {", ".join(f"{bounded(c, low=0)} AS {c}" for c in NON_NEGATIVE)} FROM dedup""",
    "cleaning_row_counts": f"""WITH {DIRTY} SELECT (SELECT count(*) FROM dirty) AS rows_before,
      (SELECT count(*) FROM dedup) AS rows_after""",
    "cleaned_customers": f"""WITH {FILLED},
      cap AS (SELECT quantile_cont(customer_lifetime_value, 0.99) AS cap FROM filled),
      capped AS (SELECT * REPLACE (least(customer_lifetime_value, cap) AS customer_lifetime_value) FROM filled, cap)
      SELECT {", ".join(
          r(bounded(c, low=0)) + f" AS {c}" if c == "customer_lifetime_value"
          else f"{bounded(c, low=0)} AS {c}" if c in NON_NEGATIVE else c
          for c in schema.CUSTOMER.names
      )} FROM capped""",
    "range_violations": f"WITH {DIRTY} SELECT customer_id, copy, {range_list()} AS violations FROM dirty",
    "account_violations": f"WITH {DIRTY} SELECT customer_id, copy, {ACCOUNT_LIST} AS violations FROM dirty",
    "quarantine_counts": f"""WITH {DIRTY} SELECT {ALL_VIOLATIONS} AS violations, count(*) AS records FROM dirty GROUP BY 1""",
    "listed_columns": f"""WITH {PROFILE} SELECT customer_id,
      {", ".join(c for c in schema.FEATURES_REF if c in schema.CUSTOMER.names)} FROM p""",
    # training features
    "recency_scores": features("recency_score"),
    "frequency_scores": features("frequency_score"),
    "monetary_scores": features("monetary_score"),
    "rfm_scores": features("rfm_score, rfm_segment"),
    "rfm_segment_summary": f"""WITH {FEATURES} SELECT rfm_segment, count(*) AS customers, {r("avg(monetary)")} AS avg_monetary
      FROM f GROUP BY rfm_segment""",
    "engagement_features": features("engagement_score, activity_level, purchase_velocity, value_per_visit"),
    "temporal_features": features("tenure_segment, recency_segment, recent_purchase_ratio"),
    "value_features": features("clv_per_year, value_tier, ltv_to_cac"),
    "account_codes": features("account_code AS account_type"),
    "account_codes_held_out": f"""WITH {PROFILE}, {SPLIT.format("p")},
      labels AS (SELECT label, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS code FROM
        (SELECT DISTINCT account_type AS label FROM split WHERE NOT is_test))
      SELECT customer_id, code AS account_type FROM split JOIN labels ON label = account_type WHERE is_test""",
    "category_codes": f"""WITH {PROFILE}, {SPLIT.format("p")},
      fitted AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM
        (SELECT DISTINCT account_type AS label FROM split WHERE NOT is_test))
      SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS label,
        CASE WHEN account_type IS NOT NULL THEN coalesce(code, (SELECT count(*) FROM fitted)) END AS account_type
      FROM split LEFT JOIN fitted ON fitted.label = account_type""",
    "feature_table": f"WITH {FEATURES} SELECT * FROM ft",
    "scaled_features": f"WITH {FEATURES} {scaled('ft', 'ft', schema.FEATURES_REF)}",
    "scaled_held_out": f"""WITH {FEATURES}, {SPLIT.format("ft")},
      {"seen AS (SELECT * FROM split WHERE NOT is_test), held AS (SELECT * FROM split WHERE is_test)"}
      {scaled('held', 'seen', schema.FEATURES_REF)}""",
    # scoring features
    "serving_features": f"WITH {PROFILE}, {SERVING} SELECT * FROM sv",
    "serving_account_codes": f"WITH {PROFILE}, {SERVING} SELECT customer_id, account_type FROM sv",
    "serving_scaled": f"WITH {FEATURES}, {SERVING} {scaled('sv', 'ft', schema.FEATURES_REF)}",
    "feature_skew": f"""WITH {FEATURES}, {SERVING},
      wide AS (SELECT {", ".join(f"avg(abs(ft.{c} - sv.{c}))::DOUBLE AS {c}" for c in SKEWED)} FROM ft JOIN sv USING (customer_id)),
      tall AS (UNPIVOT wide ON {", ".join(SKEWED)} INTO NAME feature VALUE d)
      SELECT feature, {r("d")} AS mean_abs_difference FROM tall""",
    # splits
    "hash_split": f"WITH {PROFILE} SELECT customer_id, {HASH8} % 100 < 20 AS is_test FROM p",
    "stratified_split": f"""WITH {PROFILE}, placed AS (SELECT customer_id, churned,
        row_number() OVER (PARTITION BY churned ORDER BY {HASH8} % 100, {HASH11}) AS place,
        count(*) OVER (PARTITION BY churned) AS n FROM p)
      SELECT customer_id, churned, place <= (n * 20 + 50) // 100 AS is_test FROM placed""",
    "folds": f"WITH {PROFILE} SELECT customer_id, ({HASH8} % 5)::INTEGER AS fold FROM p",
    # models: what holds for any trained model
    "model_round_trip": f"WITH {PROFILE} SELECT count(*) AS customers, count(*) AS same_predictions FROM p",
    "training_report_file": f"""WITH {PROFILE}, {STRATIFIED}
      SELECT 'business_impact,churn_model,clv_model,filled_values,segmentation_model' AS parts,
        10 AS importances, 5 AS factors, 5 AS segments, count(*) AS customers, true AS explains, true AS separates,
        count(*) FILTER (churn_test) AS churn_test_rows,
        {r("1 - avg(churned) FILTER (churn_test AND clv_test)")} AS actual_retention_rate FROM marked""",
    "cross_validation_clv": f"""WITH {PROFILE} SELECT ({HASH8} % 5)::INTEGER AS fold, count(*) AS customers, count(*) AS predicted,
      count(*) AS different, true AS not_negative, true AS explains FROM p GROUP BY 1""",
    "cross_validation_segments": f"""WITH {PROFILE} SELECT ({HASH8} % 5)::INTEGER AS fold, count(*) AS customers, count(*) AS in_a_segment,
      count(*) AS measured, count(*) AS different FROM p GROUP BY 1""",
    "cross_validation": "SELECT 5::BIGINT AS folds, 5::BIGINT AS in_range, true AS summary_fits, true AS in_order",
    "clv_model": f"""WITH {PROFILE} SELECT customer_id, {r("customer_lifetime_value", 2)} AS customer_lifetime_value,
      true AS not_negative, true AS explains FROM p WHERE {HASH8} % 100 < 20""",
    "churn_model": f"""WITH {PROFILE}, {STRATIFIED}
      SELECT customer_id, churned, true AS in_range, true AS prediction_fits FROM marked WHERE churn_test""",
    "churn_probabilities": f"WITH {PROFILE} SELECT customer_id, 2 AS classes, 1.0::DOUBLE AS total, true AS in_range FROM p",
    "segment_model": f"""WITH {PROFILE} SELECT customer_id, 5 AS centers, true AS named, true AS nearest, true AS distance_fits FROM p""",
    "segment_model_profiles": f"""WITH {PROFILE} SELECT 5 AS segments, count(*) AS customers, 100.0::DOUBLE AS percent,
      true AS by_spend FROM p""",
    "segment_model_characteristics": f"""WITH {PROFILE} SELECT 5::BIGINT AS segments, count(*) AS customers,
      100.0::DOUBLE AS percent, {len(schema.FEATURES_REF)} AS features FROM p""",
    "segment_model_quality": "SELECT 5 AS n_clusters, true AS silhouette_in_range, true AS apart, true AS spread",
    "feature_importance": f"SELECT {len(schema.FEATURES_REF)} AS features, 1.0::DOUBLE AS total, true AS descending, true AS all_known",
    "top_feature_importance": "SELECT i::INTEGER AS place, true AS same FROM range(10) t(i)",
    "churn_factors": "SELECT i AS place, true AS same FROM range(10) t(i)",
    "model_info": f"""SELECT unnest(['CLV Predictor', 'Churn Predictor', 'Customer Segmentation']) AS model_name, true AS is_trained,
      {len(schema.FEATURES_REF)} AS n_features, '{",".join(schema.FEATURES_REF)}' AS feature_names""",
    "training_on_dirty_rows": f"""WITH {CLEANED},{features_over("cleaned")}
      SELECT (SELECT count(*) FROM dirty) AS rows_in, count(*) AS customers, count(*) AS complete, count(*) AS split_rows,
        {MISSING} AS filled, count(*) FILTER (purchase_velocity IS NULL) AS filled_velocity FROM ft""",
    "rows_kept": f"""WITH {PROFILE}, k AS (SELECT *, substr(customer_id, 6)::BIGINT AS k FROM p),
      holes AS (SELECT CASE WHEN k % 7 <> 0 THEN customer_id END AS customer_id, CASE WHEN k % 5 <> 0 THEN churned END AS churned,
        CASE WHEN k % 11 = 0 THEN 9 WHEN k % 13 <> 0 THEN k % 5 END AS segment_id FROM k),
      strata AS (SELECT (count(*) * 20 + 50) // 100 AS t FROM holes GROUP BY churned),
      found AS (SELECT DISTINCT segment_id FROM holes UNION SELECT unnest([0, 1, 2, 3, 4])),
      hashed AS (SELECT count(*) FILTER (customer_id IS NOT NULL AND {HASH8} % 100 < 20) AS t, count(*) AS n FROM holes)
      SELECT n - t AS hash_train, t AS hash_test, n - (SELECT sum(t) FROM strata)::BIGINT AS label_train,
        (SELECT sum(t) FROM strata)::BIGINT AS label_test, n AS profiled, (SELECT count(*) FROM found) AS profiles,
        100.0::DOUBLE AS percent FROM hashed""",
    "comprehensive_scores": f"""WITH {PROFILE} SELECT customer_id, true AS clv_fits, true AS churn_fits, true AS risk_fits,
      true AS segment_fits, 3 AS factors, 3 AS actions, true AS confidence_fits FROM p""",
    "top_risk_factors": f"WITH {PROFILE} SELECT count(*) AS customers, count(*) AS same FROM p",
    "batch_scores": f"""WITH {DIRTY}, checked AS (SELECT {ALL_VIOLATIONS} <> '' OR substr(customer_id, 6)::BIGINT % 59 = 0 AS bad,
        substr(customer_id, 6)::BIGINT % 59 = 0 AS unread FROM dirty),
      n AS (SELECT count(*) FILTER (NOT bad) AS good, count(*) FILTER (bad) AS bad, count(*) FILTER (unread) AS unread FROM checked)
      SELECT good AS total_customers, bad AS rejected_records, true AS was_timed, good AS answers, good AS good_answers,
        bad AS quarantined, unread FROM n""",
    "unread_records": f"""WITH {DIRTY} SELECT count(*) AS records, count(*) AS whole_texts
      FROM dirty WHERE substr(customer_id, 6)::BIGINT % 59 = 0""",
    "stream_scores": f"""WITH {DIRTY}, checked AS (SELECT customer_id, {ALL_VIOLATIONS} AS v FROM dirty)
      SELECT customer_id, count(*) AS answers, count(*) AS good_answers FROM checked WHERE v = '' GROUP BY 1""",
    "stream_against_batch": f"""WITH {DIRTY}, checked AS (SELECT customer_id, {ALL_VIOLATIONS} AS v FROM dirty),
      n AS (SELECT count(*) FILTER (v = '') AS good, count(*) FILTER (v <> '') AS bad FROM checked)
      SELECT good AS streamed_answers, good AS batch_answers, good AS same_answers, bad AS same_rejected, 0::BIGINT AS different FROM n""",
    "dashboard_customers": f"""WITH {PROFILE} SELECT customer_id, account_type, true AS not_negative, true AS in_range,
      true AS risk_fits, true AS named FROM p""",
    # labels on predictions
    "center_distances": f"""WITH {SCORES} SELECT customer_id, segment_id,
      {", ".join(f"{r(center_distance(c), 8)} AS distance_{i}" for i, c in enumerate(CENTERS))} FROM s""",
    "clv_quartile_segments": f"""WITH {SCORES}, e AS (SELECT {edges("predicted_clv", 4)} AS pe FROM s)
      SELECT customer_id, predicted_clv, {bin_label("predicted_clv", "pe", schema.CLV_SEGMENTS)} AS clv_segment FROM s, e""",
    "high_value_customers": scores(
        "customer_id, predicted_clv >= (SELECT quantile_cont(predicted_clv, 0.75) FROM s) AS is_high_value"
    ),
    "clv_distribution": scores(f"""{r("avg(predicted_clv)")} AS mean_clv, {r("median(predicted_clv)")} AS median_clv,
      {r("stddev_pop(predicted_clv)")} AS std_clv, {r("min(predicted_clv)")} AS min_clv, {r("max(predicted_clv)")} AS max_clv,
      {r("quantile_cont(predicted_clv, 0.25)")} AS q25_clv, {r("quantile_cont(predicted_clv, 0.75)")} AS q75_clv,
      {r("sum(predicted_clv)")} AS total_predicted_value"""),
    "churn_predictions": scores("customer_id, churn_probability, churn_prediction"),
    "risk_categories_batch": scores("customer_id, risk_category"),
    "risk_categories_request": scores("""customer_id, CASE WHEN churn_probability < 0.25 THEN 'Low Risk'
      WHEN churn_probability < 0.5 THEN 'Medium Risk' WHEN churn_probability < 0.75 THEN 'High Risk'
      ELSE 'Critical Risk' END AS risk_category"""),
    "at_risk_customers": scores("customer_id, churn_probability", "WHERE churn_probability >= 0.7::DOUBLE"),
    "risk_distribution": scores(
        ", ".join(
            f"count(*) FILTER (risk_category = '{label}') AS {label.lower().replace(' ', '_')}"
            for label in schema.RISK_LABELS
        )
        + f", count(*) FILTER (churn_prediction = 1) AS total_at_risk, {r('avg(churn_probability)')} AS avg_churn_probability"
    ),
    "clv_fixed_segments": scores(f"customer_id, {CLV_SEGMENT.format('predicted_clv')} AS clv_segment"),
    "clv_confidence": scores("customer_id, CASE WHEN tenure_days > 180 THEN 'high' ELSE 'medium' END AS confidence"),
    "segment_assignment": scores(f"customer_id, segment_id, {NAME} AS segment_name, distance_to_center"),
    "segment_profiles": f"""WITH {SCORES}, ids AS (SELECT unnest([0, 1, 2, 3, 4])::INTEGER AS segment_id),
      sized AS (SELECT ids.segment_id, count(s.customer_id) AS size FROM ids LEFT JOIN s USING (segment_id) GROUP BY 1)
      SELECT segment_id, size, {r("size * 100.0::DOUBLE / (SELECT count(*) FROM s)")} AS percentage FROM sized""",
    "segment_characteristics": f"""WITH {SCORES} SELECT segment_id, count(*) AS size,
      {", ".join(f"{r(f'avg({c})')} AS {c}_mean, {r(f'stddev_pop({c})')} AS {c}_std" for c in CENTER_FEATURES)},
      {r("count(*) * 100.0::DOUBLE / (SELECT count(*) FROM s)")} AS percentage FROM s GROUP BY segment_id""",
    "segment_actions": scores(f"""customer_id, segment_id, coalesce(([{ACTION_LIST}])[segment_id + 1],
      '{schema.DEFAULT_ACTIONS[0]}') AS recommended_actions"""),
    # metrics
    "regression_metrics": scores(f"""{r(f"sqrt(avg({ERROR} * {ERROR}))")} AS rmse, {r(f"avg(abs({ERROR}))")} AS mae,
      {r(f"1 - sum({ERROR} * {ERROR}) / (SELECT sum((true_clv - a) * (true_clv - a)) FROM s, (SELECT avg(true_clv) AS a FROM s))")} AS r2,
      {r(f"avg(abs({ERROR} / nullif(true_clv, 0))) * 100")} AS mape"""),
    "relative_error": scores(f"""{r(f"avg(abs({ERROR} / nullif(true_clv, 0))) * 100")} AS mape"""),
    "classification_metrics": scores(f"""{r(f"({TP} + {TN}) / count(*)")} AS accuracy,
      {r(f"coalesce({TP} / nullif({TP} + {FP}, 0), 0)")} AS precision, {r(f"coalesce({TP} / nullif({TP} + {FN}, 0), 0)")} AS recall,
      {r(f"coalesce(2 * {TP} / nullif(2 * {TP} + {FP} + {FN}, 0), 0)")} AS f1,
      {TN} AS true_negatives, {FP} AS false_positives, {FN} AS false_negatives, {TP} AS true_positives"""),
    "area_under_curve": f"""WITH {SCORES}, ranked AS (SELECT true_churn, rank() OVER (ORDER BY churn_probability)
        + (count(*) OVER (PARTITION BY churn_probability) - 1) / 2 AS place FROM s),
      c AS (SELECT count(*) FILTER (true_churn = 1) AS pos, count(*) FILTER (true_churn = 0) AS neg,
        sum(place) FILTER (true_churn = 1) AS places FROM ranked)
      SELECT {r("(places - pos * (pos + 1) / 2) / (pos * neg)", 8)} AS auc_roc FROM c""",
    "confusion_counts": scores(
        f"{TN} AS true_negatives, {FP} AS false_positives, {FN} AS false_negatives, {TP} AS true_positives"
    ),
    "clv_accuracy": scores(f"""{r(f"1 - avg(abs({ERROR})) / avg(true_clv)")} AS clv_prediction_accuracy,
      {r(f"avg(abs({ERROR}))")} AS avg_clv_prediction_error"""),
    "retention_lift": scores(f"""{r("1 - avg(true_churn)")} AS actual_retention_rate,
      {r("1 - avg(churn_prediction)")} AS predicted_retention_rate,
      {r("(1 - avg(churn_prediction) - 0.75::DOUBLE) / 0.75::DOUBLE * 100")} AS retention_lift_pct"""),
    "high_value_precision": scores(f"{r(HV_PRECISION)} AS high_value_identification_precision"),
    "saved_revenue": scores(f"""count(*) FILTER (churn_prediction = 1) AS at_risk_customers_count,
      {r("coalesce(sum(true_clv) FILTER (churn_prediction = 1), 0)", 2)} AS potential_saved_revenue"""),
    "business_impact": scores(f"""{r(f"1 - avg(abs({ERROR})) / avg(true_clv)", 2)} AS clv_prediction_accuracy,
      {r("1 - avg(true_churn)", 2)} AS actual_retention_rate, {r("1 - avg(churn_prediction)", 2)} AS predicted_retention_rate,
      {r("(1 - avg(churn_prediction) - 0.75::DOUBLE) / 0.75::DOUBLE * 100", 2)} AS retention_lift_pct,
      {r(HV_PRECISION, 2)} AS high_value_identification_precision,
      count(*) FILTER (churn_prediction = 1) AS at_risk_customers_count,
      {r("coalesce(sum(true_clv) FILTER (churn_prediction = 1), 0)", 2)} AS potential_saved_revenue,
      {r(f"avg(abs({ERROR}))", 2)} AS avg_clv_prediction_error"""),
    "sketched_bins": """SELECT date_trunc('month', o_orderdate)::DATE AS month, 'o_totalprice' AS name, count(o_totalprice) AS n, 10 AS bins,
      true AS ranks_near, true AS ends_exact FROM orders GROUP BY 1""",
    "silhouette": f"""WITH {CLUSTERS},
      psi AS (SELECT segment_id, max(n) AS n, sum(sq) AS psi FROM cm GROUP BY 1),
      norms AS (SELECT customer_id, any_value(segment_id) AS own, sum(x * x) AS xx FROM long GROUP BY 1),
      dots AS (SELECT customer_id, cm.segment_id, sum(x * total) AS dot FROM long JOIN cm USING (feature) GROUP BY ALL),
      sums AS (SELECT customer_id, own, segment_id, n, n * xx + psi - 2 * dot AS far
               FROM dots JOIN norms USING (customer_id) JOIN psi USING (segment_id)),
      ab AS (SELECT customer_id, max(CASE WHEN segment_id = own THEN n END) AS size,
               max(CASE WHEN segment_id = own THEN far / nullif(n - 1, 0) END) AS a,
               min(CASE WHEN segment_id <> own THEN far / n END) AS b FROM sums GROUP BY 1)
      SELECT {r("avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)", 6)} AS silhouette_sq FROM ab""",
    "silhouette_exact": f"""WITH {CLUSTERS},
      pairs AS (SELECT a.customer_id, any_value(a.segment_id) AS own, any_value(b.segment_id) AS other, b.customer_id AS partner,
                  sqrt(sum((a.x - b.x) * (a.x - b.x))) AS apart
                FROM long a JOIN long b ON a.feature = b.feature AND a.customer_id <> b.customer_id GROUP BY a.customer_id, b.customer_id),
      sums AS (SELECT customer_id, any_value(own) AS own, other, avg(apart) AS far FROM pairs GROUP BY customer_id, other),
      ab AS (SELECT customer_id, max(CASE WHEN other = own THEN far END) AS a, min(CASE WHEN other <> own THEN far END) AS b FROM sums GROUP BY 1)
      SELECT {r("avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END)", 6)} AS silhouette_score FROM ab""",
    "calinski_harabasz": f"""WITH {CLUSTERS}, overall AS (SELECT feature, avg(x) AS g FROM long GROUP BY 1),
      t AS (SELECT sum(n * (c - g) * (c - g)) AS b, sum(n * v) AS w, count(DISTINCT segment_id) AS k FROM cm JOIN overall USING (feature))
      SELECT {r("(b / (k - 1)) / (w / ((SELECT count(*) FROM s) - k))")} AS calinski_harabasz_score FROM t""",
    "davies_bouldin": f"""WITH {CLUSTERS},
      gaps AS (SELECT customer_id, segment_id, sqrt(sum((x - c) * (x - c))) AS gap
               FROM long JOIN cm USING (segment_id, feature) GROUP BY ALL),
      spread AS (SELECT segment_id, avg(gap) AS sp FROM gaps GROUP BY 1),
      apart AS (SELECT a.segment_id AS i, b.segment_id AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d
                FROM cm a JOIN cm b ON a.feature = b.feature AND a.segment_id <> b.segment_id GROUP BY ALL),
      worst AS (SELECT i, max((x.sp + y.sp) / d) AS ratio FROM apart JOIN spread x ON x.segment_id = i
                JOIN spread y ON y.segment_id = j GROUP BY i)
      SELECT {r("avg(ratio)", 6)} AS davies_bouldin_score FROM worst""",
    "cluster_count": scores("count(DISTINCT segment_id) AS n_clusters"),
    # dashboard data sets
    "dashboard_kpis": scores(f"""count(*) AS total_customers, {r("avg(predicted_clv)")} AS avg_clv,
      {r("avg((churn_probability > 0.5)::INTEGER)")} AS churn_rate,
      count(*) FILTER (predicted_clv > (SELECT quantile_cont(predicted_clv, 0.75) FROM s)) AS high_value_customers"""),
    "clv_histogram": f"""WITH {SCORES}, b AS (SELECT min(predicted_clv) AS lo, (max(predicted_clv) - min(predicted_clv)) / 50 AS w FROM s)
      SELECT least(floor((predicted_clv - lo) / w), 49)::INTEGER AS bin, {r("any_value(least(floor((predicted_clv - lo) / w), 49) * w + lo)")} AS bin_start,
      count(*) AS customers FROM s, b GROUP BY 1""",
    "risk_counts": scores("risk_category, count(*) AS customers", "WHERE risk_category IS NOT NULL GROUP BY 1"),
    "segment_counts": scores(f"""{NAME} AS segment_name, count(*) AS customers,
      {r("count(*) * 100.0::DOUBLE / (SELECT count(*) FROM s)")} AS percentage""", "GROUP BY 1"),
    "value_churn_points": scores(f"""customer_id, predicted_clv, churn_probability,
      'CLV: $' || {two_digits("predicted_clv")} || '<br>Churn: ' || {two_digits("churn_probability * 100")} || '%' AS hover_text"""),
    "value_churn_grid": scores("""floor(predicted_clv / 500.0::DOUBLE)::BIGINT AS clv_cell,
      floor(churn_probability / 0.05::DOUBLE)::BIGINT AS churn_cell, count(*) AS customers""", "GROUP BY 1, 2"),
    "orders_per_month": f"""WITH {MONTHLY} SELECT period, n AS rows, {r("v", 2)} AS value FROM months""",
    "monthly_kpi_delta": f"""WITH {MONTHLY}, changed AS (SELECT *, v - lag(v) OVER (ORDER BY period) AS d FROM months)
      SELECT period, {r("v", 2)} AS value, {r("d", 2)} AS delta, {r("v - d", 2)} AS reference FROM changed""",
    "profiles_by_year": f"""WITH {history(12)} SELECT as_of, {", ".join(HISTORY_COLUMNS)},
      {", ".join(f"{half_even(c)} AS {c}" for c in HISTORY_ROUNDED)} FROM m""",
    "kpi_deltas": f"""WITH {history(1)}, v AS (SELECT as_of, churned, round({half_even("customer_lifetime_value")} * 100)::BIGINT AS cents FROM m),
      q AS (SELECT as_of, quantile_cont(cents::DOUBLE, 0.75) AS upper FROM v GROUP BY as_of),
      k AS (SELECT as_of, count(*) AS total_customers, sum(cents)::BIGINT / count(*) / 100 AS avg_clv,
        sum(churned)::BIGINT / count(*) AS churn_rate, count(*) FILTER (cents > upper) AS high_value_customers
        FROM v JOIN q USING (as_of) GROUP BY as_of)
      SELECT as_of, total_customers, {r("avg_clv")} AS avg_clv, {r("churn_rate")} AS churn_rate, high_value_customers,
        total_customers - lag(total_customers) OVER w AS total_customers_delta, {r("avg_clv - lag(avg_clv) OVER w")} AS avg_clv_delta,
        {r("churn_rate - lag(churn_rate) OVER w")} AS churn_rate_delta,
        high_value_customers - lag(high_value_customers) OVER w AS high_value_customers_delta
      FROM k WINDOW w AS (ORDER BY as_of)""",
    "feature_correlations": correlation_query(),
    "segment_radar": f"""WITH {CLUSTERS} SELECT segment_id, feature, {r("c")} AS value FROM cm""",
    "first_customers": scores(f"""customer_id, account_type, '$' || {two_digits("predicted_clv")} AS predicted_clv,
      risk_category, {NAME} AS segment_name""", "ORDER BY customer_id LIMIT 10"),
}
ORACLE["parquet_stream_against_batch"] = ORACLE["stream_against_batch"]
