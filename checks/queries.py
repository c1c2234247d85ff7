"""One query per operator; names say what is computed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import rules
from checks.frames import (
    CENTER_FEATURES,
    CENTERS,
    dirty_profile,
    measures,
    number,
    profile,
    rule_scores,
    scored_by_rules,
    staged_profile,
    staged_scores,
    tables,
)
from checks.oracle import HISTORY_COLUMNS, HISTORY_ROUNDED
from patronlens import schema
from patronlens.functions import clip, cut, qcut_code, qcut_label, quantile_edges, round_half_even, safe_divide
from patronlens.functions import sketches
from patronlens.operators import categories, clean, evaluate, features, history, labels, moments, reports, serving, split
from patronlens.operators import profile as prof
from patronlens.operators.models import ChurnModel, ClvModel, SegmentModel, summary_of_scores
from patronlens.plans.dashboard import scored_customers
from patronlens.plans.scoring import ModelSet, answers, quarantine, read_scored, score_batch, score_records
from patronlens.plans.training import TrainingRun, prepare, train
from patronlens.sources import sinks
from patronlens.sources import tables as sources
from patronlens.staging import new_path, stage
from patronlens.streaming.scoring import read_record_stream, score_stream


def r(column: str, digits: int = 4):
    return F.round(F.col(column), digits).alias(column)


def r_of(column, digits: int):
    return F.round(column, digits)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, everything else as it is; for aggregates, whose last bits depend on the row order."""
    return df.select(*[r(n, digits) if t == "double" else F.col(n) for n, t in df.dtypes])


# --- binning primitives -------------------------------------------------------------------------


def quantile_bins(spark: SparkSession, folder: str) -> DataFrame:
    p = staged_profile(spark, folder)
    names = ["recency", "frequency", "monetary", "tenure_days"]
    edges = quantile_edges(p, {n: 5 for n in names})
    return p.select("customer_id", *[qcut_code(n, edges[n]).alias(f"{n}_bin") for n in names])


def sketched_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Bins of order values from one sketch per month: how many values each month's sketch has seen, and whether the merged ones keep their rank error."""
    _, orders, _ = tables(spark, folder)
    month = F.date_trunc("month", "o_orderdate").cast("date").alias("month")
    kept = stage(sketches.column_sketches(orders, ["o_totalprice"], [month]), "sketches")
    edges = sketches.sketched_edges(kept, {"o_totalprice": 10})["o_totalprice"]
    below = [F.avg((F.col("o_totalprice") <= e).cast("double")) for e in edges[1:-1]]
    exact = orders.agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), *[b.alias(f"b{i}") for i, b in enumerate(below)]).first()
    near = all(abs(exact[f"b{i}"] - (i + 1) / 10) <= sketches.RANK_ERROR for i in range(len(below)))
    ends = (edges[0], edges[-1]) == (float(exact["low"]), float(exact["high"]))
    return kept.select("month", "name", "n", F.lit(len(edges) - 1).alias("bins"), F.lit(near).alias("ranks_near"), F.lit(ends).alias("ends_exact"))


def quantile_labels(spark: SparkSession, folder: str) -> DataFrame:
    p = staged_profile(spark, folder)
    edges = quantile_edges(p, {"monetary": 4, "recency": 4})
    tiers = schema.VALUE_TIERS
    return p.select(
        "customer_id",
        qcut_label("monetary", edges["monetary"], tiers).alias("monetary_tier"),
        qcut_label("recency", edges["recency"], tiers).alias("recency_tier"),
    )


def fixed_bins(spark: SparkSession, folder: str) -> DataFrame:
    p = profile(spark, folder)
    return p.select(
        "customer_id",
        cut("tenure_days", schema.TENURE_BINS, schema.TENURE_LABELS).alias("tenure_bin"),
        cut("total_purchases", [0, 5, 10, 15], ["few", "some", "many"]).alias("purchases_bin"),
        cut("email_open_rate", schema.ACTIVITY_BINS, schema.ACTIVITY_LABELS).alias("open_bin"),
    )


def clipped_values(spark: SparkSession, folder: str) -> DataFrame:
    d = dirty_profile(spark, folder)
    return d.select(
        "customer_id",
        "copy",
        clip("monetary", 500.0, 2000.0).alias("monetary_clipped"),
        clip("age", low=18).alias("age_floored"),
        clip("support_tickets", high=5).alias("tickets_capped"),
    )


def guarded_division(spark: SparkSession, folder: str) -> DataFrame:
    p = profile(spark, folder)
    return p.select(
        "customer_id",
        safe_divide("monetary", "website_visits_per_month").alias("per_visit"),
        safe_divide("total_purchases", "support_tickets").alias("per_ticket"),
    )


# --- sources and sinks --------------------------------------------------------------------------


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "customers-csv")
    sinks.write_csv(profile(spark, folder), path)
    return sources.read_customers_csv(spark, path)


def csv_inferred(spark: SparkSession, folder: str) -> DataFrame:
    """The customer file with inferred types, defects included: a type per column, its values and a sum or a count of letters."""
    path = new_path(spark, "customers-inferred")
    sinks.write_csv(dirty_profile(spark, folder), path)
    found = sources.read_csv_inferred(spark, path)
    kinds = dict(found.dtypes)
    wanted = []
    for c, kind in kinds.items():
        total = F.sum(F.length(c)).cast("double") if kind == "string" else F.sum(F.col(c).cast("double"))
        wanted.append(F.struct(F.lit(c).alias("name"), F.lit(kind).alias("type"), F.count(c).alias("present"), total.alias("total")))
    return rounded(found.agg(F.array(*wanted).alias("columns")).select(F.inline("columns")), 2)


def parquet_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "customers-parquet")
    sinks.write_parquet(profile(spark, folder), path)
    return sources.read_customers_parquet(spark, path)


def json_records(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "records-json")
    profile(spark, folder).select(*schema.SCORING.names).write.json(path)
    return sources.read_records_json(spark, path).select(*schema.SCORING.names)


def training_report_file(spark: SparkSession, folder: str) -> DataFrame:
    """What the written report holds of each part."""
    path = new_path(spark, "report")
    sinks.write_report(trained(spark, folder).run.report_table(spark), path)
    report = spark.read.json(path)
    sizes = F.aggregate("segmentation_model.segment_profiles", F.lit(0).cast("long"), lambda n, p: n + p["size"])
    return report.select(
        F.array_join(F.array_sort(F.array(*map(F.lit, report.columns))), ",").alias("parts"),
        F.size("clv_model.feature_importance").alias("importances"),
        F.size("churn_model.churn_factors").alias("factors"),
        F.size("segmentation_model.segment_profiles").alias("segments"),
        sizes.alias("customers"),
        (F.col("clv_model.metrics.r2") > 0).alias("explains"),
        F.col("churn_model.metrics.auc_roc").between(0.5, 1).alias("separates"),
        (sum((F.col(f"churn_model.metrics.{c}") for c in CONFUSION), F.lit(0)).cast("long")).alias("churn_test_rows"),
        F.round("business_impact.actual_retention_rate", 4).alias("actual_retention_rate"),
    )


def model_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """How many customers get the same predictions from the saved and reloaded models."""
    full = trained(spark, folder)
    again = ModelSet.load(spark, f"{full.path}/models")
    predictions = F.struct("predicted_clv", "churn_probability", "segment_id")
    data = full.run.data
    before = full.run.models.transform(data.features).select("customer_id", predictions.alias("before"))
    after = again.transform(data.features).select("customer_id", predictions.alias("after"))
    return before.join(after, "customer_id").agg(
        F.count("*").alias("customers"), F.count_if(F.col("before") == F.col("after")).alias("same_predictions")
    )


# --- customer profile ---------------------------------------------------------------------------


def profile_purchases(spark: SparkSession, folder: str) -> DataFrame:
    return measures(spark, folder).select("custkey", "total_purchases", "avg_purchase_amount", "monetary")


def profile_dates(spark: SparkSession, folder: str) -> DataFrame:
    return measures(spark, folder).select("custkey", "tenure_days", "recency")


def profile_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return measures(spark, folder).select("custkey", "frequency", "purchase_frequency", "days_since_last_purchase")


def profile_engagement(spark: SparkSession, folder: str) -> DataFrame:
    return measures(spark, folder).select(
        "custkey", "email_open_rate", "website_visits_per_month", "support_tickets"
    )


def profile_multiplier(spark: SparkSession, folder: str) -> DataFrame:
    customer, _, _ = tables(spark, folder)
    typed = customer.select(F.col("c_custkey").alias("custkey"), prof.account_type().alias("account_type"))
    return typed.withColumn("type_multiplier", prof.type_multiplier())


def profile_lifetime_value(spark: SparkSession, folder: str) -> DataFrame:
    return measures(spark, folder).select("custkey", "retention_factor", "customer_lifetime_value")


def profile_churn(spark: SparkSession, folder: str) -> DataFrame:
    return measures(spark, folder).select("custkey", "churn_score", "churned")


def customer_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile(spark, folder)


def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(prof.dataset_summary(profile(spark, folder)))


def account_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return prof.account_type_counts(profile(spark, folder))


def clv_description(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(prof.describe_column(staged_profile(spark, folder), schema.CLV_TARGET))


# --- cleaning -----------------------------------------------------------------------------------


def deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    return clean.drop_duplicate_keys(dirty_profile(spark, folder), ["copy"]).drop("copy")


def staged_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    return stage(deduplicated(spark, folder), "deduplicated")


def medians_filled(spark: SparkSession, folder: str) -> DataFrame:
    d = staged_deduplicated(spark, folder)
    return clean.fill_medians(d, clean.fit_medians(d))


def clv_capped(spark: SparkSession, folder: str) -> DataFrame:
    d = staged_profile(spark, folder)
    capped = clean.cap_lifetime_value(d, clean.fit_clv_cap(d))
    return capped.select("customer_id", r(schema.CLV_TARGET))


def floored_at_zero(spark: SparkSession, folder: str) -> DataFrame:
    return clean.floor_at_zero(deduplicated(spark, folder)).select("customer_id", *clean.NON_NEGATIVE)


def cleaning_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return clean.counts_of_keys(clean.counted_keys(dirty_profile(spark, folder), ["copy"]))


def cleaned_customers(spark: SparkSession, folder: str) -> DataFrame:
    out = clean.clean_customers(dirty_profile(spark, folder), ["copy"]).drop("copy")
    return out.withColumn(schema.CLV_TARGET, F.round(schema.CLV_TARGET, 4))


def range_violations(spark: SparkSession, folder: str) -> DataFrame:
    broken = F.array_join(clean.broken_range_rules(), ",")
    return dirty_profile(spark, folder).select("customer_id", "copy", broken.alias("violations"))


def account_violations(spark: SparkSession, folder: str) -> DataFrame:
    broken = F.array_join(clean.broken_account_rule(), ",")
    return dirty_profile(spark, folder).select("customer_id", "copy", broken.alias("violations"))


def quarantine_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per set of broken rules, the valid ones under the empty set."""
    marked = clean.mark_violations(stage(dirty_profile(spark, folder), "records"))
    reasons = F.array_join("violations", ",").alias("violations")
    bad = clean.quarantined_records(marked).select(reasons)
    good = clean.valid_records(marked).select(F.lit("").alias("violations"))
    return bad.unionAll(good).groupBy("violations").agg(F.count("*").alias("records"))


def listed_columns(spark: SparkSession, folder: str) -> DataFrame:
    p = profile(spark, folder)
    return p.select("customer_id", *features.listed_columns(p, schema.FEATURES_REF))


# --- training features --------------------------------------------------------------------------


def fitted_profile(spark: SparkSession, folder: str) -> tuple[DataFrame, features.FeatureStats]:
    p = staged_profile(spark, folder)
    return p, features.fit_features(p)


def recency_scores(spark: SparkSession, folder: str) -> DataFrame:
    return features.add_rfm_scores(*fitted_profile(spark, folder)).select("customer_id", "recency_score")


def frequency_scores(spark: SparkSession, folder: str) -> DataFrame:
    return features.add_rfm_scores(*fitted_profile(spark, folder)).select("customer_id", "frequency_score")


def monetary_scores(spark: SparkSession, folder: str) -> DataFrame:
    return features.add_rfm_scores(*fitted_profile(spark, folder)).select("customer_id", "monetary_score")


def rfm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return features.add_rfm_scores(*fitted_profile(spark, folder)).select("customer_id", "rfm_score", "rfm_segment")


def rfm_segment_summary(spark: SparkSession, folder: str) -> DataFrame:
    scored = features.add_rfm_scores(*fitted_profile(spark, folder))
    grouped = scored.groupBy("rfm_segment").agg(
        F.count("*").alias("customers"), F.avg("monetary").alias("avg_monetary")
    )
    return rounded(grouped)


def engagement_features(spark: SparkSession, folder: str) -> DataFrame:
    out = features.add_engagement_features(*fitted_profile(spark, folder))
    return out.select("customer_id", "engagement_score", "activity_level", "purchase_velocity", "value_per_visit")


def temporal_features(spark: SparkSession, folder: str) -> DataFrame:
    out = features.add_temporal_features(profile(spark, folder))
    return out.select("customer_id", "tenure_segment", "recency_segment", "recent_purchase_ratio")


def value_features(spark: SparkSession, folder: str) -> DataFrame:
    out = features.add_value_features(*fitted_profile(spark, folder))
    return out.select("customer_id", "clv_per_year", "value_tier", "ltv_to_cac")


def account_codes(spark: SparkSession, folder: str) -> DataFrame:
    out = features.encode_account_type(*fitted_profile(spark, folder))
    return out.select("customer_id", "account_type")


def account_codes_held_out(spark: SparkSession, folder: str) -> DataFrame:
    """Codes fitted on the training part, applied to the test part."""
    marked = split.mark_hash_split(staged_profile(spark, folder))
    stats = features.fit_features(split.train_part(marked))
    return features.encode_account_type(split.test_part(marked), stats).select("customer_id", "account_type")


def category_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes by a label table: of a column with a label per customer, and of account types fitted on the training part only."""
    marked = split.mark_hash_split(staged_profile(spark, folder)).withColumn("label", F.col("customer_id"))
    coded = categories.encode_by_table(marked, "label", categories.label_table(marked, "customer_id"))
    fitted = categories.label_table(split.train_part(marked), "account_type")
    return categories.encode_by_table(coded, "account_type", fitted, "keep").select("customer_id", "label", "account_type")


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    return features.feature_table(*fitted_profile(spark, folder))


def staged_features(spark: SparkSession, folder: str) -> DataFrame:
    return stage(feature_table(spark, folder), "features")


def scaled_features(spark: SparkSession, folder: str) -> DataFrame:
    table = staged_features(spark, folder)
    names = features.listed_columns(table, schema.FEATURES_REF)
    out = features.scale_features(table, features.fit_scaler(table, names))
    return rounded(out.select("customer_id", *names))


def scaled_held_out(spark: SparkSession, folder: str) -> DataFrame:
    marked = split.mark_hash_split(staged_features(spark, folder))
    names = features.listed_columns(marked, schema.FEATURES_REF)
    stats = features.fit_scaler(split.train_part(marked), names)
    return rounded(features.scale_features(split.test_part(marked), stats).select("customer_id", *names))


# --- scoring features ---------------------------------------------------------------------------


def serving_features(spark: SparkSession, folder: str) -> DataFrame:
    return serving.serving_features(profile(spark, folder).select(*schema.SCORING.names))


def serving_account_codes(spark: SparkSession, folder: str) -> DataFrame:
    return serving_features(spark, folder).select("customer_id", "account_type")


def serving_scaled(spark: SparkSession, folder: str) -> DataFrame:
    """Scoring features scaled with the statistics of the training features of all customers."""
    p, stats = fitted_profile(spark, folder)
    scaler = features.fit_scaler(stage(features.feature_table(p, stats), "features"), schema.FEATURES_REF)
    return rounded(features.scale_features(serving.serving_features(p.select(*schema.SCORING.names)), scaler))


def feature_skew(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(serving.feature_skew(*fitted_profile(spark, folder)))


# --- splits -------------------------------------------------------------------------------------


def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.mark_hash_split(profile(spark, folder)).select("customer_id", "is_test")


def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    marked = split.mark_stratified_split(staged_profile(spark, folder), schema.CHURN_TARGET)
    return marked.select("customer_id", "churned", "is_test")


def folds(spark: SparkSession, folder: str) -> DataFrame:
    return split.mark_folds(profile(spark, folder)).select("customer_id", "fold")


def cross_validation_clv(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold predictions with full settings: rows of each fold, rows that have a prediction, and whether these explain the values."""
    found = stage(ClvModel().out_of_fold(staged_features(spark, folder)), "out-of-fold")
    label = schema.CLV_TARGET
    error = F.col("predicted_clv") - F.col(label)
    r2 = 1 - F.try_divide(F.avg(error * error), F.var_pop(label))
    return found.groupBy("fold").agg(
        F.count(F.lit(1)).alias("customers"), F.count("predicted_clv").alias("predicted"), F.count_distinct("customer_id").alias("different"),
        (F.min("predicted_clv") >= 0).alias("not_negative"), (r2 > 0).alias("explains"),
    )


def cross_validation_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold segments with full settings: rows of each fold, and rows with one of the segments and a distance to its centre."""
    found = stage(SegmentModel().out_of_fold(staged_features(spark, folder)), "out-of-fold")
    return found.groupBy("fold").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(F.col("segment_id").between(0, 4)).alias("in_a_segment"),
        F.count_if(F.col("distance_to_center") >= 0).alias("measured"), F.count_distinct("customer_id").alias("different"),
    )


def cross_validation(spark: SparkSession, folder: str) -> DataFrame:
    """The summary against the scores of the five folds, for a model with its full settings."""
    table = staged_features(spark, folder)
    scores = ChurnModel().fold_scores(table)
    rows = spark.createDataFrame([(s,) for s in scores], "score double")
    summary = summary_of_scores(scores, "auc_roc")
    close = [
        F.abs(F.lit(summary[f"cv_auc_roc_{name}"]) - expected) < 1e-9
        for name, expected in (("mean", F.avg("score")), ("std", F.stddev_pop("score")), ("min", F.min("score")), ("max", F.max("score")))
    ]
    return rows.agg(
        F.count("score").alias("folds"),
        F.count_if(F.col("score").between(0, 1)).alias("in_range"),
        (close[0] & close[1] & close[2] & close[3]).alias("summary_fits"),
        ((F.min("score") <= F.avg("score")) & (F.avg("score") <= F.max("score"))).alias("in_order"),
    )


# --- models -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trained:
    """A training run with the full settings, and where it is saved."""

    run: TrainingRun
    path: str


TRAINED: dict[tuple[str, str], Trained] = {}
CONFUSION = ["true_negatives", "false_positives", "false_negatives", "true_positives"]


def trained(spark: SparkSession, folder: str) -> Trained:
    """Trained once per session and folder, over the whole tables; what comes after training reads it."""
    key = spark.sparkContext.applicationId, folder
    if key not in TRAINED:
        path = new_path(spark, "trained")
        run = train(profile(spark, folder))
        run.save(spark, path)
        TRAINED[key] = Trained(run, path)
    return TRAINED[key]


def models_of(spark: SparkSession, folder: str) -> ModelSet:
    """The saved models."""
    return ModelSet.load(spark, f"{trained(spark, folder).path}/models")


def features_of(spark: SparkSession, folder: str) -> DataFrame:
    return trained(spark, folder).run.data.features


def clv_model(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out customers of a model trained without the leaking features, and whether its predictions are of use."""
    marked = split.mark_hash_split(staged_features(spark, folder))
    model = ClvModel().fit(split.train_part(marked), schema.FEATURES_SAFE)
    test = stage(model.transform(split.test_part(marked)), "clv-test")
    r2 = evaluate.regression_metrics(test, schema.CLV_TARGET, "predicted_clv").first()["r2"]
    return test.select(
        "customer_id",
        r(schema.CLV_TARGET, 2),
        (F.col("predicted_clv") >= 0).alias("not_negative"),
        F.lit(r2 > 0.5).alias("explains"),
    )


def churn_model(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out customers with the contract of a churn prediction."""
    run = trained(spark, folder).run
    test = run.models.churn.transform(split.test_part(run.data.split, "churn_test"))
    probability = F.col("churn_probability")
    return test.select(
        "customer_id",
        F.col("churned").cast("int").alias("churned"),
        probability.between(0, 1).alias("in_range"),
        (F.col("churn_prediction") == (probability >= 0.5).cast("int")).alias("prediction_fits"),
    )


def churn_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    both = models_of(spark, folder).churn.predict_proba(features_of(spark, folder))
    p = F.col("probabilities")
    return both.select(
        "customer_id",
        F.size(p).alias("classes"),
        F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), 9).alias("total"),
        F.forall(p, lambda x: x.between(0, 1)).alias("in_range"),
    )


def segment_model(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer with the contract of a segment: a known id, its name, the nearest centre."""
    model = models_of(spark, folder).segments
    table = features_of(spark, folder)
    named = model.transform(table).select("customer_id", "segment_id", "segment_name", "distance_to_center")
    gaps = model.center_distances(table).select("customer_id", "center_distances")
    joined = named.join(gaps, "customer_id")
    least = F.array_min("center_distances")
    return joined.select(
        "customer_id",
        F.size("center_distances").alias("centers"),
        (F.col("segment_name") == F.get(F.array(*map(F.lit, schema.SEGMENT_NAMES)), F.col("segment_id"))).alias("named"),
        (F.abs(F.get("center_distances", F.col("segment_id")) - least) < 1e-6).alias("nearest"),
        (F.abs(F.col("distance_to_center") - least) < 1e-6).alias("distance_fits"),
    )


def segment_model_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Totals over the profiles of all segments."""
    model = models_of(spark, folder).segments
    place = model.features.index(model.order_feature)
    spend = F.col("center")[place]
    profiles = model.profiles(features_of(spark, folder)).withColumn("spend", spend)
    ordered = profiles.agg(F.array_sort(F.collect_list(F.struct("segment_id", -spend))).alias("rows"), F.sum("size").alias("customers"), F.round(F.sum("percentage"), 6).alias("percent"))
    return ordered.select(
        F.size("rows").alias("segments"),
        "customers",
        "percent",
        (F.array_sort(F.transform("rows", lambda x: x["col2"])) == F.transform("rows", lambda x: x["col2"])).alias("by_spend"),
    )


def segment_model_characteristics(spark: SparkSession, folder: str) -> DataFrame:
    """The means of all segments, weighted by size, are those of all customers: 0 after scaling."""
    model = models_of(spark, folder).segments
    found = model.characteristics(features_of(spark, folder))
    means = [F.abs(F.sum(F.col(f"{f}_mean") * F.col("size"))) / F.sum("size") < 1e-6 for f in model.features]
    return found.agg(
        F.count("*").alias("segments"), F.sum("size").alias("customers"), F.round(F.sum("percentage"), 6).alias("percent"),
        sum((m.cast("int") for m in means), F.lit(0)).alias("features"),
    )


def segment_model_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of the metrics, and the silhouette of the best of several starts."""
    metrics = models_of(spark, folder).segments.evaluate(features_of(spark, folder))
    row = spark.createDataFrame([tuple(metrics.values())], ", ".join(f"{m} double" for m in metrics))
    return row.select(
        F.col("n_clusters").cast("int").alias("n_clusters"),
        F.col("silhouette_sq").between(0, 1).alias("silhouette_in_range"),
        (F.col("calinski_harabasz_score") > 0).alias("apart"),
        (F.col("davies_bouldin_score") > 0).alias("spread"),
    )


def importance_facts(found: DataFrame) -> DataFrame:
    """One row: how many, their total, whether they descend and are all known."""
    listed = found.agg(F.collect_list(F.struct("feature", "importance")).alias("rows"), F.round(F.sum("importance"), 6).alias("total"))
    values = F.transform("rows", lambda x: x["importance"])
    names = F.transform("rows", lambda x: x["feature"])
    known = F.array(*map(F.lit, schema.FEATURES_REF))
    return listed.select(
        F.size("rows").alias("features"),
        "total",
        (F.reverse(F.array_sort(values)) == values).alias("descending"),
        (F.array_sort(names) == F.array_sort(known)).alias("all_known"),
    )


def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance_facts(models_of(spark, folder).clv.feature_importance(spark).coalesce(1))


def top_feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    """The ten, from the last to the first, are those of the fitted trees in order."""
    model = models_of(spark, folder).clv
    top = [tuple(row) for row in reports.top_importance(model.feature_importance(spark)).collect()]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(reversed(top))], "place long, feature string, importance double")
    found = rules.factor_facts(rows, rules.ranked_importances(spark, model.pipeline))
    return found.select(F.col("place").cast("int").alias("place"), "same")


def churn_factors(spark: SparkSession, folder: str) -> DataFrame:
    """The factors are the head of the importances of the fitted trees under other names."""
    model = models_of(spark, folder).churn
    listed = [(i, *row) for i, row in enumerate(model.churn_factors(spark).collect())]
    rows = spark.createDataFrame(listed, "place long, feature string, importance double")
    return rules.factor_facts(rows, rules.ranked_importances(spark, model.pipeline))


def model_info(spark: SparkSession, folder: str) -> DataFrame:
    info = models_of(spark, folder).info(spark)
    return info.select("model_name", "is_trained", "n_features", F.array_join("feature_names", ",").alias("feature_names"))


def training_on_dirty_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in, rows after cleaning, rows of the feature table, and the missing features that were filled."""
    dirty = dirty_profile(spark, folder)
    data = prepare(dirty, order_by=["copy"])
    filled = sum(data.filled.values())
    complete = data.features.dropna(subset=data.names).count()
    row = (dirty.count(), data.features.count(), complete, data.split.count(), filled, data.filled["purchase_velocity"])
    return spark.createDataFrame([row], "rows_in long, customers long, complete long, split_rows long, filled long, filled_velocity long")


def center_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of every customer to each centre."""
    scored = scored_by_rules(spark, folder)
    gaps = [r_of(F.col("center_distances")[i], 8).alias(f"distance_{i}") for i in range(len(CENTERS))]
    return scored.select("customer_id", "segment_id", *gaps)


# --- labels on predictions ----------------------------------------------------------------------


def clv_quartile_segments(spark: SparkSession, folder: str) -> DataFrame:
    out = labels.add_clv_quartile_segment(staged_scores(spark, folder))
    return out.select("customer_id", "predicted_clv", "clv_segment")


def high_value_customers(spark: SparkSession, folder: str) -> DataFrame:
    return labels.add_high_value_flag(staged_scores(spark, folder)).select("customer_id", "is_high_value")


def clv_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(labels.clv_distribution(staged_scores(spark, folder)))


def churn_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return rule_scores(spark, folder).select("customer_id", "churn_probability", "churn_prediction")


def risk_categories_batch(spark: SparkSession, folder: str) -> DataFrame:
    return labels.add_churn_risk(rule_scores(spark, folder)).select("customer_id", "risk_category")


def risk_categories_request(spark: SparkSession, folder: str) -> DataFrame:
    return rule_scores(spark, folder).select("customer_id", labels.risk_category_request().alias("risk_category"))


def at_risk_customers(spark: SparkSession, folder: str) -> DataFrame:
    scores = rule_scores(spark, folder)
    return scores.filter(labels.at_risk_flag()).select("customer_id", "churn_probability")


def risk_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(labels.risk_distribution(rule_scores(spark, folder)))


def clv_fixed_segments(spark: SparkSession, folder: str) -> DataFrame:
    return rule_scores(spark, folder).select("customer_id", labels.clv_fixed_segment().alias("clv_segment"))


def clv_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return rule_scores(spark, folder).select("customer_id", labels.confidence().alias("confidence"))


def segment_assignment(spark: SparkSession, folder: str) -> DataFrame:
    return rule_scores(spark, folder).select(
        "customer_id", "segment_id", labels.segment_name().alias("segment_name"), "distance_to_center"
    )


def segment_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(labels.segment_profiles(rule_scores(spark, folder)))


def segment_characteristics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(labels.segment_characteristics(rule_scores(spark, folder), CENTER_FEATURES))


def segment_actions(spark: SparkSession, folder: str) -> DataFrame:
    actions = F.array_join(labels.recommended_actions(), "; ")
    return rule_scores(spark, folder).select("customer_id", "segment_id", actions.alias("recommended_actions"))


def comprehensive_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer's nested answer, with its labels held against the numbers in it."""
    models = models_of(spark, folder)
    records = profile(spark, folder).select(*schema.SCORING.names)
    facts = rules.answer_facts(score_records(records, models)).join(records.select("customer_id", "tenure_days"), "customer_id")
    return facts.select(
        "customer_id", "clv_fits", "churn_fits", "risk_fits", "segment_fits", "factors", "actions",
        rules.follows("confidence", rules.CONFIDENCE, "tenure_days").alias("confidence_fits"),
    )


def top_risk_factors(spark: SparkSession, folder: str) -> DataFrame:
    """All answers name the three most important features of the churn model's trees."""
    models = models_of(spark, folder)
    scores = score_records(profile(spark, folder).select(*schema.SCORING.names), models)
    ranked = rules.ranked_importances(spark, models.churn.pipeline).where("place < 3").orderBy("place")
    head = F.array(*[F.lit(row["feature"]) for row in ranked.collect()])
    return scores.agg(F.count("*").alias("customers"), F.count_if(F.col("churn.top_risk_factors") == head).alias("same"))


def scoring_input(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all customers as text read back, defects and lines that are no record included."""
    path = new_path(spark, "records-json")
    records = dirty_profile(spark, folder)
    fields = [F.col(c) for c in schema.SCORING.names]
    broken = number() % 59 == 0
    text = F.when(broken, F.concat(F.lit('{"age": "x'), F.to_json(F.struct(*fields)))).otherwise(F.to_json(F.struct(*fields)))
    records.select(text.alias("value")).write.text(path)
    return sources.read_records_json(spark, path)


def batch_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of a scored batch once: the counts, what the table holds, and whether all answers are as they should be."""
    models = models_of(spark, folder)
    out = new_path(spark, "batch")
    summary = score_batch(scoring_input(spark, folder), models, out)
    facts = rules.answer_facts(answers(spark, out))
    good = F.col("clv_fits") & F.col("churn_fits") & F.col("risk_fits") & F.col("segment_fits")
    put_aside = quarantine(spark, out)
    return summary.select(
        "total_customers",
        "rejected_records",
        (F.col("processing_time_seconds") > 0).alias("was_timed"),
        facts.agg(F.count("*")).scalar().alias("answers"),
        facts.agg(F.count_if(good)).scalar().alias("good_answers"),
        put_aside.agg(F.count("*")).scalar().alias("quarantined"),
        put_aside.agg(F.count(schema.UNREAD)).scalar().alias("unread"),
    )


def unread_records(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every line that is no record, as quarantine keeps it."""
    marked = clean.mark_violations(scoring_input(spark, folder))
    kept = clean.quarantined_records(marked).where(F.col(schema.UNREAD).isNotNull())
    return kept.agg(F.count("*").alias("records"), F.count_if(F.col(schema.UNREAD).startswith('{"age": "x{')).alias("whole_texts"))


# --- metrics ------------------------------------------------------------------------------------


def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.regression_metrics(rule_scores(spark, folder), "true_clv", "predicted_clv"))


def relative_error(spark: SparkSession, folder: str) -> DataFrame:
    return regression_metrics(spark, folder).select("mape")


def classification_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.classification_metrics(rule_scores(spark, folder), "true_churn", "churn_prediction"))


def area_under_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.auc_roc(staged_scores(spark, folder), "true_churn", "churn_probability"), 8)


def confusion_counts(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion_counts(rule_scores(spark, folder), "true_churn", "churn_prediction")


def clv_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.clv_accuracy(rule_scores(spark, folder)))


def retention_lift(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.retention(rule_scores(spark, folder)))


def high_value_precision(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.high_value_precision(staged_scores(spark, folder)))


def saved_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.saved_revenue(rule_scores(spark, folder)), 2)


def business_impact(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.business_impact(staged_scores(spark, folder)), 2)


def silhouette(spark: SparkSession, folder: str) -> DataFrame:
    score = evaluate.silhouette_squared(staged_scores(spark, folder), CENTER_FEATURES)
    return rounded(spark.createDataFrame([(score,)], "silhouette_sq double"), 6)


def silhouette_exact(spark: SparkSession, folder: str) -> DataFrame:
    score = evaluate.silhouette(staged_scores(spark, folder), CENTER_FEATURES)
    return rounded(spark.createDataFrame([(score,)], "silhouette_score double"), 6)


def calinski_harabasz(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.calinski_harabasz(rule_scores(spark, folder), CENTER_FEATURES))


def davies_bouldin(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.davies_bouldin(staged_scores(spark, folder), CENTER_FEATURES), 6)


def cluster_count(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.cluster_count(rule_scores(spark, folder))


# --- dashboard data sets ------------------------------------------------------------------------


def dashboard_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer with the labels of the dashboard held against its numbers."""
    run = trained(spark, folder).run
    return rules.dashboard_facts(scored_customers(profile(spark, folder), run.data.stats, models_of(spark, folder)))


def dashboard_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(reports.kpis(staged_scores(spark, folder)))


def clv_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(reports.histogram(staged_scores(spark, folder)))


def risk_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.risk_counts(rule_scores(spark, folder))


def segment_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(reports.segment_counts(rule_scores(spark, folder)))


def value_churn_points(spark: SparkSession, folder: str) -> DataFrame:
    return reports.value_churn_points(rule_scores(spark, folder))


def value_churn_grid(spark: SparkSession, folder: str) -> DataFrame:
    return reports.value_churn_grid(rule_scores(spark, folder))


def orders_per_month(spark: SparkSession, folder: str) -> DataFrame:
    _, orders, _ = tables(spark, folder)
    return rounded(reports.period_series(orders, "o_orderdate", "o_totalprice"), 2)


def monthly_kpi_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Value, change to the month before, and the reference value a KPI card shows."""
    _, orders, _ = tables(spark, folder)
    series = reports.series_with_change(reports.period_series(orders, "o_orderdate", "o_totalprice"))
    return rounded(reports.kpi_delta(series, "value", "delta").select("period", "value", "delta", "reference"), 2)


def profiles_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """The customer table as it stood after every year."""
    customer, orders, events = tables(spark, folder)
    past = history.profile_history(customer, orders, events, history.periods_of(orders, events, months=12))
    return past.select("as_of", *[F.col(c) for c in HISTORY_COLUMNS], *[round_half_even(c, 2).alias(c) for c in HISTORY_ROUNDED])


def kpi_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """The dashboard's KPIs at the end of every month, with the change to the month before."""
    customer, orders, events = tables(spark, folder)
    past = history.profile_spans(customer, orders, events, history.periods_of(orders, events))
    return rounded(history.kpis_with_change(history.period_kpis(past)))


def feature_correlations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(moments.correlation_matrix(staged_features(spark, folder), schema.FEATURES_REF))


def segment_radar(spark: SparkSession, folder: str) -> DataFrame:
    per_segment = labels.segment_characteristics(rule_scores(spark, folder), CENTER_FEATURES)
    return rounded(reports.segment_radar(per_segment, CENTER_FEATURES))


def first_customers(spark: SparkSession, folder: str) -> DataFrame:
    return reports.customer_sample(rule_scores(spark, folder))


# --- stream -------------------------------------------------------------------------------------


def scored_stream(spark: SparkSession, folder: str, models: ModelSet, file_format: str = "json") -> tuple[DataFrame, str]:
    """Records of all customers, defects included, and the folder with the answers of a stream over them."""
    incoming, out, checkpoint = (new_path(spark, name) for name in ("incoming", "answers", "stream-state"))
    dirty_profile(spark, folder).select(*schema.SCORING.names).write.format(file_format).save(incoming)
    score_stream(read_record_stream(spark, incoming, file_format), models, out, checkpoint).awaitTermination()
    if file_format == "json":
        return sources.read_records_json(spark, incoming), out
    return spark.read.schema(schema.SCORING_TEXT).format(file_format).load(incoming), out


def stream_scores(spark: SparkSession, folder: str) -> DataFrame:
    """How often each customer is answered by the stream, and how many of these answers are as they should be."""
    _, out = scored_stream(spark, folder, models_of(spark, folder))
    facts = rules.answer_facts(answers(spark, out))
    good = F.col("clv_fits") & F.col("churn_fits") & F.col("risk_fits") & F.col("segment_fits")
    return facts.groupBy("customer_id").agg(F.count("*").alias("answers"), F.count_if(good).alias("good_answers"))


def parquet_stream_against_batch(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`stream_against_batch` over records in Parquet files."""
    return stream_against_batch(spark, folder, "parquet")


def stream_against_batch(spark: SparkSession, folder: str, file_format: str = "json") -> DataFrame:
    """All records of both, with how often they occur: a doubled, lost or different one is counted as such."""
    models = models_of(spark, folder)
    records, out = scored_stream(spark, folder, models, file_format)
    batch = new_path(spark, "batch")
    score_batch(records, models, batch)

    def counted(path: str, name: str) -> DataFrame:
        table = read_scored(spark, path)
        text = F.to_json(F.struct("customer_id", "clv", "churn", "segment", "record", "violations", "outcome"))
        return table.groupBy(text.alias("text"), "outcome").agg(F.count("*").alias(name))

    both = counted(out, "streamed").join(counted(batch, "batched"), ["text", "outcome"], "full")
    streamed, batched = F.coalesce("streamed", F.lit(0)), F.coalesce("batched", F.lit(0))
    answered = F.col("outcome") == "answered"
    return both.agg(
        F.sum(F.when(answered, streamed).otherwise(0)).alias("streamed_answers"),
        F.sum(F.when(answered, batched).otherwise(0)).alias("batch_answers"),
        F.sum(F.when(answered, F.least(streamed, batched)).otherwise(0)).alias("same_answers"),
        F.sum(F.when(~answered, F.least(streamed, batched)).otherwise(0)).alias("same_rejected"),
        F.sum(F.abs(streamed - batched)).alias("different"),
    )


def rows_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with no key, no label or an unknown segment are in one part each, and in the profiles."""
    p = staged_profile(spark, folder)
    holes = stage(
        p.select(
            F.when(number() % 7 != 0, F.col("customer_id")).alias("customer_id"),
            F.when(number() % 5 != 0, F.col("churned")).alias("churned"),
            F.when(number() % 11 == 0, 9).when(number() % 13 != 0, (number() % 5).cast("int")).alias("segment_id"),
        ),
        "holes",
    )
    hashed = split.mark_hash_split(holes)
    stratified = split.mark_stratified_split(holes, "churned")
    profiles = labels.segment_profiles(holes)

    parts = {
        "hash_train": split.train_part(hashed),
        "hash_test": split.test_part(hashed),
        "label_train": split.train_part(stratified),
        "label_test": split.test_part(stratified),
    }
    sizes = [part.agg(F.count("*")).scalar().alias(name) for name, part in parts.items()]
    totals = profiles.agg(
        F.sum("size").alias("profiled"), F.count("*").alias("profiles"), F.round(F.sum("percentage"), 6).alias("percent")
    )
    return totals.select("*", *sizes)


REGISTERED: list[Callable[[SparkSession, str], DataFrame]] = [
    quantile_bins,
    sketched_bins,
    quantile_labels,
    fixed_bins,
    clipped_values,
    guarded_division,
    csv_round_trip,
    csv_inferred,
    parquet_round_trip,
    json_records,
    training_report_file,
    model_round_trip,
    profile_purchases,
    profile_dates,
    profile_frequency,
    profile_engagement,
    profile_multiplier,
    profile_lifetime_value,
    profile_churn,
    customer_profile,
    dataset_summary,
    account_type_counts,
    clv_description,
    deduplicated,
    medians_filled,
    clv_capped,
    floored_at_zero,
    cleaning_row_counts,
    cleaned_customers,
    range_violations,
    account_violations,
    quarantine_counts,
    listed_columns,
    recency_scores,
    frequency_scores,
    monetary_scores,
    rfm_scores,
    rfm_segment_summary,
    engagement_features,
    temporal_features,
    value_features,
    account_codes,
    account_codes_held_out,
    category_codes,
    feature_table,
    scaled_features,
    scaled_held_out,
    serving_features,
    serving_account_codes,
    serving_scaled,
    feature_skew,
    hash_split,
    stratified_split,
    rows_kept,
    folds,
    cross_validation,
    cross_validation_clv,
    cross_validation_segments,
    clv_model,
    churn_model,
    churn_probabilities,
    segment_model,
    segment_model_profiles,
    segment_model_characteristics,
    segment_model_quality,
    feature_importance,
    top_feature_importance,
    churn_factors,
    model_info,
    training_on_dirty_rows,
    center_distances,
    clv_quartile_segments,
    high_value_customers,
    clv_distribution,
    churn_predictions,
    risk_categories_batch,
    risk_categories_request,
    at_risk_customers,
    risk_distribution,
    clv_fixed_segments,
    clv_confidence,
    segment_assignment,
    segment_profiles,
    segment_characteristics,
    segment_actions,
    comprehensive_scores,
    top_risk_factors,
    batch_scores,
    unread_records,
    regression_metrics,
    relative_error,
    classification_metrics,
    area_under_curve,
    confusion_counts,
    clv_accuracy,
    retention_lift,
    high_value_precision,
    saved_revenue,
    business_impact,
    silhouette,
    silhouette_exact,
    calinski_harabasz,
    davies_bouldin,
    cluster_count,
    dashboard_customers,
    dashboard_kpis,
    clv_histogram,
    risk_counts,
    segment_counts,
    value_churn_points,
    value_churn_grid,
    orders_per_month,
    monthly_kpi_delta,
    profiles_by_year,
    kpi_deltas,
    feature_correlations,
    segment_radar,
    first_customers,
    stream_scores,
    stream_against_batch,
    parquet_stream_against_batch,
]
