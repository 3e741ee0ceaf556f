"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Doubles are rounded in the result only, to six digits or as DIGITS says, since
the order of floating-point addition differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.config import STAR_SCHEMA as C
from ebbtide.functions.columns import normalise_names, right_closed_bin
from ebbtide.learning import classify, matrix, newton
from ebbtide.learning import segments as kmeans
from ebbtide.operators import (
    attribution,
    audit,
    campaign,
    distribution,
    logs,
    master,
    members,
    metrics,
    ordering,
    quality,
    reports,
    segments,
    transactions,
    value,
)
from ebbtide.plans import rules
from ebbtide.plans.modelling import BOOSTED, LEAFWISE, Modelling
from ebbtide.plans.study import Study, star_schema_study
from ebbtide.sources import star_schema
from ebbtide.sources.files import as_key_values, merge_report, union_drops

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Bucket edges and names for the auto-renew cross tab.
AUTO_RENEW_EDGES = (-0.001, 0.25, 0.75, 1.001)
AUTO_RENEW_LABELS = ("Low (0-0.25)", "Mid (0.25-0.75)", "High (0.75-1.0)")
SEED = 42


# Aggregates of large amounts carry fewer exact digits.
DIGITS = {
    "net_roi": 2, "campaign_cost": 2, "mean_clv": 2, "median_clv": 2, "roi_pct": 2, "rmse": 2, "mae": 2,
    "priority_score": 2, "mean": 4, "std": 4,
}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(
        *[F.round(c, min(digits, DIGITS.get(c, 6))).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns]
    )


def query(fn: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
    """Register a query over the star-schema study under the function's name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(star_schema_study(spark, sf_dir)))
    return fn


def raw_query(fn: Query) -> Query:
    """Register a query over the raw drops under the function's name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
    return fn


# ---- sources and raw profiles -------------------------------------------------


@raw_query
def union_all_sources(spark, sf_dir):
    return union_drops(star_schema.transaction_drops(spark, sf_dir))


@raw_query
def row_counts_by_source(spark, sf_dir):
    tx = quality.rows_per_source(union_drops(star_schema.transaction_drops(spark, sf_dir)))
    lg = quality.rows_per_source(union_drops(star_schema.log_drops(spark, sf_dir)))
    return tx.withColumn("table_name", F.lit("transactions")).unionByName(lg.withColumn("table_name", F.lit("user_logs")))


@raw_query
def null_profile(spark, sf_dir):
    tables = {
        "transactions": star_schema.transactions(spark, sf_dir),
        "user_logs": star_schema.user_logs(spark, sf_dir),
        "members": star_schema.members(spark, sf_dir),
    }
    out = None
    for name, df in tables.items():
        part = master.null_counts(df).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@raw_query
def table_profile(spark, sf_dir):
    return quality.table_profile(star_schema.members(spark, sf_dir))


@raw_query
def qc_invalid_age(spark, sf_dir):
    return quality.invalid_ages(star_schema.members(spark, sf_dir))


@raw_query
def qc_overpaid(spark, sf_dir):
    return quality.overpaid(star_schema.transactions(spark, sf_dir))


@raw_query
def qc_zero_secs(spark, sf_dir):
    return quality.zero_seconds(star_schema.user_logs(spark, sf_dir))


@raw_query
def qc_key_overlap(spark, sf_dir):
    return quality.key_overlap(star_schema.train_labels(spark, sf_dir), star_schema.members(spark, sf_dir))


@raw_query
def qc_churn_rate(spark, sf_dir):
    return quality.churn_rates(
        {"train_v2": star_schema.train_labels(spark, sf_dir), "train": star_schema.earlier_labels(spark, sf_dir)}
    )


# ---- features -------------------------------------------------------------------


@raw_query
def transaction_features(spark, sf_dir):
    return transactions.transaction_features(
        star_schema.transactions(spark, sf_dir), star_schema.train_labels(spark, sf_dir)
    )


@raw_query
def transaction_features_cutoff(spark, sf_dir):
    return transactions.transaction_features(
        star_schema.transactions(spark, sf_dir), star_schema.train_labels(spark, sf_dir), C.label_cutoff
    )


@raw_query
def log_features_single(spark, sf_dir):
    return logs.log_features_single(star_schema.user_logs(spark, sf_dir), star_schema.train_labels(spark, sf_dir))


@raw_query
def log_features_partial(spark, sf_dir):
    ids = star_schema.train_labels(spark, sf_dir).select("msno")
    drops = star_schema.log_drops(spark, sf_dir).items()
    return union_drops({tag: logs.log_partial(d, C.secs_above, C.secs_up_to).join(ids, "msno", "left_semi") for tag, d in drops})


@raw_query
def log_features_twopass(spark, sf_dir):
    return logs.log_features_twopass(
        star_schema.log_drops(spark, sf_dir).values(),
        star_schema.train_labels(spark, sf_dir),
        C.log_snapshot,
        C.secs_above,
        C.secs_up_to,
    )


@query
def log_coverage(s):
    return logs.log_coverage(s.labels, s.log_features())


@raw_query
def city_frequency_rank(spark, sf_dir):
    return members.frequency_rank(star_schema.members(spark, sf_dir), "city", "city_freq_rank")


@raw_query
def registered_via_onehot(spark, sf_dir):
    raw = star_schema.members(spark, sf_dir)
    return members.registered_via_onehot(raw, members.top_categories(raw, "registered_via", 5), naming="rank")


@query
def member_features(s):
    return s.member_features()


@query
def master_features(s):
    return s.master_raw()


@query
def master_features_imputed(s):
    return s.master().drop("split")


@query
def null_audit(s):
    return master.null_counts(s.master_raw())


@query
def feature_null_audit(s):
    return master.feature_null_audit(s.master_raw(), s.master().drop("split"))


@query
def missing_feature_flags(s):
    return master.missing_feature_flags(s.master_raw())


# ---- distributions and cross tabs ---------------------------------------------------


@query
def numeric_summary(s):
    return distribution.numeric_summary(s.master(), (*master.TRANSACTION_FEATURES, *master.LOG_FEATURES))


@query
def quantiles(s):
    return distribution.quantiles(
        s.master(), ("total_paid", "n_transactions", "avg_daily_secs", "age"), (0.5, 0.75, 0.9, 0.99), ["is_churn"]
    )


@query
def clip_p99(s):
    return distribution.cap_at_quantile(s.master().select("msno", "total_paid"), "total_paid", 0.99)


@query
def histogram(s):
    return distribution.histogram(s.master(), "total_paid", 60, 0.99)


@query
def registration_histogram(s):
    known = s.master().filter(F.col("registration_init_time") > 0)
    return distribution.histogram(known, "registration_init_time", 40)


@query
def rate_histogram(s):
    out = None
    for c in ("auto_renew_rate", "cancel_rate"):
        part = distribution.rounded_value_counts(s.master(), c).select(F.lit(c).alias("feature"), F.col(c).alias("rate"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query
def churn_by_auto_renew(s):
    joined = s.transaction_features().join(s.labels, "msno")
    bucket = right_closed_bin(F.col("auto_renew_rate"), AUTO_RENEW_EDGES, AUTO_RENEW_LABELS)
    return distribution.rate_by(joined, bucket, "is_churn", "auto_renew_bucket").filter(
        F.col("auto_renew_bucket").isNotNull()
    )


@query
def churn_rate_by_dimension(s):
    raw = s.members_raw.select("msno", "city", "registered_via", F.coalesce("gender", F.lit("unknown")).alias("gender"))
    joined = s.labels.join(raw, "msno", "left")
    out = None
    for dim in ("city", "registered_via", "gender"):
        rates = distribution.rate_by(joined.filter(F.col(dim).isNotNull()), dim, "is_churn", "_key")
        top = rates.orderBy(F.col("churn_rate").desc(), F.col("_key")).limit(10)
        part = top.select(
            F.lit(dim).alias("dimension"), F.col("_key").cast("string").alias("category"), "n_customers", "churned", "churn_rate"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def engagement_by_churn(s):
    named = F.when(F.col("is_churn") == 0, "Retained").when(F.col("is_churn") == 1, "Churned")
    joined = s.log_features().join(s.labels, "msno").withColumn("churn_label", named)
    return distribution.quantiles(
        joined, ("completion_rate", "skip_rate", "days_since_last_log"), [0.5], ["churn_label"]
    ).drop("share").withColumnRenamed("quantile", "median")


@query
def engagement_boxplot(s):
    joined = s.log_features().join(s.labels, "msno")
    return distribution.box_summary(joined, ("completion_rate", "skip_rate", "days_since_last_log"), "is_churn")


@query
def stratified_sample(s):
    return ordering.sample_n(s.master().select("msno", "is_churn"), 100, SEED, "msno", ["is_churn"])


@query
def uniform_sample(s):
    return ordering.sample_n(s.master().select("msno", "is_churn"), 300, SEED, "msno")


# ---- split and leakage ----------------------------------------------------------------


@query
def temporal_split(s):
    return s.master().select("msno", "registration_init_time", "split")


@query
def split_summary(s):
    return audit.split_summary(s.master())


@query
def class_balance(s):
    return audit.class_balance(s.master(), by=["split"])


@query
def kv_artifact(s):
    balance = audit.class_balance(s.master()).select(
        F.round("class_weight_ratio", 6).alias("class_weight_ratio"),
        "n_majority",
        "n_minority",
        F.round("overall_churn_rate", 6).alias("overall_churn_rate"),
    )
    return as_key_values(
        balance,
        {"class_weight_ratio": "%.6f", "n_majority": "%d", "n_minority": "%d", "overall_churn_rate": "%.6f"},
    )


@query
def kv_threshold(s):
    best = optimal_threshold(s).select(
        F.round("optimal_threshold", 2).alias("optimal_threshold"),
        "business_cost",
        F.lit(C.fn_cost).alias("fn_cost_per_unit"),
        F.lit(C.fp_cost).alias("fp_cost_per_unit"),
        *[F.round(c, 4).alias(c) for c in ("f1", "precision", "recall")],
    )
    formats = {"optimal_threshold": "%.2f", "business_cost": "%d", "fn_cost_per_unit": "%d", "fp_cost_per_unit": "%d"}
    return as_key_values(best, {**formats, "f1": "%.4f", "precision": "%.4f", "recall": "%.4f"})


@query
def leakage_cutoff_contrast(s):
    return audit.cutoff_contrast(s.master(), "last_expire_date", C.label_cutoff)


@query
def single_feature_auc(s):
    return audit.single_feature_auc(s.master())


@query
def leakage_expiry_bins(s):
    return audit.churn_by_bin(s.master(), "last_expire_date", C.expiry_edges, C.expiry_labels)


@query
def scaler_stats(s):
    columns = (*master.TRANSACTION_FEATURES, *master.LOG_FEATURES, *master.MEMBER_FEATURES)
    return segments.scaling(s.master(), columns, F.col("split") == "train")


# ---- segments ---------------------------------------------------------------------------


@query
def standardize(s):
    columns = segments.CLUSTER_FEATURES
    return segments.standardize(s.master().select("msno", *columns), columns).select("msno", *[f"z_{c}" for c in columns])


@query
def assign_centroid(s):
    return s.segmented().select("msno", "cluster", "distance")


@query
def kmeans_fixed_passes(s):
    """Three K-Means passes from the rules' centres."""
    found = kmeans.fixed_passes(kmeans.cluster_matrix(s.master()), rules.CENTROIDS, 3)
    return found.select("cluster", "n_rows", F.round("cost", 4).alias("cost"), *[F.round(c, 6).alias(c) for c in found.columns[3:]])


@query
def name_segments(s):
    return segments.name_segments(segments.cluster_profile(s.segmented().drop("segment_label")))


@query
def segment_profiles(s):
    return segments.segment_profiles(s.segmented())


@query
def segment_onehot(s):
    return audit.segment_onehot(s.segmented().select("msno", "segment_label"))


@query
def normalize_columns(s):
    pivoted = s.segmented().groupBy("split").pivot("segment_label", list(audit.SEGMENTS)).agg(F.count(F.lit(1)))
    return normalise_names(pivoted.na.fill(0))


# ---- evaluation ----------------------------------------------------------------------------


def _val(s: Study) -> DataFrame:
    return s.rule_models().filter(F.col("split") == "val")


@query
def roc_auc(s):
    return metrics.roc_auc(s.rule_models(), "is_churn", "churn_prob", ["model", "split"])


@query
def classification_metrics(s):
    return metrics.classification_metrics(s.rule_models(), "is_churn", "churn_prob", C.default_threshold, ["model", "split"])


@query
def confusion_matrix(s):
    return metrics.confusion_matrix(s.rule_models(), "is_churn", "churn_prob", C.default_threshold, ["model", "split"])


@query
def class_report(s):
    return metrics.class_report(s.rule_scores(), "is_churn", "churn_prob", C.default_threshold)


@query
def roc_curve(s):
    return metrics.roc_curve(s.rule_models(), "is_churn", "churn_prob", ["model"])


@query
def pr_curve(s):
    return metrics.pr_curve(s.rule_models(), "is_churn", "churn_prob", ["model"])


@query
def average_precision(s):
    return metrics.average_precision(s.rule_models(), "is_churn", "churn_prob", ["model"])


def _sweep(s: Study) -> DataFrame:
    """The threshold is chosen on the validation split."""
    val = s.rule_scores().filter(F.col("split") == "val")
    return metrics.threshold_sweep(val, "is_churn", "churn_prob", C.fn_cost, C.fp_cost)


@query
def threshold_sweep(s):
    return _sweep(s)


@query
def optimal_threshold(s):
    return metrics.optimal_threshold(_sweep(s))


@query
def threshold_savings(s):
    return metrics.threshold_savings(_sweep(s), C.default_threshold)


def _comparison(s: Study) -> DataFrame:
    return metrics.model_comparison(_val(s), "is_churn", "churn_prob", C.default_threshold)


@query
def model_comparison_merge(s):
    """Two batches of models, the second repeating one model of the first."""
    val = _val(s)
    first = val.filter(F.col("model").isin("Rule Main", "Rule Activity"))
    second = val.filter(F.col("model") != "Rule Main")
    tables = [
        rounded(metrics.model_comparison(v, "is_churn", "churn_prob", C.default_threshold), 4) for v in (first, second)
    ]
    return merge_report(tables[0], tables[1], "model")


@query
def select_final_model(s):
    return metrics.select_final_model(_comparison(s), rules.ENSEMBLE)


# ---- value and campaign -----------------------------------------------------------------------


@query
def clv_target(s):
    return s.clv()


@query
def clv_training_set(s):
    features = [c for c in master.feature_columns(s.master().columns)]
    return value.clv_training_set(s.master().select("msno", "split", *features), s.clv())


@query
def regression_metrics(s):
    return metrics.regression_metrics(s.rule_values(), "actual_clv", "predicted_clv", ["split"])


@query
def residuals(s):
    return metrics.residuals(s.rule_values(), "actual_clv", "predicted_clv")


@query
def segment_clv(s):
    return campaign.in_order(value.segment_value(s.rule_values(), s.segmented()), "mean_clv", "segment_label")


@query
def segment_priority(s):
    table = value.segment_priority(value.segment_value(s.rule_values(), s.segmented()), s.segmented())
    return campaign.in_order(table, "priority_score", "segment_label")


def _campaign(s: Study) -> DataFrame:
    """Test subscribers at the threshold chosen on validation rows.

    Scope labelled_retained: only subscribers known to have stayed have a value.
    """
    threshold = metrics.optimal_threshold(_sweep(s)).select("optimal_threshold").scalar()
    return campaign.campaign_scoring(s.rule_scores().filter(F.col("split") == "test"), s.rule_values(), threshold)


@query
def campaign_scoring(s):
    return _campaign(s)


@query
def campaign_target(s):
    return campaign.campaign_target(_campaign(s), C.high_value_quantile)


@query
def campaign_roi(s):
    return campaign.campaign_roi(campaign.campaign_target(_campaign(s)), C.retention_rate, C.offer_cost)


@query
def roi_sensitivity(s):
    return campaign.roi_sensitivity(campaign.campaign_target(_campaign(s)))


@query
def segment_roi(s):
    return campaign.in_order(campaign.segment_roi(_campaign(s), s.segmented(), C.retention_rate, C.offer_cost), "net_roi", "segment")


@query
def recommended_segment(s):
    return campaign.recommended_segment(segment_roi(s)).drop("position")


@query
def roi_summary(s):
    return campaign.roi_summary(campaign_roi(s), segment_roi(s).drop("position"))


@query
def kpi_overview(s):
    m = s.master()
    return reports.kpi_overview(
        audit.class_balance(m), audit.class_balance(m.filter(F.col("split") == "test")), _comparison(s), campaign_roi(s)
    )


@query
def report_segments(s):
    return reports.report_segments(segment_profiles(s))


@query
def report_roi(s):
    return reports.report_roi(segment_roi(s))


@query
def report_threshold(s):
    return reports.report_threshold(optimal_threshold(s))


@query
def report_campaign(s):
    return reports.report_campaign(campaign_roi(s))


# ---- attribution ----------------------------------------------------------------------------------


def _linear(s: Study) -> DataFrame:
    return attribution.linear_attributions(s.master(), rules.weights(rules.MAIN))


@query
def linear_attributions(s):
    return _linear(s)


NEWTON_FEATURES = ("n_transactions", "cancel_rate")
NEWTON_STEPS = 4


@query
def newton_logistic_steps(s):
    """Coefficients after each of a fixed number of Newton steps on train rows, classes balanced."""
    train = s.master().filter(F.col("split") == "train")
    train = train.withColumn("_weight", matrix.class_weights(train))
    fitted = newton.fit_newton(train, NEWTON_FEATURES, weight="_weight", max_steps=NEWTON_STEPS, tolerance=0.0)
    return newton.step_table(fitted, train)


@query
def attribution_importance(s):
    return attribution.attribution_importance(_linear(s))


@query
def feature_place(s):
    return attribution.feature_place(attribution.attribution_importance(_linear(s)), "n_transactions")


@query
def top_risk_customers(s):
    return attribution.top_risk(s.rule_scores(), 100)


@query
def explanation_cases(s):
    cases = attribution.explanation_cases(s.rule_scores(), C.default_threshold)
    explained = s.master().join(cases.select("msno"), "msno", "left_semi")
    parts = attribution.linear_attributions(explained, rules.weights(rules.MAIN), background=s.master())
    return attribution.explain_cases(cases, parts)


@query
def oof_fold_assignment(s):
    return classify.assign_folds(s.master().filter(F.col("split") == "train").select("msno", "is_churn"), 5, SEED)


# ---- fitted models (checked by properties in tests, since SQL cannot fit them) -------------------


def _modelling(study: Study) -> Modelling:
    """The fitted models of the registered queries, of the full study; forgotten with it."""
    if "models" not in study.fitted:
        study.fitted["models"] = Modelling(study)
    return study.fitted["models"]


def model_query(fn: Callable[[Modelling], DataFrame]) -> Callable[[Modelling], DataFrame]:
    """Register a query over models fitted on all rows of the study."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(_modelling(star_schema_study(spark, sf_dir))))
    return fn


def _steps(name: str, result) -> DataFrame:
    """Metrics of a two-step fit: val from the train-only model, test from the refit."""
    return classify.evaluate(result[0], ["model", "split"])


@model_query
def kmeans_k_sweep(m):
    return m.k_sweep()


@model_query
def kmeans_segments(m):
    return m.kmeans_segments().select("msno", "cluster", "segment_label")


@model_query
def kmeans_segment_profiles(m):
    return segments.segment_profiles(m.kmeans_segments())


@model_query
def pca_projection(m):
    return kmeans.variance_columns(*kmeans.pca_projection(m.cluster_matrix()))


@model_query
def lr_metrics(m):
    return _steps("linear", m.linear())


@model_query
def top_coefficients(m):
    table = classify.coefficient_table(m.study.labels.sparkSession, m.linear()[1], m.names)
    return classify.top_coefficients(table, 10)


@model_query
def rf_grid(m):
    return m.forest_grid()[0]


@model_query
def rf_metrics(m):
    return _steps("forest", m.forest())


@model_query
def rf_importances(m):
    return classify.importance_table(m.study.labels.sparkSession, m.forest()[1], m.names)


@model_query
def tuning_history(m):
    return m.tuned(BOOSTED)[0].unionByName(m.tuned(LEAFWISE)[0])


@model_query
def gbt_metrics(m):
    return _steps(BOOSTED, m.boosted(BOOSTED))


@model_query
def gbt2_metrics(m):
    return _steps(LEAFWISE, m.boosted(LEAFWISE))


@model_query
def oof_scores(m):
    return m.out_of_fold()


@model_query
def meta_learners(m):
    return m.stacking()["table"]


@model_query
def stacking_metrics(m):
    return classify.evaluate(m.stacking()["scores"], ["model", "split"])


@model_query
def churn_scores(m):
    return m.decided_scores()


@model_query
def model_comparison(m):
    return m.comparison()


@model_query
def final_model(m):
    return metrics.select_final_model(m.comparison(), "Stacking Ensemble").withColumn(
        "decision_threshold", F.lit(m.threshold())
    )


@model_query
def ridge_alpha_sweep(m):
    return m.ridge()[0].withColumn("position", F.row_number().over(W.orderBy("rmse", "alpha")))


@model_query
def ridge_coefficients(m):
    table = classify.coefficient_table(m.study.labels.sparkSession, m.ridge()[2], m.names)
    return classify.largest_coefficients(table, 10)


@model_query
def clv_model_comparison(m):
    best_first = W.partitionBy("split").orderBy("rmse", "model")
    return m.value_comparison().withColumn("position", F.row_number().over(best_first))


@model_query
def clv_predictions(m):
    return m.clv_predictions()


@model_query
def tree_attributions(m):
    return m.sampled_attributions()


@model_query
def tree_attribution_importance(m):
    return attribution.attribution_importance(m.sampled_attributions()).filter(F.col("importance_rank") <= 20)


@model_query
def model_explanation_cases(m):
    return m.case_attributions()


@model_query
def top_risk_attributions(m):
    return m.top_risk_attributions()


@model_query
def clv_attributions(m):
    return m.value_attributions()


@model_query
def clv_attribution_importance(m):
    return attribution.attribution_importance(m.value_attributions()).filter(F.col("importance_rank") <= 10)


@model_query
def clv_predictions_everyone(m):
    return m.clv_predictions("all")


@model_query
def model_campaign(m):
    return campaign.campaign_roi(m.campaign("all"), C.retention_rate, C.offer_cost)
