"""Named queries over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.functions import rounded
from lendlens.operators import score
from lendlens.operators.cache import written
from lendlens.operators.dedupe import repair_duplicates
from lendlens.operators.position import with_row_position
from lendlens.plans import (
    clean, dashboard, effects, experiments, extra_features, funnel, history, metrics, policy, quality,
    risk_base, risk_model,
)
from lendlens.plans.catalog import LendingCatalog
from lendlens.sources import binding, ingest

AS_OF = "2024-02-01 00:00:00"  # stands for "now", so that results repeat
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str, digits: int | None = None):
    """Register ``fn(catalog) -> DataFrame``; ``digits`` rounds doubles at the edge only."""

    def add(fn: Callable[[LendingCatalog], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(LendingCatalog.from_testdata(spark, sf_dir))
            return df if digits is None else rounded(df, digits)

        run.__name__ = name
        QUERIES[name] = run
        return fn

    return add


def _add(name: str, fn, digits: int | None = None) -> None:
    query(name, digits)(fn)


# ingest and load
_add("ingest_typed", lambda c: ingest.coerce(ingest.as_text(c.base["fct_loans"]), "fct_loans"))
_add("schema_required_columns", lambda c: ingest.required_columns(c.base))
_add("dataset_summary", lambda c: quality.dataset_summary(c.base))
_add("table_row_counts", lambda c: quality.row_counts(c.base).select("table_name", "row_count"))
_add("table_samples", lambda c: ingest.samples(c.base, 3))
_add("top_provinces", lambda c: c.base["dim_users"].groupBy("province")
     .agg(F.count(F.lit(1)).alias("user_count")).orderBy(F.desc("user_count"), "province").limit(5))
_add("loan_status_distribution", lambda c: ingest.status_distribution(c.base["fct_loans"]))


@query("dedupe_append_index")
def _dedupe(c: LendingCatalog) -> DataFrame:
    # line items hold repeated (order, line) ids; their position in the stated order is the index
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
             "l_extendedprice", "l_shipdate"]
    items = binding.read(c.spark, c.sf_dir, "lineitem").withColumn(
        "txn_id", F.concat_ws("-", F.col("l_orderkey").cast("string"),
                              F.col("l_linenumber").cast("string")))
    numbered = with_row_position(items, order)
    return repair_duplicates(numbered, "txn_id").select("txn_id", "row_index", "l_extendedprice")


# cleaned tables
_add("users_clean", lambda c: c.users)
_add("transactions_clean", lambda c: c.transactions, 6)
_add("loans_clean", lambda c: c.loans, 6)
_add("assignments_clean", lambda c: c.assignments)
_add("sessions_clean", lambda c: c.sessions)



@query("views_by_name")
def _by_name(c: LendingCatalog) -> DataFrame:
    """The registered views, read by their names."""
    c.register()
    return c.spark.sql("""
        SELECT u.province, u.risk_score_decile, count(*) AS loans, sum(l.is_default) AS defaults,
               count(a.assignment_order) AS assignments
        FROM v_fct_loans_clean l JOIN v_dim_users_clean u ON l.user_id = u.user_id
        LEFT JOIN v_ab_assignments_clean a ON l.user_id = a.user_id AND a.assignment_order = 1
        GROUP BY u.province, u.risk_score_decile""")


# funnel
_add("user_first_app_open", lambda c: funnel.first_app_open(c.sessions_enriched))
_add("user_bank_link", lambda c: funnel.bank_link(c.users_enriched))
_add("user_loan_steps", lambda c: funnel.loan_steps(c.loans_enriched))
_add("user_funnel_base", lambda c: c.funnel_base)
_add("funnel_by_segment", lambda c: c.segments.orderBy(*funnel.SEGMENT))
_add("funnel_overall", lambda c: funnel.overall(c.segments), 6)
_add("funnel_segment_rates", lambda c: funnel.segment_rates(c.segments), 6)
_add("funnel_p75_levers", lambda c: funnel.p75_levers(c.segments))
_add("funnel_top_friction", lambda c: funnel.top_friction(c.segments))
_add("funnel_by_channel", lambda c: funnel.by_channel(c.segments), 6)
_add("funnel_by_cohort", lambda c: funnel.by_cohort(c.segments), 6)

# metrics
_add("metric_signup_to_request", lambda c: metrics.signup_to_request(
    c.users_enriched, c.loans_enriched))
_add("metric_bank_link_rate", lambda c: metrics.bank_link_rate(c.users_enriched))
_add("metric_approval_disbursement", lambda c: metrics.approval_disbursement(c.loans_enriched))
_add("metric_repayment_default", lambda c: metrics.repayment_default(c.loans_enriched))
_add("metric_take_rate", lambda c: metrics.take_rate(c.loans_enriched))
_add("metric_instant_adoption", lambda c: metrics.instant_adoption(c.loans_enriched))
_add("metric_revenue_per_loan", lambda c: metrics.revenue_per_loan(c.loans_enriched))
_add("metric_late_payment", lambda c: metrics.late_payment(c.loans_enriched))
_add("metric_scorecard", lambda c: metrics.scorecard(c.users_enriched, c.loans_enriched))
_add("metric_north_star", lambda c: metrics.north_star(c.loans_enriched), 4)

# experiments
_add("user_experiment_assignments", lambda c: c.user_assignments)
_add("loans_with_experiments", lambda c: c.loans_with_experiments, 6)
_add("experiment_baseline_rpdl", lambda c: experiments.baseline_rpdl(c.loans_with_arms))
_add("experiment_window", lambda c: experiments.window_length(c.loans_with_arms))
_add("experiment_power", lambda c: experiments.power(c.loans_with_arms))
_add("experiment_naive_means", lambda c: experiments.naive_means(c.loans_with_arms), 6)
_add("experiment_naive_effects",
     lambda c: experiments.naive_effects(experiments.naive_means(c.loans_with_arms)))
_add("srm_counts", lambda c: experiments.arm_counts(c.user_assignments))
_add("experiment_srm", lambda c: experiments.sample_ratio(c.user_assignments), 6)
_add("assignment_by_weekday", lambda c: experiments.by_weekday(c.assignments_enriched), 6)
_add("assignment_by_month", lambda c: experiments.by_month(c.assignments_enriched), 6)
_add("experiment_temporal_balance", lambda c: experiments.temporal_balance(
    c.assignments_enriched), 6)
_add("rare_category_bucket", lambda c: experiments.collapse_rare(
    c.loans_with_arms.where("is_disbursed = 1")
    .withColumn("segment", F.concat_ws("/", "province", "acquisition_channel", "device_os"))
    .select("loan_id", "segment"), "segment", 150))
_add("experiment_stratified",
     lambda c: experiments.stratified_effect(c.loans_with_arms), 6)

# dashboard
_add("dash_user_funnel", lambda c: dashboard.user_funnel(c.users_enriched, c.loans_enriched))
_add("dash_experiment_loans",
     lambda c: dashboard.experiment_loans(c.loans_enriched, c.user_assignments), 6)


def _dash_funnel(c: LendingCatalog) -> DataFrame:
    return dashboard.user_funnel(c.users_enriched, c.loans_enriched)


def _dash_loans(c: LendingCatalog) -> DataFrame:
    return dashboard.experiment_loans(c.loans_enriched, c.user_assignments)


_CHOSEN = {"province": "ASIA", "device_os": "ios", "acquisition_channel": "All",
           "signup_month": None}
_add("dash_filter_values", lambda c: dashboard.filter_values(_dash_funnel(c)))
_add("dash_filtered_funnel", lambda c: dashboard.apply_filters(_dash_funnel(c), **_CHOSEN))
_add("dash_filtered_experiments", lambda c: dashboard.filtered_experiments(
    _dash_loans(c), dashboard.apply_filters(_dash_funnel(c), **_CHOSEN)), 6)
_add("dash_funnel_stages", lambda c: dashboard.funnel_stages(_dash_funnel(c)))
_add("dash_kpis", lambda c: dashboard.kpis(_dash_funnel(c)), 6)
_add("dash_experiment_kpis", lambda c: dashboard.experiment_kpis(_dash_loans(c)), 6)
_add("dash_tip_table", lambda c: dashboard.tip_table(_dash_loans(c)), 6)
_add("dash_price_table", lambda c: dashboard.price_table(_dash_loans(c)), 4)
_add("dash_experiment_matrix", lambda c: dashboard.experiment_matrix(
    _dash_loans(c), ["A", "B", experiments.UNASSIGNED]), 6)

# transactions, history, risk base
_add("txn_rolling_14d", lambda c: c.transactions_for_risk.select(
    "txn_id", "user_id", "posted_date_utc", *risk_base.trailing_names(14)), 6)
_add("txn_rolling_30d", lambda c: c.transactions_for_risk.select(
    "txn_id", "user_id", "posted_date_utc", *risk_base.trailing_names(30)), 6)
_add("days_since_payroll", lambda c: c.transactions_for_risk.select(
    "txn_id", "days_since_last_payroll"))
_add("transactions_for_risk", lambda c: c.transactions_for_risk, 6)
_add("prior_approved_history", lambda c: history.history_totals(c.loans_enriched).select(
    "loan_id", "n_approved", "late_sum", "amount_sum"), 6)
_add("prior_unapproved_history", lambda c: history.history_totals(c.loans_enriched).select(
    "loan_id", "n_unapproved"))
_add("user_prior_loan_perf", lambda c: c.prior_performance, 6)
_add("prior_default_flag", lambda c: history.prior_default_flag(c.loans_enriched))
_add("txn_snapshot_asof", lambda c: risk_base.snapshot_asof(c.loans_enriched, c.transactions), 6)
_add("risk_derived_features", lambda c: risk_base.derived_features(
    risk_base.snapshot_asof(c.loans_enriched, c.transactions)
).select("loan_id", *risk_base.DERIVED), 5)
_add("risk_model_base", lambda c: c.risk_model_base, 5)

# data quality
_add("dq_row_counts", lambda c: quality.row_counts(c.base))
_add("dq_canonical_view_counts", lambda c: quality.view_counts(c.counted_views()))
_add("dq_row_count_reconciliation", lambda c: quality.reconciliation(c.base, c.clean_views()))
_add("dq_null_key_checks", lambda c: quality.null_keys(c.row_views()))
_add("dq_referential_integrity", lambda c: quality.referential_integrity(c.row_views()))
_add("dq_transaction_validations", lambda c: quality.validations(
    c.transactions, quality.transaction_checks()))
_add("dq_loan_validations", lambda c: quality.validations(
    c.loans_enriched, quality.loan_checks()))
_add("dq_user_validations", lambda c: quality.validations(
    c.users_enriched, quality.user_checks()))
_add("dq_session_validations", lambda c: quality.validations(
    clean.grouped_sessions(c.base["fct_sessions"]), quality.session_checks()))
_add("dq_ab_test_validations", lambda c: quality.validations(
    c.assignments_enriched, quality.assignment_checks(AS_OF)))
_add("dq_distribution_checks", lambda c: quality.distribution(c.users_enriched))
_add("dq_risk_model_coverage", lambda c: quality.risk_coverage(c.risk_model_base))
_add("dq_funnel_completeness", lambda c: quality.funnel_completeness(c.funnel_base))
_add("dq_business_rules", lambda c: quality.business_rules(c.row_views(), AS_OF))
_add("dq_summary_report", lambda c: quality.summary(_checks(c)))
_add("dq_dashboard", lambda c: quality.dashboard(_checks(c), c.risk_model_base))
_add("dq_report", lambda c: quality.report(_checks(c)))
_add("dq_failed_checks", lambda c: quality.failed(_checks(c)), 6)
_add("dq_overall_status", lambda c: quality.overall_status(_checks(c)))
_add("dq_load_checks", lambda c: quality.load_checks(c.base))
_add("dq_contracts", lambda c: quality.contracts(c.loans_enriched, c.users_enriched, 250.0))


def _checks(c: LendingCatalog) -> DataFrame:
    """The check rows, a few dozen, of the tables as they are now; a report may read them several times."""
    return written(quality.all_checks(c.base, c.check_views(), c.row_views(), AS_OF))


# adjusted effects
_add("experiment_ols_hc1", lambda c: effects.ols_effects(c.loans_with_experiments), 6)
_add("experiment_logit_ame", lambda c: effects.logit_effects(c.loans_with_experiments), 6)
_add("experiment_effects", lambda c: effects.effects_table(c.loans_with_experiments))
_add("experiment_heterogeneity", lambda c: effects.heterogeneity(c.loans_with_experiments))
_add("experiment_flags", lambda c: effects.effect_flags(
    effects.heterogeneity(c.loans_with_experiments)))
_add("experiment_interaction", lambda c: effects.interaction_model(c.loans_with_experiments), 6)

# risk model; the score operators run on the given risk score, which any engine can repeat
SCORE = "baseline_risk_score"


def _scored(c: LendingCatalog) -> DataFrame:
    people = c.users_enriched.select("user_id", SCORE, "province", "device_os")
    return c.loans_enriched.where("is_approved = 1").select(
        "loan_id", "user_id", "amount", "revenue", "days_to_repay", "is_default",
        "approved_at_utc",
    ).join(people, "user_id")


def _fitted(c: LendingCatalog) -> risk_model.RiskModel:
    """The model at the penalty the search picks."""
    return risk_model.fit(c.risk_model_base)


_add("risk_features", lambda c: risk_model.feature_summary(c.risk_model_base))
_add("risk_imputed", lambda c: risk_model.imputed_features(c.risk_model_base), 5)
_add("risk_split", lambda c: risk_model.split(c.risk_model_base.select("loan_id", "is_default")))
_add("risk_eval", lambda c: score.evaluation(_scored(c), SCORE, "is_default"), 6)
_add("risk_roc", lambda c: score.roc_points(_scored(c), SCORE, "is_default"), 6)
_add("risk_pr", lambda c: score.pr_points(_scored(c), SCORE, "is_default"), 6)
_add("risk_calibration", lambda c: score.calibration(_scored(c), SCORE, "is_default"), 6)
_add("risk_stability", lambda c: risk_model.stability(
    _scored(c), SCORE, ["province", "device_os"]))
_add("risk_operating_points", lambda c: score.operating_points(_scored(c), SCORE, "is_default",
                                                               defaults=(0.45, 0.5, 0.55)), 6)
_add("risk_model_cv", lambda c: risk_model.cv_table(_fitted(c)))
_add("risk_coefficients", lambda c: risk_model.coefficient_table(_fitted(c)))
_add("risk_model_fits", lambda c: risk_model.optimality_table(_fitted(c)))
_add("risk_model_eval", lambda c: score.evaluation(_fitted(c).test, "pd", "is_default"))
_add("risk_extra_features", lambda c: extra_features.extra_features(
    c.loans_enriched, c.transactions), 5)
_add("policy_limits", lambda c: policy.loan_limits(_scored(c), SCORE).select(
    "loan_id", "risk_quartile", "loan_limit"))
_add("policy_pnl", lambda c: policy.policy_pnl(
    _scored(c).withColumn("days", F.coalesce("days_to_repay", F.lit(14))), SCORE, "days",
    {"approve all": 1.1, "score below 0.5": 0.5, "score below 0.35": 0.35}), 4)
_add("drift_psi", lambda c: score.population_stability(
    _scored(c).where(F.col("approved_at_utc") < F.lit("2024-01-20").cast("timestamp_ntz")),
    _scored(c).where(F.col("approved_at_utc") >= F.lit("2024-01-20").cast("timestamp_ntz")),
    SCORE), 6)
