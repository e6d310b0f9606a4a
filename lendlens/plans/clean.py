"""Cleaned and enriched base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.functions import (
    concat_skip_null, flag, ratio, seconds_between, trunc_ts, weekday,
)
from lendlens.operators.ntile import fit_ntile, ntile_bucket
from lendlens.operators.skew import attach_group, ordered_index

# fixed values
ESSENTIALS = ["groceries", "utilities", "rent", "transport"]
DISCRETIONARY = ["entertainment", "dining"]
SCREENS = ["onboarding", "loan", "home"]
FUNNEL_EVENTS = {
    "is_app_open": "app_open",
    "is_bank_linked": "link_bank_success",
    "is_request_start": "start_advance_request",
    "is_request_submit": "submit_advance_request",
    "is_approved_event": "approved",
    "is_disbursed_event": "disbursed",
}


def enrich_users(users: DataFrame) -> DataFrame:
    """Users with cohort and bank-link columns, without the risk decile."""
    signup = F.col("signup_at")
    return users.withColumns({
        "signup_at_utc": signup.cast("timestamp_ntz"),
        "bank_linked_at_utc": F.col("bank_linked_at").cast("timestamp_ntz"),
        "signup_month": F.month(signup),
        "signup_year": F.year(signup),
        "signup_dow": weekday(signup),
        "bank_linked_flag": flag(F.col("bank_linked_at").isNotNull()),
        "days_taken_signup_bank_connect": F.datediff("bank_linked_at", "signup_at"),
    })


def clean_users(users: DataFrame) -> DataFrame:
    """Enriched users with the global risk decile.

    The decile is fitted like a model (nine boundary rows), then applied as an
    expression, so the table itself is never re-partitioned for it.
    """
    cuts = fit_ntile(users, "baseline_risk_score", "user_id", 10)
    return enrich_users(users).withColumn(
        "risk_score_decile", ntile_bucket(F.col("baseline_risk_score"), F.col("user_id"), cuts)
    )


def clean_transactions(transactions: DataFrame) -> DataFrame:
    direction, amount = F.col("direction"), F.col("amount")
    return transactions.withColumns({
        "posted_date_utc": F.col("posted_date").cast("timestamp_ntz"),
        "spend_amount_pos": F.when(direction == "outflow", -amount).otherwise(F.lit(0.0)),
        "inflow_amount_pos": F.when(direction == "inflow", amount).otherwise(F.lit(0.0)),
        "neg_balance_flag": flag(F.col("balance_after") < 0),
        "balance_before": F.col("balance_after") - amount,
        "spend_bucket": F.when(F.col("category").isin(ESSENTIALS), "essentials")
        .when(F.col("category").isin(DISCRETIONARY), "discretionary").otherwise("other"),
    })


def enrich_loans(loans: DataFrame) -> DataFrame:
    """Row-level loan columns: all but the first-loan flag."""
    def money(name: str):
        return F.coalesce(F.col(name), F.lit(0.0))

    amount = F.col("amount")
    revenue = money("fee") + money("tip_amount") + money("instant_transfer_fee")
    pnl = revenue - money("writeoff_amount")
    return loans.withColumns({
        "requested_year": trunc_ts("year", F.col("requested_at")),
        "requested_month": trunc_ts("month", F.col("requested_at")),
        "requested_at_utc": F.col("requested_at").cast("timestamp_ntz"),
        "approved_at_utc": F.col("approved_at").cast("timestamp_ntz"),
        "disbursed_at_utc": F.col("disbursed_at").cast("timestamp_ntz"),
        "due_date_clean": F.col("due_date").cast("date"),
        "repaid_at_utc": F.col("repaid_at").cast("timestamp_ntz"),
        "is_approved": flag(F.col("approved_at").isNotNull()),
        "is_disbursed": flag(F.col("disbursed_at").isNotNull()),
        "is_repaid": flag(F.col("status") == "repaid"),
        "is_default": flag((F.col("status") == "default") | (F.col("chargeoff_flag") == 1)),
        "days_to_approve": F.datediff("approved_at", "requested_at"),
        "days_to_disburse": F.datediff("disbursed_at", "approved_at"),
        "days_to_repay": F.datediff("repaid_at", "disbursed_at"),
        "revenue": revenue,
        "pnl": pnl,
        "revenue_to_loan": ratio(revenue, amount),
        "pnl_to_loan": ratio(pnl, amount),
        "writeoff_to_loan": ratio(money("writeoff_amount"), amount),
        "tip_to_loan": ratio(money("tip_amount"), amount),
    })


def clean_loans(loans: DataFrame) -> DataFrame:
    first = attach_group(enrich_loans(loans), ["user_id"], __first=F.min("requested_at"))
    return first.withColumn(
        "is_first_loan", flag(F.col("requested_at") == F.col("__first"))
    ).drop("__first")


def enrich_assignments(assignments: DataFrame) -> DataFrame:
    """Row-level assignment columns."""
    at = F.col("assigned_at")
    return assignments.withColumns({
        "assigned_at_utc": at.cast("timestamp_ntz"),
        "assigned_month": trunc_ts("month", at),
        "assigned_week": trunc_ts("week", at),
        "assigned_year": F.year(at),
        "assigned_dow": weekday(at),
        "is_price_test": flag(F.col("experiment_name").ilike("%Price%")),
        "is_tip_test": flag(F.col("experiment_name").ilike("%Tip%")),
        "variant_norm": F.lower("variant"),
        "experiment_variant": concat_skip_null(
            F.col("experiment_name"), F.lit(":"), F.col("variant")
        ),
    })


def grouped_assignments(assignments: DataFrame) -> DataFrame:
    """Assignments with their per-user columns, without the order, which takes another shuffle."""
    counted = attach_group(enrich_assignments(assignments), ["user_id"], __n=F.count(F.lit(1)))
    return counted.withColumn("multi_test_user", flag(F.col("__n") > 1)).drop("__n")


def clean_assignments(assignments: DataFrame) -> DataFrame:
    grouped = grouped_assignments(assignments)
    numbered = ordered_index(grouped, "user_id", "assigned_at", "assignment_id", "assignment_order")
    *columns, last = grouped.columns
    return numbered.select(*columns, "assignment_order", last)


def enrich_sessions(sessions: DataFrame) -> DataFrame:
    """Row-level session columns: calendar parts, funnel flags, screen bucket."""
    ts, screen = F.col("ts"), F.col("screen")
    bucket = F.lit("other")
    for name in reversed(SCREENS):
        bucket = F.when(screen.ilike(f"%{name}%"), name).otherwise(bucket)
    return sessions.withColumns({
        "ts_utc": ts.cast("timestamp_ntz"),
        "event_month": trunc_ts("month", ts),
        "event_week": trunc_ts("week", ts),
        "event_dow": weekday(ts),
        "event_hour": F.hour(ts),
        **{c: flag(F.col("event_name") == v) for c, v in FUNNEL_EVENTS.items()},
        "screen_bucket": bucket,
    })


def grouped_sessions(sessions: DataFrame) -> DataFrame:
    """Events with their per-session columns, without the order, which takes another shuffle."""
    spans = attach_group(
        enrich_sessions(sessions), ["session_id"],
        __start=F.min("ts"), __end=F.max("ts"), events_per_session=F.count(F.lit(1)),
    )
    return spans.withColumn(
        "session_duration_sec", seconds_between(F.col("__start"), F.col("__end"))
    ).drop("__start", "__end")


def clean_sessions(sessions: DataFrame) -> DataFrame:
    grouped = grouped_sessions(sessions)
    numbered = ordered_index(grouped, "user_id", "ts", "event_id", "event_order")
    own = [c for c in grouped.columns if c not in ("events_per_session", "session_duration_sec")]
    return numbered.select(
        *own, "event_order", "events_per_session",
        flag(F.col("event_order") == 1).alias("is_first_event"), "session_duration_sec",
    )
