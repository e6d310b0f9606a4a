"""Transaction features and the loan-level risk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.functions import flag, ratio
from lendlens.operators.asof import latest_before
from lendlens.operators.rolling import daily_rollup, trailing_features, trailing_names
from lendlens.operators.skew import join_back
from lendlens.plans.history import prior_columns, with_history

RANGES = (14, 30)
FEATURES = [*trailing_names(14), "days_since_last_payroll", *trailing_names(30)]


def day_features(transactions: DataFrame) -> DataFrame:
    """Trailing features per (user, day)."""
    return trailing_features(daily_rollup(transactions), RANGES)


def transactions_for_risk(transactions: DataFrame) -> DataFrame:
    """Trailing features per transaction: those of its (user, day)."""
    rows = transactions.select("user_id", "txn_id", "posted_date_utc")
    joined = join_back(rows, day_features(transactions), ["user_id", "posted_date_utc"])
    return joined.select("user_id", "txn_id", "posted_date_utc", *FEATURES)


def derived_features(df: DataFrame) -> DataFrame:
    """Append the 14 ratios built from the trailing features.

    ``net_cashflow`` adds inflow and spend although spend is a positive outflow,
    so it is gross turnover; the published features are defined that way.
    """
    out = {}
    for d in RANGES:
        spend, inflow = F.col(f"spend_sum_{d}d"), F.col(f"inflow_sum_{d}d")
        net = inflow + spend
        out[f"rent_share_outflows_{d}d"] = F.when(
            spend != 0, F.col(f"rent_spend_sum_{d}d") / spend)
        out[f"essentials_share_{d}d"] = F.when(
            spend != 0, F.col(f"essentials_spend_sum_{d}d") / spend)
        out[f"net_cashflow_{d}d"] = net
        out[f"inflow_vol_to_netcashflow_{d}d"] = ratio(F.col(f"inflow_std_{d}d"), F.abs(net))
        out[f"bal_vol_to_netcashflow_{d}d"] = ratio(F.col(f"bal_std_{d}d"), F.abs(net))
        out[f"cashin_to_cashout_{d}d"] = F.when(spend != 0, inflow / spend)
        out[f"overdraft_txshare_{d}d"] = ratio(
            F.col(f"neg_txn_count_{d}d"), F.col(f"txn_count_{d}d"))
    return df.withColumns(out)


DERIVED = [
    *[f"{n}_{d}d" for d in RANGES for n in ("rent_share_outflows", "essentials_share")],
    *[f"net_cashflow_{d}d" for d in RANGES],
    *[f"{n}_{d}d" for d in RANGES for n in ("inflow_vol_to_netcashflow", "bal_vol_to_netcashflow")],
    *[f"cashin_to_cashout_{d}d" for d in RANGES],
    *[f"overdraft_txshare_{d}d" for d in RANGES],
]
PRIOR = [
    "prior_loan_flag", "prior_loan_default_flag", "prior_avg_days_late", "prior_avg_amount",
    "prior_avg_revenue_to_loan", "prior_tip_take_rate", "prior_approved_loans_count",
    "prior_unapproved_loans_count",
]


def snapshot_asof(loans: DataFrame, transactions: DataFrame) -> DataFrame:
    """Approved loans with the latest earlier transaction day and its features."""
    approved = loans.where(F.col("approved_at_utc").isNotNull()).select(
        "loan_id", "user_id", "approved_at_utc"
    )
    return latest_before(
        approved, day_features(transactions), "user_id", "approved_at_utc", "posted_date_utc"
    )


def risk_model_base(users: DataFrame, loans: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row per approved loan of a known user: base, history, snapshot, ratios.

    The loans pass through the history, the snapshot lookup and the user join in
    turn; none of the parts is joined back to them by loan.
    """
    people = users.select(
        "user_id", "province", "device_os", "acquisition_channel", "baseline_risk_score",
        "payroll_frequency",
    )
    base = [
        "loan_id", "user_id", "amount", "is_default", "approved_at_utc", "disbursed_at_utc",
        "due_date_clean",
    ]
    segments = [c for c in people.columns if c != "user_id"]
    approved = with_history(loans).where(F.col("approved_at_utc").isNotNull()).select(
        *base, *[e.alias(n) for n, e in prior_columns().items()]
    )
    found = latest_before(
        approved, day_features(transactions), "user_id", "approved_at_utc", "posted_date_utc",
        how="left",
    )
    return derived_features(found.join(people, "user_id")).select(
        *base, *segments, *PRIOR,
        flag(F.col("posted_date_utc").isNotNull()).alias("txn_info_found"),
        *FEATURES, *DERIVED,
    )
