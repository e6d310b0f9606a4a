"""Further risk features per approved loan: income cadence, liquidity, momentum, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.operators.asof import latest_before
from lendlens.plans.history import with_history

RANGES = (14, 30)


def daily_liquidity(transactions: DataFrame) -> DataFrame:
    """Flows and balances per (user, day); the last transaction by id closes the day."""
    spend = F.col("spend_amount_pos")
    discretionary = F.when(F.col("spend_bucket") == "discretionary", spend).otherwise(F.lit(0.0))
    return transactions.groupBy("user_id", "posted_date_utc").agg(
        F.sum("inflow_amount_pos").alias("inflow"),
        F.sum(spend).alias("spend"),
        F.sum(discretionary).alias("discretionary"),
        F.max_by("balance_after", "txn_id").alias("eod"),
        F.min("balance_after").alias("low"),
        F.max("is_payroll").alias("payroll"),
    )


def _over(n: Column, d: Column) -> Column:
    return n / F.nullif(d, F.lit(0.0))


def liquidity_features(transactions: DataFrame) -> DataFrame:
    """Features per (user, day); a window holds at most one row per day of a user."""
    by_day = Window.partitionBy("user_id").orderBy("__day")
    day = F.unix_date(F.col("posted_date_utc").cast("date"))
    daily = daily_liquidity(transactions).withColumn("__day", day)
    earlier = by_day.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paid = F.when(F.col("payroll") == 1, F.col("__day"))
    daily = daily.withColumn("__gap", paid - F.max(paid).over(earlier))
    features = {"median_payroll_gap_days": F.percentile("__gap", F.lit(0.5)).over(so_far)}
    net = F.col("inflow") - F.col("spend")
    for d in RANGES:
        frame = by_day.rangeBetween(-(d - 1), 0)
        preceding = by_day.rangeBetween(-(2 * d - 1), -d)
        inflow, spend = F.sum("inflow").over(frame), F.sum("spend").over(frame)
        balance = F.avg("eod").over(frame)
        features |= {
            f"avg_eod_balance_{d}d": balance,
            f"min_balance_{d}d": F.min("low").over(frame),
            f"overdraft_days_{d}d": F.count(F.when(F.col("low") < 0, 1)).over(frame),
            f"outflow_to_inflow_{d}d": _over(spend, inflow),
            f"discretionary_share_{d}d": _over(F.sum("discretionary").over(frame), spend),
            f"net_cf_momentum_{d}d": F.sum(net).over(frame)
            - F.coalesce(F.sum(net).over(preceding), F.lit(0.0)),
            f"balance_to_outflow_{d}d": _over(balance, spend),
            f"balance_to_inflow_{d}d": _over(balance, inflow),
        }
    return daily.select(
        "user_id", "posted_date_utc", *[c.alias(n) for n, c in features.items()]
    )


def history_columns() -> dict[str, Column]:
    """Rates over the user's earlier disbursed loans."""
    n = F.nullif(F.col("disbursed_n"), F.lit(0)).cast("double")
    return {
        "hist_repay_rate": F.col("n_repaid") / n,
        "hist_default_rate": F.col("n_bad") / n,
        "hist_default_count": F.col("n_bad"),
        "hist_avg_late_days": F.col("late_sum") / F.nullif(F.col("late_n"), F.lit(0)),
        "hist_avg_late_days_count": F.col("late_n"),
    }


def extra_features(loans: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row per approved loan with history rates and the latest earlier day's features."""
    approved = with_history(loans).where(F.col("approved_at_utc").isNotNull()).select(
        "loan_id", "user_id", "approved_at_utc",
        *[c.alias(n) for n, c in history_columns().items()],
    )
    return latest_before(
        approved, liquidity_features(transactions), "user_id", "approved_at_utc",
        "posted_date_utc", how="left",
    ).drop("approved_at_utc", "posted_date_utc")
