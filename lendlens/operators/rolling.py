"""Trailing day-range features per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_SUMS = ["inflow", "spend", "essentials", "rent", "neg_count", "n", "nz_bal", "nz_bal_n"]
_MOMENTS = ["inflow", "bal"]


def daily_rollup(transactions: DataFrame) -> DataFrame:
    """One row per (user, posting day).

    All rows of a day are peers of a day-range frame, so every trailing feature
    is a function of this roll-up. It is built with map-side aggregation, and a
    user holds at most one row per calendar day however many rows it has.
    """
    essentials = F.when(F.col("spend_bucket") == "essentials", F.col("spend_amount_pos"))
    rent = F.when(F.col("category") == "rent", F.col("spend_amount_pos"))
    bal = F.col("balance_after")

    def moments(name: str, c: Column) -> list[Column]:
        n = F.count(c)
        return [
            n.alias(f"{name}_n"),
            F.avg(c).alias(f"{name}_avg"),
            (F.var_pop(c) * n).alias(f"{name}_m2"),
            F.min(c).alias(f"{name}_min"),
            F.max(c).alias(f"{name}_max"),
        ]

    return transactions.groupBy("user_id", "posted_date_utc").agg(
        F.sum("inflow_amount_pos").alias("inflow"),
        F.sum("spend_amount_pos").alias("spend"),
        F.sum(F.coalesce(essentials, F.lit(0.0))).alias("essentials"),
        F.sum(F.coalesce(rent, F.lit(0.0))).alias("rent"),
        F.sum("neg_balance_flag").alias("neg_count"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.nullif(bal, F.lit(0.0))).alias("nz_bal"),
        F.count(F.nullif(bal, F.lit(0.0))).alias("nz_bal_n"),
        F.max(F.when(F.col("is_payroll") == 1, F.col("posted_date_utc"))).alias("payroll_at"),
        *moments("inflow", F.col("inflow_amount_pos")),
        *moments("bal", bal),
    )


def _centred(name: str, user: WindowSpec) -> dict[str, Column]:
    """Per day: first and second moment around one value near the user's level.

    Moments around zero would cancel where the deviation is small against the
    level; around the user's mean what is lost stays below a hundred-millionth of
    a cent-sized deviation.
    """
    n = F.col(f"{name}_n")
    off = F.col(f"{name}_avg") - F.avg(f"{name}_avg").over(user)
    return {
        f"{name}_s1": F.coalesce(n * off, F.lit(0.0)),
        f"{name}_s2": F.coalesce(F.col(f"{name}_m2") + n * off * off, F.lit(0.0)),
    }


def _std(name: str, frame: WindowSpec) -> Column:
    """Population deviation of all rows in the frame's days; exactly 0 if they are equal."""
    n = F.nullif(F.sum(f"{name}_n").over(frame), F.lit(0))
    mean = F.sum(f"{name}_s1").over(frame) / n
    variance = F.sum(f"{name}_s2").over(frame) / n - mean * mean
    constant = F.min(f"{name}_min").over(frame) == F.max(f"{name}_max").over(frame)
    return F.when(constant, F.lit(0.0)).otherwise(
        F.sqrt(F.when(variance < 0, 0.0).otherwise(variance))
    )


def trailing_names(days: int) -> list[str]:
    return [
        f"inflow_sum_{days}d", f"spend_sum_{days}d", f"essentials_spend_sum_{days}d",
        f"rent_spend_sum_{days}d", f"neg_txn_count_{days}d", f"txn_count_{days}d",
        f"inflow_std_{days}d", f"inflow_mean_{days}d", f"bal_std_{days}d", f"bal_mean_{days}d",
    ]


def trailing_features(daily: DataFrame, ranges: tuple[int, ...] = (14, 30)) -> DataFrame:
    """Features per (user, day) over the day and the ``d - 1`` days before it."""
    user = Window.partitionBy("user_id")
    by_day = user.orderBy("__day")
    daily = daily.withColumns({
        "__day": F.unix_date(F.col("posted_date_utc").cast("date")),
        **{k: c for m in _MOMENTS for k, c in _centred(m, user).items()},
    })
    features = {}
    for d in ranges:
        frame = by_day.rangeBetween(-(d - 1), 0)
        total = {c: F.sum(c).over(frame) for c in _SUMS}
        features |= dict(zip(trailing_names(d), [
            total["inflow"], total["spend"], total["essentials"], total["rent"],
            total["neg_count"], total["n"],
            _std("inflow", frame), total["inflow"] / F.lit(float(d)),
            _std("bal", frame), total["nz_bal"] / F.nullif(total["nz_bal_n"], F.lit(0)),
        ]))
    last_payroll = F.max("payroll_at").over(by_day.rangeBetween(Window.unboundedPreceding, 0))
    features["days_since_last_payroll"] = F.coalesce(
        F.datediff("posted_date_utc", last_payroll), F.lit(1000)
    )
    return daily.select(
        "user_id", "posted_date_utc", *[c.alias(n) for n, c in features.items()]
    )
