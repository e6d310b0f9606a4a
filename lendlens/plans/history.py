"""Loan history strictly before an approval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.functions import flag
from lendlens.operators.skew import sums_before

TOTALS = [
    "n_approved", "n_unapproved", "n_default", "n_repaid", "n_bad", "late_sum", "late_n",
    "amount_sum", "amount_n", "rtl_sum", "rtl_n", "tip_sum", "disbursed_n",
]


def with_history(loans: DataFrame) -> DataFrame:
    """Loans with totals over the user's earlier loans, 0 where never approved.

    An approved loan counts from its approval on, an unapproved one from its
    request. Every loan is one event that adds its own contribution and, if
    approved, reads the sum of those strictly before: one wide shuffle, no self join.
    """
    approved = F.col("is_approved") == 1
    disbursed = approved & (F.col("is_disbursed") == 1)
    rtl = F.when(F.col("amount") > 0, F.col("revenue") / F.col("amount"))

    def total(c):
        return F.coalesce(F.when(disbursed, c), F.lit(0))

    def count(c):
        return flag(disbursed & c.isNotNull())

    late, amount = F.col("late_days"), F.col("amount")
    events = loans.withColumns({
        "__t": F.when(approved, F.col("approved_at_utc")).otherwise(F.col("requested_at_utc")),
        "n_approved": flag(approved),
        "n_unapproved": flag(~approved),
        "n_default": flag(approved & (F.col("is_default") == 1)),
        "n_repaid": flag(disbursed & (F.col("is_repaid") == 1)),
        "n_bad": flag(disbursed & (F.col("is_default") == 1)),
        "late_sum": total(late), "late_n": count(late),
        "amount_sum": total(amount), "amount_n": count(amount),
        "rtl_sum": total(rtl), "rtl_n": count(rtl),
        "tip_sum": flag(disbursed & (F.col("tip_amount") > 0)),
        "disbursed_n": flag(disbursed),
    })
    summed = sums_before(events, "user_id", "__t", TOTALS)
    return summed.withColumns({
        c: F.when(approved, F.col(c)).otherwise(F.lit(0)) for c in TOTALS
    }).drop("__t")


def history_totals(loans: DataFrame) -> DataFrame:
    return with_history(loans).select("loan_id", *TOTALS)


def prior_columns(exact: bool = False) -> dict:
    """Published history features as expressions over the totals.

    The published counts come from joining both histories to a loan before
    counting, so each count is multiplied by the size of the other history
    (unless that is empty). That is the default; ``exact`` gives plain counts.
    """
    pa, pu = F.col("n_approved"), F.col("n_unapproved")
    one = F.lit(1).cast("long")
    counts = (pa, pu) if exact else (pa * F.greatest(pu, one), pu * F.greatest(pa, one))

    def mean(total: str, n: str):
        return F.col(total).cast("double") / F.nullif(F.col(n), F.lit(0))

    return {
        "prior_loan_flag": flag(pa > 0),
        "prior_loan_default_flag": flag(F.col("n_default") > 0),
        "prior_avg_days_late": mean("late_sum", "late_n"),
        "prior_avg_amount": mean("amount_sum", "amount_n"),
        "prior_avg_revenue_to_loan": mean("rtl_sum", "rtl_n"),
        "prior_tip_take_rate": mean("tip_sum", "disbursed_n"),
        "prior_approved_loans_count": counts[0],
        "prior_unapproved_loans_count": counts[1],
    }


def prior_loan_performance(loans: DataFrame, exact: bool = False) -> DataFrame:
    """One row per loan with the performance of earlier loans."""
    columns = prior_columns(exact)
    columns.pop("prior_loan_default_flag")
    return with_history(loans).select(
        "loan_id", *[e.alias(n) for n, e in columns.items()]
    )


def prior_default_flag(loans: DataFrame) -> DataFrame:
    """Approved loans with a flag for an earlier-approved loan that defaulted."""
    approved = with_history(loans).where(F.col("is_approved") == 1)
    return approved.select(
        "loan_id", prior_columns()["prior_loan_default_flag"].alias("prior_loan_default_flag")
    )
