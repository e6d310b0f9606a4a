"""Business metrics, one row each, and the scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.functions import percent, round_half_away


def _rows() -> Column:
    return F.count(F.lit(1))


def signup_to_request(users: DataFrame, loans: DataFrame) -> DataFrame:
    """Share of signups with a first request within 1 day, 7 days, 1 week.

    The week figure counts whole 7-day blocks, so it covers 13 days. A request
    dated before the signup counts as in time.
    """
    first = loans.groupBy("user_id").agg(F.min("requested_at_utc").alias("first_request_at"))
    timed = users.select("user_id", "signup_at_utc").join(first, "user_id", "left").select(
        F.datediff("first_request_at", "signup_at_utc").alias("days")
    )
    days = F.col("days")
    counts = timed.agg(
        _rows().alias("total_signups"),
        F.count_if(days <= 1).alias("d1_requests"),
        F.count_if(days <= 7).alias("d7_requests"),
        F.count_if(days < 14).alias("w1_requests"),
    )
    return counts.select(
        "*", *[percent(F.col(f"{k}_requests"), F.col("total_signups")).alias(f"{k}_rate_pct")
               for k in ("d1", "d7", "w1")],
    )


def bank_link_rate(users: DataFrame) -> DataFrame:
    counts = users.agg(
        _rows().alias("total_users"), F.sum("bank_linked_flag").alias("users_linked_bank")
    )
    return counts.select(
        "*", percent(F.col("users_linked_bank"), F.col("total_users")).alias("bank_link_rate_pct")
    )


def approval_disbursement(loans: DataFrame) -> DataFrame:
    counts = loans.agg(
        _rows().alias("total_loan_requests"),
        F.sum("is_approved").alias("approved_loans"),
        F.sum("is_disbursed").alias("disbursed_loans"),
    )
    total, ok, paid = (F.col(c) for c in counts.columns)
    return counts.select(
        "*",
        percent(ok, total).alias("approval_rate_pct"),
        percent(paid, total).alias("disbursement_rate_pct"),
        percent(paid, ok).alias("approval_to_disbursement_rate_pct"),
    )


def repayment_default(loans: DataFrame) -> DataFrame:
    counts = loans.where("is_disbursed = 1").agg(
        _rows().alias("total_disbursed_loans"),
        F.sum("is_repaid").alias("repaid_loans"),
        F.sum("is_default").alias("defaulted_loans"),
    )
    total = F.col("total_disbursed_loans")
    return counts.select(
        "*",
        percent(F.col("repaid_loans"), total).alias("repayment_rate_pct"),
        percent(F.col("defaulted_loans"), total).alias("default_rate_pct"),
    )


def take_rate(loans: DataFrame) -> DataFrame:
    """Averages over all requested loans, approved or not."""
    return loans.agg(
        _rows().alias("total_loans"),
        round_half_away(F.avg("amount"), 2).alias("avg_loan_amount"),
        round_half_away(F.avg("revenue"), 2).alias("avg_take"),
        round_half_away(F.avg("revenue_to_loan") * 100.0, 2).alias("avg_take_rate_pct"),
    )


def instant_adoption(loans: DataFrame) -> DataFrame:
    counts = loans.where("is_disbursed = 1").agg(
        _rows().alias("disbursed_loans"),
        F.count_if(F.col("instant_transfer_fee") > 0).alias("instant_transfer_users"),
    )
    return counts.select(
        "*", percent(F.col("instant_transfer_users"), F.col("disbursed_loans"))
        .alias("instant_adoption_rate_pct"),
    )


def revenue_per_loan(loans: DataFrame) -> DataFrame:
    return loans.where("is_disbursed = 1").agg(
        _rows().alias("disbursed_loans"),
        round_half_away(F.avg("revenue"), 2).alias("avg_revenue_per_loan"),
        round_half_away(F.sum("revenue"), 2).alias("total_revenue"),
        round_half_away(F.avg("fee"), 2).alias("avg_fee"),
        round_half_away(F.avg("tip_amount"), 2).alias("avg_tip"),
        round_half_away(F.avg("instant_transfer_fee"), 2).alias("avg_instant_fee"),
    )


def late_payment(loans: DataFrame) -> DataFrame:
    counts = loans.where("is_repaid = 1").agg(
        _rows().alias("repaid_loans"),
        F.count_if(F.col("late_days") > 7).alias("late_repaid_loans"),
        round_half_away(F.avg("late_days"), 1).alias("avg_late_days"),
    )
    return counts.select(
        "repaid_loans", "late_repaid_loans",
        percent(F.col("late_repaid_loans"), F.col("repaid_loans")).alias("late_payment_rate_pct"),
        "avg_late_days",
    )


def scorecard(users: DataFrame, loans: DataFrame) -> DataFrame:
    """Nine headline metrics with a status; the loan figures share one pass."""
    paid, settled = F.col("is_disbursed") == 1, F.col("is_repaid") == 1
    n_paid, n_settled = F.count_if(paid), F.count_if(settled)
    facts = loans.agg(
        percent(F.sum("is_approved"), _rows()).alias("approval"),
        percent(F.count_if(paid & settled), n_paid).alias("repaid"),
        percent(F.count_if(paid & (F.col("is_default") == 1)), n_paid).alias("default"),
        round_half_away(F.avg("amount"), 2).alias("amount"),
        round_half_away(F.avg(F.when(paid, F.col("revenue"))), 2).alias("revenue"),
        percent(F.count_if(paid & (F.col("instant_transfer_fee") > 0)), n_paid).alias("instant"),
        percent(F.count_if(settled & (F.col("late_days") > 7)), n_settled).alias("late"),
    )

    def graded(good: float, monitor: float):
        def grade(v: Column) -> Column:
            return (F.when(v >= good, "Good").when(v >= monitor, "Monitor")
                    .otherwise("Needs Attention"))
        return grade

    def baseline(_: Column) -> Column:
        return F.lit("Baseline")

    def rows(df: DataFrame, entries: list) -> DataFrame:
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(label).alias("metric"), F.col(c).alias("value"),
                     grade(F.col(c)).alias("status"))
            for label, c, grade in entries
        ])).alias("r")).select("r.*")

    return (
        rows(signup_to_request(users, loans),
             [("Activation (D7 signup-to-request)", "d7_rate_pct", graded(25, 15))])
        .unionByName(rows(bank_link_rate(users),
                          [("Bank Link Rate", "bank_link_rate_pct", graded(70, 60))]))
        .unionByName(rows(facts, [
            ("Approval Rate", "approval", graded(60, 50)),
            ("Repayment Rate", "repaid", graded(70, 60)),
            ("Default Rate", "default",
             lambda v: F.when(v < 30, "Monitor").otherwise("High")),
            ("Average Loan Amount", "amount", baseline),
            ("Revenue per Loan", "revenue", baseline),
            ("Instant Transfer Adoption", "instant",
             lambda v: F.when(v > 20, "Good").otherwise("Opportunity")),
            ("Late Payment Rate (NPS Proxy)", "late",
             lambda v: F.when(v < 5, "Excellent").otherwise("Monitor")),
        ]))
    )


def north_star(loans: DataFrame) -> DataFrame:
    """Repayment-adjusted loan volume over disbursed loans."""
    totals = loans.where("is_disbursed = 1").agg(
        F.sum("amount").alias("loan_volume"), F.sum("principal_repaid").alias("repaid_volume")
    )
    return totals.select(
        "*", (F.col("repaid_volume") / F.nullif(F.col("loan_volume"), F.lit(0.0)))
        .alias("repaid_share"),
    )
