"""Tables behind the dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendlens.functions import flag, ratio_or_zero

FILTERS = ["province", "device_os", "acquisition_channel", "signup_month"]
STAGES = {
    "Signups": None,
    "Bank Linked": "bank_linked_flag",
    "Loan Requested": "requested_loan",
    "Loan Approved": "approved_loan",
    "Loan Disbursed": "disbursed_loan",
    "Loan Repaid": "repaid_loan",
}


def user_funnel(users: DataFrame, loans: DataFrame) -> DataFrame:
    flags = {"approved_loan": "is_approved", "disbursed_loan": "is_disbursed",
             "repaid_loan": "is_repaid", "defaulted_loan": "is_default"}
    reached = loans.groupBy("user_id").agg(
        F.lit(1).alias("requested_loan"), *[F.max(c).alias(n) for n, c in flags.items()]
    )
    people = users.select(
        "user_id", "province", "device_os", "acquisition_channel", "signup_month",
        "signup_at_utc", "bank_linked_flag",
    )
    return people.join(reached, "user_id", "left").select(
        *people.columns,
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in ("requested_loan", *flags)],
    )


def experiment_loans(loans: DataFrame, assigned: DataFrame) -> DataFrame:
    return (
        loans.where(F.col("is_disbursed") == 1)
        .select("loan_id", "user_id", "amount", "tip_amount", "revenue", "is_disbursed", "status",
                flag(F.col("tip_amount") > 0).alias("tip_taken"),
                flag(F.col("instant_transfer_fee") > 0).alias("instant_transfer_used"))
        .join(assigned.select("user_id", "price_test_group", "tip_test_group"), "user_id")
    )


def apply_filters(df: DataFrame, **chosen) -> DataFrame:
    """Keep rows equal to every chosen value; None or 'All' leaves a column open."""
    unknown = set(chosen) - set(FILTERS)
    if unknown:
        raise ValueError(f"unknown filter: {sorted(unknown)}")
    active = {c: v for c, v in chosen.items() if v not in (None, "All")}
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), active.items(), df)


def filter_values(funnel: DataFrame) -> DataFrame:
    """Distinct values per filter column, from one pass over the users."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("filter"), F.col(c).cast("string").alias("value")) for c in FILTERS
    ]))
    return funnel.select(pairs.alias("p")).select("p.*").distinct().orderBy("filter", "value")


def filtered_experiments(experiments: DataFrame, funnel: DataFrame) -> DataFrame:
    return experiments.join(funnel.select("user_id"), "user_id", "left_semi")


def funnel_stages(funnel: DataFrame) -> DataFrame:
    totals = funnel.agg(*[
        (F.count(F.lit(1)) if c is None else F.coalesce(F.sum(c), F.lit(0))).alias(s)
        for s, c in STAGES.items()
    ])
    return totals.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("stage"), F.col(f"`{s}`").cast("long").alias("users"))
        for s in STAGES
    ])).alias("r")).select("r.*")


def kpis(funnel: DataFrame) -> DataFrame:
    t = funnel.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.sum("bank_linked_flag").alias("linked"),
        F.sum("requested_loan").alias("requested"),
        F.sum("approved_loan").alias("approved"),
    )
    return t.select(
        "total_users",
        (ratio_or_zero(F.col("linked"), F.col("total_users")) * 100).alias("bank_link_rate"),
        (ratio_or_zero(F.col("requested"), F.col("total_users")) * 100).alias("request_rate"),
        (ratio_or_zero(F.col("approved"), F.col("requested")) * 100).alias("approval_rate"),
    )


def experiment_kpis(experiments: DataFrame) -> DataFrame:
    return experiments.agg(
        F.count(F.lit(1)).alias("total_loans"),
        F.coalesce(F.avg("revenue"), F.lit(0.0)).alias("avg_revenue"),
        (ratio_or_zero(F.sum("tip_taken"), F.count(F.lit(1))) * 100).alias("tip_take_rate"),
        F.coalesce(F.avg("amount"), F.lit(0.0)).alias("avg_amount"),
    )


def tip_table(experiments: DataFrame) -> DataFrame:
    return experiments.groupBy(F.col("tip_test_group").alias("variant")).agg(
        F.count("loan_id").alias("total_loans"),
        F.sum("tip_taken").alias("tips_taken"),
        F.avg("tip_amount").alias("avg_tip_amount"),
        F.avg("revenue").alias("avg_revenue"),
        (F.sum("tip_taken") / F.nullif(F.count("loan_id"), F.lit(0)) * 100)
        .alias("tip_take_rate_pct"),
    )


def price_table(experiments: DataFrame) -> DataFrame:
    return experiments.groupBy(F.col("price_test_group").alias("variant")).agg(
        F.count("loan_id").alias("total_loans"),
        F.avg("revenue").alias("avg_revenue"),
        F.sum("revenue").alias("total_revenue"),
        F.avg("amount").alias("avg_loan_amount"),
    )


def experiment_matrix(experiments: DataFrame, price_arms: list[str]) -> DataFrame:
    """Mean revenue by tip arm (rows) and price arm (columns), take-rate, colour range.

    The frame over the whole table holds one row per tip arm.
    """
    cells = experiments.groupBy("tip_test_group", "price_test_group").agg(
        F.count("loan_id").alias("loans"), F.avg("revenue").alias("revenue"),
        (F.sum("tip_taken") / F.count(F.lit(1)) * 100).alias("take_rate"),
    )
    wide = cells.groupBy("tip_test_group").pivot("price_test_group", price_arms).agg(
        F.first("revenue").alias("revenue"), F.first("take_rate").alias("take_rate"),
        F.first("loans").alias("loans"),
    )
    every = Window.partitionBy()
    means = [F.col(f"`{a}_revenue`") for a in price_arms]
    low = F.min(F.least(*means)).over(every)
    high = F.max(F.greatest(*means)).over(every)
    return wide.withColumns({
        "min_revenue": low, "max_revenue": high, "mid_revenue": (low + high) / 2.0,
    })
