"""Experiment assignments, arm means and balance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.functions import chi2_sf_even, concat_skip_null, flag, round_half_away
from lendlens.schemas import PRICE_TEST, TIP_ARMS, TIP_TEST

UNASSIGNED = "not_assigned"
MDES = [0.10, 0.15, 0.20]
WEEKDAYS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


def user_assignments(assignments: DataFrame) -> DataFrame:
    """One row per user: its arm in either test (the last by name if there are two)."""
    def arm(test: str) -> Column:
        return F.max(F.when(F.col("experiment_name") == test, F.col("variant")))

    price, tip = F.col("price_variant"), F.col("tip_variant")
    return assignments.groupBy("user_id").agg(
        arm(PRICE_TEST).alias("price_variant"),
        arm(TIP_TEST).alias("tip_variant"),
        F.countDistinct("experiment_name").alias("num_experiments"),
    ).withColumns({
        "is_overlapping_user": flag(F.col("num_experiments") > 1),
        "price_test_group": F.coalesce(price, F.lit(UNASSIGNED)),
        "tip_test_group": F.coalesce(tip, F.lit(UNASSIGNED)),
        "combined_variant": concat_skip_null(
            F.coalesce(price, F.lit("none")), F.lit("_"), F.coalesce(tip, F.lit("none"))
        ),
    })


def loans_with_experiments(loans: DataFrame, assigned: DataFrame, users: DataFrame) -> DataFrame:
    """Loans of assigned users with arms and user attributes, the risk decile if the users have it."""
    decile = ["risk_score_decile"] if "risk_score_decile" in users.columns else []
    return (
        loans.select("loan_id", "user_id", "amount", "revenue", "tip_amount", "pnl", "is_default",
                     "is_repaid", "is_disbursed", "disbursed_at_utc")
        .join(assigned.select("user_id", "price_test_group", "tip_test_group", "combined_variant"),
              "user_id")
        .join(users.select("user_id", *decile, "province", "device_os",
                           "acquisition_channel"), "user_id")
        .select("loan_id", "user_id", "amount", "revenue", "tip_amount", "pnl", "is_default",
                "is_repaid", "is_disbursed", "disbursed_at_utc", "price_test_group",
                "tip_test_group", "combined_variant", *decile, "province",
                "device_os", "acquisition_channel")
    )


def _price_arm(loans: DataFrame, arm: str) -> DataFrame:
    return loans.where((F.col("is_disbursed") == 1) & (F.col("price_test_group") == arm))


def baseline_rpdl(loans: DataFrame, arm: str = "A") -> DataFrame:
    return _price_arm(loans, arm).agg(
        round_half_away(F.avg("revenue"), 2).alias("mean_rpdl"),
        F.count(F.lit(1)).alias("n_loans"),
    )


def _window_columns() -> list[Column]:
    start, end = F.min("disbursed_at_utc"), F.max("disbursed_at_utc")
    return [
        start.cast("date").alias("start_date"),
        end.cast("date").alias("end_date"),
        (F.datediff(end, start) + 1).alias("total_days"),
    ]


def window_length(loans: DataFrame, arm: str = "A") -> DataFrame:
    return _price_arm(loans, arm).agg(*_window_columns())


def power(loans: DataFrame, arm: str = "A", mean: float | None = None,
          per_day: float | None = None, z_alpha: float = 1.96, z_power: float = 0.84,
          mdes: list[float] | None = None) -> DataFrame:
    """Loans per arm and days needed to see a relative lift in revenue per loan.

    The baseline mean and the daily volume come from the disbursed loans of one
    price arm unless given; the deviation is taken to equal the mean.
    """
    observed = F.round(F.count(F.lit(1)) / _window_columns()[2])
    base = _price_arm(loans, arm).agg(
        (round_half_away(F.avg("revenue"), 2) if mean is None else F.lit(mean)).alias("mu"),
        (observed if per_day is None else F.lit(per_day)).alias("per_day"),
    )
    rows = base.withColumn("m", F.explode(F.array(*[F.lit(m) for m in mdes or MDES])))
    delta = F.col("m") * F.col("mu")
    z = F.pow(F.lit(z_alpha) + F.lit(z_power), F.lit(2.0))
    needed = F.ceil(F.lit(2.0) * z * F.col("mu") * F.col("mu") / (delta * delta)).cast("double")
    return rows.select(
        F.concat(F.round(F.col("m") * 100).cast("int").cast("string"), F.lit("%")).alias("mde"),
        round_half_away(F.col("mu") * F.col("m"), 2).alias("abs_delta_usd"),
        needed.alias("n_per_arm"),
        F.ceil(needed / F.col("per_day")).cast("double").alias("horizon_days"),
    )


def tip_loans(loans: DataFrame) -> DataFrame:
    return loans.where((F.col("is_disbursed") == 1) & F.col("tip_test_group").isin(TIP_ARMS))


def naive_means(loans: DataFrame) -> DataFrame:
    tipped = F.col("tip_amount") > 0
    return tip_loans(loans).groupBy("tip_test_group").agg(
        F.count(F.lit(1)).alias("loans"),
        F.avg(flag(tipped)).alias("tip_take_rate"),
        F.avg("tip_amount").alias("mean_tip_all"),
        F.avg(F.when(tipped, F.col("tip_amount"))).alias("mean_tip_given_tip"),
        F.avg("revenue").alias("rpdl"),
        F.avg("is_default").alias("default_rate"),
    )


def naive_effects(means: DataFrame, control: str = "control") -> DataFrame:
    """Each arm against control, which must occur. The whole-table frame holds one row per arm."""
    arms = Window.partitionBy()
    has_control = F.max((F.col("tip_test_group") == control).cast("int")).over(arms) == 1
    checked = F.when(has_control, F.col("tip_test_group")).otherwise(
        F.raise_error(F.lit(f"no loans of the control arm {control}"))
    )

    def of_control(c: str) -> Column:
        return F.max(F.when(F.col("tip_test_group") == control, F.col(c))).over(arms)

    def gap(c: str) -> Column:
        return F.col(c) - F.col(f"__{c}")

    measures = ["tip_take_rate", "mean_tip_given_tip", "rpdl", "default_rate"]
    return (
        means.withColumns({f"__{c}": of_control(c) for c in measures})
        .withColumn("tip_test_group", checked)
        .where(F.col("tip_test_group") != control)
        .select(
            F.col("tip_test_group").alias("tip_variant"),
            "loans",
            round_half_away(gap("tip_take_rate") * 100, 2).alias("take_rate_delta_pp"),
            round_half_away(gap("mean_tip_given_tip"), 2).alias("mean_tip_given_tip_delta"),
            round_half_away(gap("rpdl") * 100 / F.nullif(F.col("__rpdl"), F.lit(0.0)), 2)
            .alias("rpdl_lift_pct"),
            round_half_away(gap("rpdl"), 2).alias("rpdl_delta"),
            round_half_away(gap("default_rate") * 100, 3).alias("default_delta_pp"),
        )
    )


def arm_counts(assigned: DataFrame) -> DataFrame:
    """Distinct users per tip arm."""
    return assigned.where(F.col("tip_test_group").isin(TIP_ARMS)).groupBy(
        F.col("tip_test_group").alias("variant")
    ).agg(F.countDistinct("user_id").alias("n_users"))


def sample_ratio(assigned: DataFrame) -> DataFrame:
    """Arm counts with the chi-square test against an equal split; absent arms count 0."""
    counts = assigned.agg(*[
        F.countDistinct(F.when(F.col("tip_test_group") == a, F.col("user_id"))).alias(a)
        for a in TIP_ARMS
    ])
    total = sum((F.col(a) for a in TIP_ARMS[1:]), F.col(TIP_ARMS[0])).cast("double")
    expected = total / F.lit(float(len(TIP_ARMS)))
    chi2 = sum(
        (F.pow(F.col(a) - expected, F.lit(2.0)) for a in TIP_ARMS), F.lit(0.0)
    ) / F.nullif(expected, F.lit(0.0))
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("variant"), F.col(a).alias("n_users")) for a in TIP_ARMS
    ]))
    return counts.withColumn("total", total).withColumn("chi2", chi2).withColumn("r", rows).select(
        "r.variant", "r.n_users",
        (F.lit(100.0) * F.col("r.n_users") / F.nullif(F.col("total"), F.lit(0.0)))
        .alias("pct_users"),
        "chi2",
        chi2_sf_even(F.col("chi2"), F.lit(len(TIP_ARMS) - 1) / 2).alias("p_value"),
    )


def _tip_assignments(assignments: DataFrame) -> DataFrame:
    return assignments.where(
        (F.col("experiment_name") == TIP_TEST) & F.col("variant").isin(TIP_ARMS)
    )


def _with_all_rows(table: DataFrame, name: str, domain: list[str]) -> DataFrame:
    """One row per value of a fixed domain, zero-filled, in the order given."""
    rows = table.agg(F.collect_list(F.struct(name, *TIP_ARMS)).alias("rows"))
    found = F.filter("rows", lambda r: r[name] == F.col(name))
    return rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in domain]))).select(
        name, *[F.coalesce(F.get(found, F.lit(0))[a], F.lit(0)).alias(a) for a in TIP_ARMS]
    )


def cross_tab(
    assignments: DataFrame, bucket: Column, name: str, domain: list[str] | None = None
) -> DataFrame:
    """Distinct users per (bucket, tip arm) with row percent and a chi-square test.

    A given domain fixes the rows; empty ones take no part in the test. The frame
    over the whole table holds one row per bucket (weekday or month).
    """
    users = _tip_assignments(assignments).select(bucket.alias(name), "variant", "user_id")
    table = users.distinct().groupBy(name).agg(
        *[F.count(F.when(F.col("variant") == a, F.col("user_id"))).alias(a) for a in TIP_ARMS]
    )
    if domain:
        table = _with_all_rows(table, name, domain)
    every = Window.partitionBy()
    row = sum((F.col(a) for a in TIP_ARMS[1:]), F.col(TIP_ARMS[0])).cast("double")
    table = table.withColumn("__row", row).withColumns({
        "__all": F.sum("__row").over(every),
        "__rows": F.count_if(F.col("__row") > 0).over(every),
        **{f"__c_{a}": F.sum(a).over(every) for a in TIP_ARMS},
    })

    def share(a: str) -> Column:
        expected = F.col("__row") * F.col(f"__c_{a}") / F.nullif(F.col("__all"), F.lit(0.0))
        return F.coalesce(F.pow(F.col(a) - expected, F.lit(2.0)) / F.nullif(expected, F.lit(0.0)),
                          F.lit(0.0))

    chi2 = F.sum(sum((share(a) for a in TIP_ARMS[1:]), share(TIP_ARMS[0]))).over(every)
    return table.withColumn("chi2", chi2).select(
        name, *TIP_ARMS,
        *[(F.lit(100.0) * F.col(a) / F.nullif(F.col("__row"), F.lit(0.0))).alias(f"{a}_pct")
          for a in TIP_ARMS],
        "chi2",
        ((F.col("__rows") - 1) * (len(TIP_ARMS) - 1)).cast("int").alias("dof"),
        chi2_sf_even(F.col("chi2"), (F.col("__rows") - 1) * (len(TIP_ARMS) - 1) / 2)
        .alias("p_value"),
    )


def by_weekday(assignments: DataFrame) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("assigned_dow") + 1)
    return cross_tab(assignments, label, "weekday", [*WEEKDAYS[1:], WEEKDAYS[0]])


def by_month(assignments: DataFrame) -> DataFrame:
    return cross_tab(assignments, F.col("assigned_month").cast("date"), "assigned_month")


def temporal_balance(assignments: DataFrame) -> DataFrame:
    """The two chi-square tests of arm mix over weekdays and months."""
    def test(df: DataFrame, label: str) -> DataFrame:
        return df.agg(
            F.lit(label).alias("dimension"), F.max("chi2").alias("chi2"),
            F.max("dof").alias("dof"), F.max("p_value").alias("p_value"),
        )

    return test(by_weekday(assignments), "weekday").unionByName(
        test(by_month(assignments), "month")
    )


def collapse_rare(
    df: DataFrame, column: str, min_count: int = 20, label: str = "OTHER"
) -> DataFrame:
    """Replace values with fewer than ``min_count`` rows by one label.

    The counts hold one row per value; the planner decides by their size how to
    join the rare ones back, and a NULL stays a NULL.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    rare = counts.where(F.col("__n") < min_count).select(
        F.col(column).alias("__rare"), F.lit(True).alias("__is_rare")
    )
    return df.join(rare, F.col(column) == F.col("__rare"), "left").withColumn(
        column, F.when(F.col("__is_rare"), F.lit(label)).otherwise(F.col(column))
    ).drop("__rare", "__is_rare")


def stratified_effect(loans: DataFrame, outcome: str = "revenue") -> DataFrame:
    """Price effect within each tip arm, and the precision-weighted pooled effect."""
    y = F.col(outcome)
    both = loans.where(
        (F.col("is_disbursed") == 1) & F.col("price_test_group").isin("A", "B")
    )

    def arm(a: str, fn) -> Column:
        return fn(F.when(F.col("price_test_group") == a, y))

    strata = both.groupBy(F.col("tip_test_group").alias("stratum")).agg(
        (arm("B", F.avg) - arm("A", F.avg)).alias("effect"),
        (arm("A", F.var_samp) / F.nullif(arm("A", F.count), F.lit(0))
         + arm("B", F.var_samp) / F.nullif(arm("B", F.count), F.lit(0))).alias("variance"),
        F.count(F.lit(1)).alias("n"),
    )
    weight = F.lit(1.0) / F.nullif(F.col("variance"), F.lit(0.0))
    pooled = strata.where(F.col("effect").isNotNull() & (F.col("variance") > 0)).agg(
        F.lit("pooled").alias("stratum"),
        (F.sum(F.col("effect") * weight) / F.nullif(F.sum(weight), F.lit(0.0))).alias("effect"),
        (F.lit(1.0) / F.nullif(F.sum(weight), F.lit(0.0))).alias("variance"),
        F.sum("n").alias("n"),
    )
    return strata.unionByName(pooled).select(
        "stratum", "effect", F.sqrt("variance").alias("std_err"), "n"
    )
