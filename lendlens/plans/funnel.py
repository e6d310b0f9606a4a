"""Conversion funnel: user base, segment counts, conversion reports, what-if levers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendlens.functions import flag, ratio_or_zero, round_half_away

SEGMENT = ["province", "device_os", "acquisition_channel"]
SEGMENT_COHORT = [*SEGMENT, "signup_month", "signup_year"]
STEPS = ["open→link", "link→request", "request→approved", "approved→disbursed"]
STAGE_COUNTS = [
    "app_open_users", "bank_linked_users", "requested_users", "approved_users", "disbursed_users",
]
TARGET_CAP = 0.95


def first_app_open(sessions: DataFrame) -> DataFrame:
    opened = F.when(F.col("is_app_open") == 1, F.col("ts_utc"))
    return sessions.groupBy("user_id").agg(F.min(opened).alias("first_app_open_ts"))


def bank_link(users: DataFrame) -> DataFrame:
    """Bank link per user; user_id is the key of users, so a group is one row."""
    return users.groupBy("user_id").agg(
        F.max("bank_linked_flag").alias("bank_linked_flag"),
        F.min("bank_linked_at_utc").alias("bank_link_ts"),
    )


def loan_steps(loans: DataFrame) -> DataFrame:
    return loans.groupBy("user_id").agg(
        F.min("requested_at_utc").alias("first_request_ts"),
        F.min("approved_at_utc").alias("first_approved_ts"),
        F.min("disbursed_at_utc").alias("first_disbursed_ts"),
        F.max("is_approved").alias("any_approved"),
        F.max("is_disbursed").alias("any_disbursed"),
    )


def user_funnel_base(users: DataFrame, sessions: DataFrame, loans: DataFrame) -> DataFrame:
    """One row per user; both facts are reduced to one row per user before joining.

    Users are partitioned by their key anyway, so the bank link is taken as a
    window over it and not as a join of the users with themselves.
    """
    same_user = Window.partitionBy("user_id")
    joined = (
        users.select(
            "user_id", *SEGMENT_COHORT,
            F.max("bank_linked_flag").over(same_user).alias("bank_linked_flag"),
            F.min("bank_linked_at_utc").over(same_user).alias("bank_link_ts"),
        )
        .join(first_app_open(sessions), "user_id", "left")
        .join(loan_steps(loans), "user_id", "left")
    )

    def reached(ts: str, any_flag: str):
        return flag(F.col(ts).isNotNull() | (F.col(any_flag) == 1))

    return joined.select(
        "user_id", *SEGMENT_COHORT,
        "first_app_open_ts", "bank_link_ts", "first_request_ts", "first_approved_ts",
        "first_disbursed_ts",
        flag(F.col("first_app_open_ts").isNotNull()).alias("did_app_open"),
        F.coalesce("bank_linked_flag", F.lit(0)).alias("did_bank_link"),
        flag(F.col("first_request_ts").isNotNull()).alias("did_request"),
        reached("first_approved_ts", "any_approved").alias("did_approve"),
        reached("first_disbursed_ts", "any_disbursed").alias("did_disburse"),
    )


def funnel_by_segment(base: DataFrame) -> DataFrame:
    """Distinct users per stage and segment.

    Users are made distinct within the segment first, which keeps the base's
    partitioning on user_id; the six distinct counts are then plain sums.
    """
    stages = {
        "total_users": F.lit(1),
        "app_open_users": flag(F.col("first_app_open_ts").isNotNull()),
        "bank_linked_users": flag(F.col("did_bank_link") == 1),
        "requested_users": flag(F.col("first_request_ts").isNotNull()),
        "approved_users": flag(F.col("first_approved_ts").isNotNull()),
        "disbursed_users": flag(F.col("first_disbursed_ts").isNotNull()),
    }
    known = flag(F.col("user_id").isNotNull())
    people = base.groupBy(*SEGMENT_COHORT, "user_id").agg(
        *[F.max(known * c).alias(name) for name, c in stages.items()]
    )
    return people.groupBy(*SEGMENT_COHORT).agg(*[F.sum(n).alias(n) for n in stages])


def overall(segments: DataFrame) -> DataFrame:
    """Step conversion and drop-off, plus the open-to-disbursed row."""
    totals = segments.agg(*[F.sum(c).alias(c) for c in STAGE_COUNTS])
    pairs = [*zip(STEPS, STAGE_COUNTS, STAGE_COUNTS[1:]),
             ("open→disbursed (absolute)", STAGE_COUNTS[0], STAGE_COUNTS[-1])]
    rows = F.explode(F.array(*[
        F.struct(F.lit(s).alias("step"), F.col(a).alias("from_cnt"), F.col(b).alias("to_cnt"))
        for s, a, b in pairs
    ]))
    lost = F.col("from_cnt") - F.col("to_cnt")
    return totals.select(rows.alias("r")).select("r.*").select(
        "step", "from_cnt", "to_cnt",
        ratio_or_zero(F.col("to_cnt"), F.col("from_cnt")).alias("conversion_rate"),
        lost.alias("dropoff_count"),
        ratio_or_zero(lost, F.col("from_cnt")).alias("dropoff_rate"),
    )


def segment_rates(segments: DataFrame) -> DataFrame:
    """Stage counts n1..n5 and step rates clamped to [0, 1] per segment.

    greatest/least skip NULL, so a step with an empty denominator has rate 1.
    """
    totals = segments.groupBy(*SEGMENT).agg(
        *[F.sum(c).alias(f"n{i}") for i, c in enumerate(STAGE_COUNTS, 1)]
    )

    def rate(a: int, b: int):
        share = F.col(f"n{b}").cast("double") / F.nullif(F.col(f"n{a}"), F.lit(0))
        return F.greatest(F.lit(0.0), F.least(share, F.lit(1.0))).alias(f"r{a}{b}")

    return totals.select(*SEGMENT, *[f"n{i}" for i in range(1, 6)],
                         *[rate(i, i + 1) for i in range(1, 5)])


def _opportunities(segments: DataFrame) -> DataFrame:
    """Per segment and step: disbursals if that one step rose to its target rate.

    The target is the 75th percentile across segments, capped. The frame over all
    rows holds one row per segment, so it is bounded by the segment domain.
    """
    everything = Window.partitionBy()
    names = ["r12", "r23", "r34", "r45"]
    rated = segment_rates(segments).withColumns({
        f"t{r[1:]}": F.least(
            F.percentile(F.col(r), F.lit(0.75)).over(everything), F.lit(TARGET_CAP)
        )
        for r in names
    })
    lifted = []
    for i, step in enumerate(STEPS):
        value = F.col(f"n{i + 1}") * F.col(f"t{names[i][1:]}")
        for downstream in names[i + 1:]:
            value = value * F.col(downstream)
        lifted.append(F.struct(F.lit(step).alias("step"), value.alias("n5p")))
    return (
        rated.withColumn("o", F.explode(F.array(*lifted)))
        .select("o.step", *SEGMENT, "n1", "n5", "o.n5p")
        .withColumn("gain", F.greatest(F.lit(0.0), F.col("n5p") - F.col("n5")))
    )


def p75_levers(segments: DataFrame) -> DataFrame:
    """Additional disbursals per step, in total and per 1,000 opens."""
    per_step = _opportunities(segments).where(F.col("n1") > 0).groupBy("step").agg(
        F.sum("gain").alias("gain"), F.sum("n1").alias("opens")
    )
    return per_step.select(
        "step",
        round_half_away(F.col("gain"), 3).alias("incremental_disbursed_dataset"),
        round_half_away(F.col("gain") / F.nullif(F.col("opens"), F.lit(0)) * 1000.0, 3)
        .alias("incremental_per_1k_opens"),
    ).orderBy(F.desc("incremental_disbursed_dataset"), "step")


def top_friction(segments: DataFrame, k: int = 3) -> DataFrame:
    """The k (segment, step) pairs with the largest gain.

    Unlike the per-step report the per-1k figure is not clamped at zero, and
    segments without opens stay in.
    """
    per_1k = F.when(
        F.col("n1") > 0, (F.col("n5p") - F.col("n5")) / F.col("n1") * 1000.0
    ).otherwise(F.lit(0.0))
    top = _opportunities(segments).withColumn("per_1k", per_1k).orderBy(
        F.desc("gain"), "step", *SEGMENT
    ).limit(k)
    return top.select(
        "step", *SEGMENT,
        round_half_away(F.col("gain"), 3).alias("incremental_disbursed"),
        round_half_away(F.col("per_1k"), 3).alias("incremental_per_1k_opens"),
    )


def by_channel(segments: DataFrame) -> DataFrame:
    agg = segments.groupBy("acquisition_channel").agg(
        F.sum("requested_users").alias("requests"),
        F.sum("bank_linked_users").alias("bank_links"),
        F.sum("approved_users").alias("approvals"),
    )
    return agg.select(
        "acquisition_channel", "requests", "bank_links",
        ratio_or_zero(F.col("requests"), F.col("bank_links")).alias("r_link_to_request"),
        "approvals",
        ratio_or_zero(F.col("approvals"), F.col("requests")).alias("r_request_to_approved"),
    ).orderBy(F.desc("r_request_to_approved"), F.desc("r_link_to_request"))


def by_cohort(segments: DataFrame) -> DataFrame:
    names = dict(zip(["open_cnt", "link_cnt", "request_cnt", "approved_cnt", "disbursed_cnt"],
                     STAGE_COUNTS))
    agg = segments.groupBy("signup_year", "signup_month").agg(
        *[F.sum(c).alias(n) for n, c in names.items()]
    )
    rates = {
        "r_open_to_link": ("link_cnt", "open_cnt"),
        "r_link_to_request": ("request_cnt", "link_cnt"),
        "r_request_to_approved": ("approved_cnt", "request_cnt"),
        "r_approved_to_disbursed": ("disbursed_cnt", "approved_cnt"),
        "r_open_to_disbursed": ("disbursed_cnt", "open_cnt"),
    }
    period = F.concat_ws(
        "-", F.col("signup_year").cast("string"),
        F.lpad(F.col("signup_month").cast("string"), 2, "0"),
    )
    return agg.select(
        "signup_year", "signup_month", *names,
        *[ratio_or_zero(F.col(a), F.col(b)).alias(n) for n, (a, b) in rates.items()],
        period.alias("signup_period"),
    ).orderBy("signup_year", "signup_month")
