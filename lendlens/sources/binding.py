"""Binds the supplied star-schema tables to the five lending tables.

Integer arithmetic on ids only, so that any engine derives the same rows. Every
order becomes a loan, every event a session event and a transaction, every
customer a user; nothing is filtered away.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.schemas import PRICE_ARMS, PRICE_TEST, TIP_ARMS, TIP_TEST, struct_of

USER_CYCLE = 25        # position of a user in a 25-cycle decides how far it goes
LINKED_BELOW = 18      # positions 0..17 link a bank account
REQUEST_BELOW = 15     # 0..14 request loans
APPROVED_BELOW = 12    # 0..11 get approvals
DISBURSED_BELOW = 11   # 0..10 get the money


# columns in use; stating them saves a footer-reading job per table and query
SOURCE_SCHEMAS = {
    "region": struct_of("r_regionkey int, r_name string"),
    "nation": struct_of("n_nationkey int, n_regionkey int"),
    "customer": struct_of(
        "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "orders": struct_of(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"
    ),
    "events": struct_of(
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
        " props string"
    ),
    "lineitem": struct_of(
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"
    ),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _plus(ts, days=None, hours=None):
    out = ts
    if days is not None:
        out = out + F.make_dt_interval(days=days.cast("int"))
    if hours is not None:
        out = out + F.make_dt_interval(hours=hours.cast("int"))
    return out


def _pick(values: list, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _price_arm(user):
    return _pick(PRICE_ARMS, F.floor(user / 10) % 2)


def _tip_arm(user):
    return _pick(TIP_ARMS, (F.floor(user / 7) + F.floor(user / 10)) % 3)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region")
    joined = (
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    k = F.col("c_custkey")
    signup = _plus(_ntz("2023-12-01 00:00:00"), days=k % 75)
    score = (F.lit(9998.0) - F.col("c_acctbal")) / F.lit(11000.0)
    return joined.select(
        k.alias("user_id"),
        signup.alias("signup_at"),
        F.col("r_name").alias("province"),
        F.when(k % 2 == 0, "ios").otherwise("android").alias("device_os"),
        F.lower("c_mktsegment").alias("acquisition_channel"),
        F.when(k % USER_CYCLE < LINKED_BELOW, _plus(signup, hours=k % 97)).alias("bank_linked_at"),
        _pick(["weekly", "biweekly", "semimonthly", "monthly", "irregular"], k % 5)
        .alias("payroll_frequency"),
        score.alias("baseline_risk_score"),
        F.when(score < 0.15, "740+").when(score < 0.25, "680-739").when(score < 0.40, "640-679")
        .when(score < 0.60, "580-639").when(score < 0.80, "500-579").otherwise("<500")
        .alias("fico_band"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    name = (
        F.when(F.col("event_type") == "view", "app_open")
        .when(F.col("event_type") == "click", "link_bank_success")
        .when(F.col("event_type") == "signup", "start_advance_request")
        .when(F.col("event_type") == "purchase", "submit_advance_request")
        .otherwise("approved")
    )
    from_events = e.select(
        F.col("event_id").cast("string").alias("event_id"),
        "user_id",
        "ts",
        name.alias("event_name"),
        F.col("props").alias("properties_json"),
    )
    # every user enters the funnel by opening the app at signup
    k = F.col("c_custkey")
    opens = read(spark, sf_dir, "customer").select(
        F.concat(F.lit("o-"), k.cast("string")).alias("event_id"),
        k.alias("user_id"),
        _plus(_ntz("2023-12-01 00:00:00"), days=k % 75).alias("ts"),
        F.lit("app_open").alias("event_name"),
        F.lit("{}").alias("properties_json"),
    )
    both = from_events.unionByName(opens)
    return both.select(
        "event_id",
        "user_id",
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string"))
        .alias("session_id"),
        "ts",
        "event_name",
        F.when(F.col("event_name").contains("bank"), "onboarding")
        .when(F.col("event_name").contains("request"), "loan")
        .otherwise("home").alias("screen"),
        "properties_json",
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    inflow = kind == "signup"
    return e.select(
        F.concat(F.lit("t-"), F.col("event_id").cast("string")).alias("txn_id"),
        "user_id",
        F.col("ts").cast("date").alias("posted_date"),
        F.when(inflow, F.col("value")).otherwise(-F.col("value")).alias("amount"),
        F.when(inflow, "inflow").otherwise("outflow").alias("direction"),
        F.when(inflow, "6011").otherwise("0000").alias("mcc"),
        F.when(inflow, "payroll").when(kind == "view", "groceries").when(kind == "click", "dining")
        .when(kind == "error", "rent").otherwise("other").alias("category"),
        ((F.col("event_id") * 7919 % 100003) / F.lit(100.0) - F.lit(200.0)).alias("balance_after"),
        F.when(inflow, 1).otherwise(0).alias("is_payroll"),
    )


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pos = F.col("o_custkey") % USER_CYCLE
    # fold every borrower onto the requesting positions of its own cycle
    base = o.select(
        k.alias("k"),
        (F.col("o_custkey") - pos + pos % REQUEST_BELOW).alias("user_id"),
        (F.lit(40.0) + F.col("o_totalprice") / F.lit(2000.0)).alias("amount"),
        F.col("o_orderstatus").alias("s"),
        _plus(_ntz("2024-01-01 00:00:00"), days=k % 45, hours=k % 23).alias("requested_at"),
    )
    k, user_pos = F.col("k"), F.col("user_id") % USER_CYCLE
    base = base.withColumn(
        "status",
        F.when((F.col("s") == "O") | (user_pos >= APPROVED_BELOW), "requested")
        .when(user_pos >= DISBURSED_BELOW, "approved")
        .when(F.col("s") == "F", "repaid").otherwise("default"),
    )
    status = F.col("status")
    base = base.withColumn(
        "approved_at", F.when(status != "requested", _plus(F.col("requested_at"), hours=k % 37))
    )
    base = base.withColumn(
        "disbursed_at",
        F.when(status.isin("repaid", "default"), _plus(F.col("approved_at"), hours=k % 11)),
    )
    base = base.withColumn(
        "late_days",
        F.when(status == "repaid", k % 9).when(status == "default", 20 + k % 7)
        .otherwise(0).cast("int"),
    )
    price, amount = _price_arm(F.col("user_id")), F.col("amount")
    return base.select(
        F.concat(F.lit("L"), k.cast("string")).alias("loan_id"),
        "user_id",
        "requested_at",
        "approved_at",
        "disbursed_at",
        F.date_add(F.col("disbursed_at").cast("date"), 14).alias("due_date"),
        F.when(status == "repaid", _plus(F.col("disbursed_at"), days=14 + F.col("late_days")))
        .alias("repaid_at"),
        "amount",
        F.when(price == "B", amount / F.lit(100.0)).otherwise(0.0).alias("fee"),
        F.when(status != "requested",
               _pick([0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 5.0], k % 10))
        .otherwise(0.0).alias("tip_amount"),
        F.when(price == "B", _pick([0.0, 0.0, 1.99, 2.99], k % 4)).otherwise(0.0)
        .alias("instant_transfer_fee"),
        "status",
        "late_days",
        F.when((status == "default") & (k % 2 == 0), 1).otherwise(0).alias("chargeoff_flag"),
        F.when(k % 3 == 0, 1).otherwise(0).alias("autopay_enrolled"),
        F.when(status == "repaid", amount).when(status == "default", amount * F.lit(0.25))
        .otherwise(0.0).alias("principal_repaid"),
        F.when(status == "default", amount * F.lit(0.75)).otherwise(0.0).alias("writeoff_amount"),
        price.alias("price_variant"),
        _tip_arm(F.col("user_id")).alias("tip_variant"),
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    digit = k % 10  # 0..2 price test only, 3..5 both, 6..8 tip test only, 9 neither
    rows = F.array_compact(F.array(
        F.when(digit <= 5, F.struct(
            F.concat(F.lit("P"), k.cast("string")).alias("assignment_id"),
            F.lit(PRICE_TEST).alias("experiment_name"),
            _price_arm(k).alias("variant"))),
        F.when((digit >= 3) & (digit <= 8), F.struct(
            F.concat(F.lit("T"), k.cast("string")).alias("assignment_id"),
            F.lit(TIP_TEST).alias("experiment_name"),
            _tip_arm(k).alias("variant"))),
    ))
    return (
        read(spark, sf_dir, "customer")
        .select(k.alias("user_id"),
                _plus(_ntz("2023-12-01 00:00:00"), days=k % 75).alias("assigned_at"),
                F.explode(rows).alias("a"))
        .select("a.assignment_id", "user_id", "a.experiment_name", "a.variant", "assigned_at")
    )


_BINDERS = {
    "dim_users": users,
    "fct_sessions": sessions,
    "fct_transactions": transactions,
    "fct_loans": loans,
    "ab_assignments": assignments,
}


class BoundTables(Mapping):
    """The five base tables, each bound when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._sf_dir = spark, sf_dir
        self._bound: dict[str, DataFrame] = {}

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._bound:
            self._bound[table] = _BINDERS[table](self._spark, self._sf_dir)
        return self._bound[table]

    def __iter__(self) -> Iterator[str]:
        return iter(_BINDERS)

    def __len__(self) -> int:
        return len(_BINDERS)


def bind(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    return BoundTables(spark, sf_dir)
