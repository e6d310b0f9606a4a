"""Data-quality suite.

All conditional counts of a table are taken in one aggregate over it and turned
into rows afterwards; the reports are group-bys over those few rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.functions import percent
from lendlens.schemas import TABLES

# fixed values
KNOWN_VARIANTS = [
    "control", "treatment", "variant_a", "variant_b", "low", "high", "enabled", "disabled",
]
EXTREME_AMOUNT = 10000
KEY_COLUMNS = {
    "v_dim_users_clean": ["user_id"],
    "v_fct_transactions_clean": ["txn_id", "user_id"],
    "v_fct_loans_clean": ["loan_id", "user_id"],
    "v_fct_sessions_clean": ["event_id", "user_id"],
    "v_ab_assignments_clean": ["assignment_id", "user_id"],
}
CLEAN_OF = {
    "dim_users": "v_dim_users_clean",
    "fct_transactions": "v_fct_transactions_clean",
    "fct_loans": "v_fct_loans_clean",
    "fct_sessions": "v_fct_sessions_clean",
    "ab_assignments": "v_ab_assignments_clean",
}
VIEW_KEYS = {
    "v_dim_users_clean": "user_id",
    "v_fct_transactions_clean": "txn_id",
    "v_fct_loans_clean": "loan_id",
    "v_ab_assignments_clean": "assignment_id",
    "v_fct_sessions_clean": "event_id",
    "v_user_funnel_base": "user_id",
    "v_funnel_by_segment": None,
    "v_user_experiment_assignments": "user_id",
    "v_loans_with_experiments": "loan_id",
    "v_fct_transactions_for_risk": "txn_id",
    "v_user_prior_loan_perf": "loan_id",
    "v_risk_model_base": "loan_id",
}


# categories that reach the summary, with their labels
SUMMARY_LABELS = {
    "row_count_reconciliation": "Row Count Reconciliation",
    "unique_key_reconciliation": "Unique Key Reconciliation",
    "null_key_checks": "Null Key Checks",
    "referential_integrity": "Referential Integrity",
    "business_rules": "Business Rules",
}


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _status(violations: Column, otherwise: str = "FAIL") -> Column:
    return F.when(violations == 0, F.lit("PASS")).otherwise(F.lit(otherwise))


def _unpivot(facts: DataFrame, rows: list[list[Column]]) -> DataFrame:
    """One output row per entry of a one-row frame of facts."""
    return facts.select(F.explode(F.array(*[F.struct(*r) for r in rows])).alias("r")).select("r.*")


@dataclass(frozen=True)
class Rule:
    """A row condition that must not hold, and the status if it does."""

    name: str
    violated: Column
    status: str = "FAIL"
    tolerated: float | None = None  # share of rows below which it still passes

    def verdict(self, violations: Column, total: Column) -> Column:
        if self.tolerated is None:
            return _status(violations, self.status)
        return F.when(violations < total * F.lit(self.tolerated), F.lit("PASS")).otherwise(
            F.lit(self.status)
        )


def _counted(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """All violation counts of a table in one aggregate."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(r.violated).alias(f"v{i}") for i, r in enumerate(rules)],
    )


def _violations(df: DataFrame, rules: list[Rule], name: str, check: str) -> DataFrame:
    return _unpivot(_counted(df, rules), [
        [F.lit(r.name).alias(name), F.col(f"v{i}").alias("violation_count"),
         r.verdict(F.col(f"v{i}"), F.col("total")).alias(check)]
        for i, r in enumerate(rules)
    ])


def key_counts(tables: dict[str, DataFrame], keys: dict[str, str | None], label: str) -> DataFrame:
    """Rows and distinct keys per table; 0 keys where a table has none."""
    return union_all([
        df.agg(
            F.lit(name).alias(label),
            F.count(F.lit(1)).alias("row_count"),
            (F.countDistinct(keys[name]) if keys[name] else F.lit(0).cast("long"))
            .alias("unique_keys"),
        )
        for name, df in tables.items()
    ])


def row_counts(base: dict[str, DataFrame]) -> DataFrame:
    return key_counts(base, {t: pk for t, (_, _, pk) in TABLES.items()}, "table_name")


def view_counts(views: dict[str, DataFrame]) -> DataFrame:
    return key_counts(views, VIEW_KEYS, "view_name")


def reconciliation(base: dict[str, DataFrame], views: dict[str, DataFrame]) -> DataFrame:
    """Base tables against their clean views, matched by table name."""
    clean = {t: views[v] for t, v in CLEAN_OF.items() if v in views}
    left = row_counts(base).select(
        F.col("table_name").alias("b"), F.col("row_count").alias("base_count"),
        F.col("unique_keys").alias("base_unique_keys"),
    )
    right = key_counts(clean, {t: TABLES[t][2] for t in clean}, "table_name").select(
        F.col("table_name").alias("v"), F.col("row_count").alias("view_count"),
        F.col("unique_keys").alias("view_unique_keys"),
    )

    def same(a: str, b: str) -> Column:
        return F.when(F.col(a) == F.col(b), "PASS").otherwise("FAIL")

    return left.join(right, F.col("b") == F.col("v"), "full").select(
        F.coalesce("b", "v").alias("table_name"),
        "base_count", "view_count", "base_unique_keys", "view_unique_keys",
        same("base_count", "view_count").alias("row_count_check"),
        same("base_unique_keys", "view_unique_keys").alias("unique_key_check"),
    )


def _null_rules(view: str) -> list[Rule]:
    return [Rule(c, F.col(c).isNull()) for c in KEY_COLUMNS[view]]


def null_keys(rows: dict[str, DataFrame]) -> DataFrame:
    def of(view: str) -> DataFrame:
        rules = _null_rules(view)
        return _unpivot(_counted(rows[view], rules), [
            [F.lit(view).alias("table_name"), F.lit(r.name).alias("key_column"),
             F.col("total").alias("total_rows"), F.col(f"v{i}").alias("null_count"),
             _status(F.col(f"v{i}")).alias("null_check")]
            for i, r in enumerate(rules)
        ])

    return union_all([of(v) for v in KEY_COLUMNS])


def orphan_rows(fact: DataFrame, users: DataFrame) -> DataFrame:
    """Number of fact rows whose user is unknown.

    The fact is reduced to one row per user before the anti join, so neither its
    size nor a dominant user reaches the join.
    """
    per_user = fact.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.join(users.select("user_id"), "user_id", "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_count")
    )


def referential_integrity(rows: dict[str, DataFrame]) -> DataFrame:
    facts = {
        "transactions_orphans": "v_fct_transactions_clean",
        "loans_orphans": "v_fct_loans_clean",
        "sessions_orphans": "v_fct_sessions_clean",
        "ab_assignments_orphans": "v_ab_assignments_clean",
    }
    users = rows["v_dim_users_clean"]
    return union_all([
        orphan_rows(rows[v], users).select(
            F.lit(check).alias("check_name"), "orphan_count",
            _status(F.col("orphan_count")).alias("integrity_check"),
        )
        for check, v in facts.items()
    ])


def transaction_checks() -> list[Rule]:
    direction, amount = F.col("direction"), F.col("amount")
    return [
        Rule("negative_amounts_in_inflows", (direction == "inflow") & (amount < 0)),
        Rule("positive_amounts_in_outflows", (direction == "outflow") & (amount > 0)),
        Rule("zero_amounts", amount == 0, "WARN"),
        Rule("extreme_amounts", F.abs(amount) > EXTREME_AMOUNT, "WARN", tolerated=0.01),
    ]


def _undated(state: str, ts: str) -> Column:
    return (F.col(state) == 1) & F.col(ts).isNull()


def loan_checks() -> list[Rule]:
    asked, ok, paid = (F.col(c) for c in
                       ("requested_at_utc", "approved_at_utc", "disbursed_at_utc"))
    return [
        Rule("negative_loan_amounts", F.col("amount") <= 0),
        Rule("approved_without_timestamp", _undated("is_approved", "approved_at_utc")),
        Rule("disbursed_without_timestamp", _undated("is_disbursed", "disbursed_at_utc")),
        Rule("repaid_without_timestamp", _undated("is_repaid", "repaid_at_utc")),
        Rule("invalid_loan_lifecycle_order", (ok < asked) | (paid < ok) | (paid < asked)),
    ]


def user_checks() -> list[Rule]:
    score = F.col("baseline_risk_score")
    return [
        Rule("bank_linked_before_signup", F.col("bank_linked_at_utc") < F.col("signup_at_utc")),
        Rule("invalid_risk_scores", (score < 0) | (score > 1)),
        Rule("negative_days_to_bank_connect", F.col("days_taken_signup_bank_connect") < 0),
    ]


def session_checks() -> list[Rule]:
    return [
        Rule("negative_session_duration", F.col("session_duration_sec") < 0),
        Rule("zero_events_per_session", F.col("events_per_session") <= 0, "WARN"),
    ]


def _as_of(as_of) -> Column:
    """The moment "now" stands for; fixed by the caller where results must repeat."""
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return F.lit(as_of).cast("timestamp_ntz")


def assignment_checks(as_of=None) -> list[Rule]:
    """The variant allow-list holds none of the running tests' arms but control."""
    return [
        Rule("future_assignment_dates", F.col("assigned_at_utc") > _as_of(as_of)),
        Rule("invalid_experiment_variants", ~F.col("variant_norm").isin(KNOWN_VARIANTS), "WARN"),
    ]


def business_checks(as_of=None) -> dict[str, list[Rule]]:
    now = _as_of(as_of)
    return {
        "v_fct_loans_clean": [
            Rule("loans_negative_amounts", F.col("amount") <= 0),
            Rule("loans_future_request_dates", F.col("requested_at_utc") > now),
            Rule("disbursed_loans_no_disbursement_date",
                 _undated("is_disbursed", "disbursed_at_utc")),
            Rule("repaid_loans_no_repayment_date", _undated("is_repaid", "repaid_at_utc")),
        ],
        "v_fct_transactions_clean": [Rule("transactions_zero_amounts", F.col("amount") == 0)],
        "v_dim_users_clean": [Rule("users_future_signup_dates", F.col("signup_at_utc") > now)],
        "v_ab_assignments_clean": [
            Rule("experiment_assignments_future_dates", F.col("assigned_at_utc") > now),
        ],
    }


def validations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return _violations(df, rules, "check_name", "validation_check")


def business_rules(rows: dict[str, DataFrame], as_of=None) -> DataFrame:
    return union_all([
        _violations(rows[view], rules, "rule_name", "rule_check")
        for view, rules in business_checks(as_of).items()
    ])


def distribution(users: DataFrame) -> DataFrame:
    """Users per province with their share; the total is taken over the grouped rows."""
    counts = users.groupBy("province").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.select(
        F.lit("user_province_distribution").alias("check_name"), "province", "count",
        percent(F.col("count"), total).alias("percentage"),
    ).orderBy(F.desc("count"), "province")


def _labelled(df: DataFrame, label: str, conditions: dict[str, Column]) -> DataFrame:
    names = {f"c{i}": text for i, text in enumerate(conditions)}
    facts = df.agg(*[F.count_if(conditions[text]).alias(c) for c, text in names.items()])
    return _unpivot(facts, [
        [F.lit(text).alias(label), F.col(c).alias("count")] for c, text in names.items()
    ])


def risk_coverage(risk_base: DataFrame) -> DataFrame:
    return _labelled(risk_base, "metric", {
        "Total approved loans": F.lit(True),
        "Loans with transaction data": F.col("txn_info_found") == 1,
        "Loans with prior loan history": F.col("prior_loan_flag") == 1,
        "Default loans": F.col("is_default") == 1,
        "Disbursed loans": F.col("disbursed_at_utc").isNotNull(),
    })


def funnel_completeness(base: DataFrame) -> DataFrame:
    return _labelled(base, "stage", {
        "Users with app open events": F.col("first_app_open_ts").isNotNull(),
        "Users who linked bank": F.col("did_bank_link") == 1,
        "Users who requested loans": F.col("first_request_ts").isNotNull(),
        "Users who got approved": F.col("first_approved_ts").isNotNull(),
    })


def _tidy_rules(df: DataFrame, by_category: dict[str, list[Rule]]) -> DataFrame:
    """Checks of several categories on one table, from one aggregate over it."""
    flat = [(c, r) for c, rules in by_category.items() for r in rules]
    return _unpivot(_counted(df, [r for _, r in flat]), [
        [F.lit(c).alias("category"), F.lit(r.name).alias("check_name"),
         F.col(f"v{i}").cast("double").alias("measured"),
         r.verdict(F.col(f"v{i}"), F.col("total")).alias("status")]
        for i, (c, r) in enumerate(flat)
    ])


def all_checks(base: dict[str, DataFrame], views: dict[str, DataFrame],
               rows: dict[str, DataFrame], as_of=None) -> DataFrame:
    """Every check as (category, check_name, measured, status); status NULL if informative.

    ``views`` are the clean views, ``rows`` the same tables with row-level columns
    only. Null, validation and business checks of a table share one pass.
    """
    rec = reconciliation(base, views)

    def tidy(df: DataFrame, category: str, name: str, measured: str, status: str | None):
        return df.select(
            F.lit(category).alias("category"), F.col(name).alias("check_name"),
            F.col(measured).cast("double").alias("measured"),
            (F.col(status) if status else F.lit(None).cast("string")).alias("status"),
        )

    rules = {
        "v_fct_transactions_clean": {"transaction_validations": transaction_checks()},
        "v_fct_loans_clean": {"loan_validations": loan_checks()},
        "v_dim_users_clean": {"user_validations": user_checks()},
        "v_ab_assignments_clean": {"ab_test_validations": assignment_checks(as_of)},
        "v_fct_sessions_clean": {},
    }
    for view, checks in rules.items():
        checks["null_key_checks"] = [
            Rule(f"{view}.{r.name}", r.violated) for r in _null_rules(view)
        ]
        checks["business_rules"] = business_checks(as_of).get(view, [])
    return union_all([
        tidy(rec, "row_count_reconciliation", "table_name", "view_count", "row_count_check"),
        tidy(rec, "unique_key_reconciliation", "table_name", "view_unique_keys",
             "unique_key_check"),
        tidy(referential_integrity(rows), "referential_integrity", "check_name", "orphan_count",
             "integrity_check"),
        *[_tidy_rules(rows[view], checks) for view, checks in rules.items()],
        _tidy_rules(views["v_fct_sessions_clean"], {"session_validations": session_checks()}),
        tidy(risk_coverage(views["v_risk_model_base"]), "risk_model_coverage", "metric", "count",
             None),
        tidy(funnel_completeness(views["v_user_funnel_base"]), "funnel_completeness", "stage",
             "count", None),
        tidy(distribution(rows["v_dim_users_clean"]), "distribution_checks", "province",
             "percentage", None),
    ])


def summary(checks: DataFrame) -> DataFrame:
    """Checks per category and status, over the five categories of the summary view."""
    label = F.lit(None).cast("string")
    for category, shown in SUMMARY_LABELS.items():
        label = F.when(F.col("category") == category, shown).otherwise(label)
    labelled = checks.select(label.alias("check_category"), "status").where("check_category is not null")
    return labelled.groupBy("check_category", "status").agg(
        F.count(F.lit(1)).alias("check_count")
    ).withColumn(
        "status_icon",
        F.when(F.col("status") == "PASS", "✓").when(F.col("status") == "FAIL", "✗").otherwise("?"),
    ).orderBy("check_category", "status")


def dashboard(checks: DataFrame, risk_model_base: DataFrame) -> DataFrame:
    """Views counted, risk coverage, failed and passed checks."""
    risk = risk_model_base.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("txn_info_found") == 1).alias("found")
    )
    in_summary = checks.where(F.col("category").isin(list(SUMMARY_LABELS)))
    counted = in_summary.agg(*[
        F.coalesce(F.count_if(F.col("status") == s), F.lit(0)).alias(s) for s in ("FAIL", "PASS")
    ])
    counted = counted.select(F.explode(F.array(*[
        F.struct(F.lit("DATA QUALITY").alias("section"), F.lit(f"{name} Checks").alias("metric"),
                 F.col(s).cast("double").alias("value"))
        for s, name in (("FAIL", "Failed"), ("PASS", "Passed"))
    ])).alias("r")).select("r.*")
    covered = risk.select(F.explode(F.array(
        F.struct(F.lit("CANONICAL VIEWS").alias("section"), F.lit("Total Views Created").alias("metric"),
                 F.lit(len(VIEW_KEYS)).cast("double").alias("value")),
        F.struct(F.lit("DATA COVERAGE").alias("section"), F.lit("Risk Model Coverage %").alias("metric"),
                 percent(F.col("found"), F.col("n"), 1).cast("double").alias("value")),
    )).alias("r")).select("r.*")
    return covered.unionByName(counted).orderBy("section", "metric")


def report(checks: DataFrame) -> DataFrame:
    """Per category: checks in total, failed, warned, passed.

    Reconciliation counts by its key status, as its last column; the row-count
    status is a category of its own here.
    """
    def having(s: str) -> Column:
        return F.count_if(F.col("status") == s)

    return checks.groupBy("category").agg(
        F.count(F.lit(1)).alias("total_checks"),
        having("FAIL").alias("failed_checks"),
        having("WARN").alias("warned_checks"),
        having("PASS").alias("passed_checks"),
    )


def failed(checks: DataFrame) -> DataFrame:
    return checks.where(F.col("status") == "FAIL")


def overall_status(checks: DataFrame) -> DataFrame:
    """Overall result: by the summary's rows, and strictly by every check.

    The published status counts FAIL rows of the summary (category and status
    groups), which leaves out the validation categories; the strict one counts
    failed checks.
    """
    groups = checks.groupBy("category", "status").agg(F.count(F.lit(1)).alias("n"))
    in_summary, bad = F.col("category").isin(list(SUMMARY_LABELS)), F.col("status") == "FAIL"
    totals = groups.agg(
        F.count_if(in_summary & bad).alias("total_failed_checks"),
        F.count_if(in_summary).alias("total_check_categories"),
        F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("strict_failed_checks"),
    )
    return totals.select(
        _status(F.col("total_failed_checks")).alias("overall_status"),
        "total_failed_checks", "total_check_categories",
        _status(F.col("strict_failed_checks")).alias("strict_status"), "strict_failed_checks",
    )


def exit_code(status: str | None) -> int:
    """0 passed, 1 failed checks, 2 the suite could not run."""
    return {"PASS": 0, "FAIL": 1}.get(status, 2)


def load_checks(base: dict[str, DataFrame]) -> DataFrame:
    """The four checks made right after loading."""
    users = base["dim_users"]

    def count(df: DataFrame, label: str, value: Column) -> DataFrame:
        return df.agg(value.alias("invalid_records")).select(
            F.lit(label).alias("check_name"), "invalid_records",
            _status(F.col("invalid_records")).alias("status"),
        )

    def missing(c: str) -> Column:
        return F.count_if(F.col(c).isNull())

    def orphans(table: str, label: str) -> DataFrame:
        return count(orphan_rows(base[table], users), label, F.max("orphan_count"))

    return union_all([
        count(users, "Users have valid signup dates", missing("signup_at")),
        count(base["fct_transactions"], "Transactions have valid amounts", missing("amount")),
        orphans("fct_loans", "Loans have valid user references"),
        orphans("fct_sessions", "Sessions have valid user references"),
    ])


def contracts(loans: DataFrame, users: DataFrame, amount_cap: float, max_hours: int = 24,
              max_null_share: float = 0.005) -> DataFrame:
    """Column contracts: amount cap, ordered timestamps, bounded gap, score range, null share."""
    amount, score = F.col("amount"), F.col("baseline_risk_score")
    asked, ok, paid = (F.col(c) for c in
                       ("requested_at_utc", "approved_at_utc", "disbursed_at_utc"))
    due = F.col("due_date_clean").cast("timestamp_ntz")
    gap = paid > ok + F.make_dt_interval(hours=F.lit(max_hours))
    on_loans = _violations(loans, [
        Rule("amount_within_cap", (amount <= 0) | (amount > amount_cap)),
        Rule("timestamps_in_order", (ok < asked) | (paid < ok) | (due <= paid)),
        Rule("disbursed_within_limit", gap),
    ], "contract", "status")
    on_users = _violations(users, [
        Rule("score_in_unit_range", (score < 0) | (score > 1)),
        Rule("score_null_share", score.isNull(), tolerated=max_null_share),
    ], "contract", "status")
    return on_loans.unionByName(on_users)


def dataset_summary(base: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per dataset, and the total."""
    rows = union_all([
        df.agg(F.lit(t).alias("dataset"), F.count(F.lit(1)).alias("rows"),
               F.lit(len(df.columns)).alias("columns"))
        for t, df in base.items()
    ])
    total = rows.agg(F.lit("TOTAL").alias("dataset"), F.sum("rows").alias("rows"),
                     F.lit(None).cast("int").alias("columns"))
    return rows.unionByName(total)


def table_row_counts(base: dict[str, DataFrame]) -> dict[str, int]:
    """Loaded rows per table, -1 for a table that cannot be read."""
    out = {}
    for table, df in base.items():
        try:
            out[table] = df.count()
        except Exception:  # the check reports unreadable tables instead of failing
            out[table] = -1
    return out
