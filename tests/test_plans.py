"""Hand-made rows for the traps the generated tables do not hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lendlens.plans import (
    clean, dashboard, experiments, funnel, history, metrics, quality, risk_base,
)
from lendlens.plans.catalog import LendingCatalog
from lendlens.schemas import TABLES
from lendlens.functions import chi2_sf_even, round_half_away

D = dt.datetime


def table(spark, name, rows):
    schema = TABLES[name][1]
    full = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(full, schema)


def loan(loan_id, user, asked, approved=None, disbursed=None, **more):
    return dict(loan_id=loan_id, user_id=user, requested_at=asked, approved_at=approved,
                disbursed_at=disbursed, **{"amount": 100.0, "status": "requested",
                                           "chargeoff_flag": 0, "late_days": 0, **more})


@pytest.fixture(scope="module")
def history_loans(spark):
    t = [D(2024, 1, d) for d in range(1, 20)]
    return clean.enrich_loans(table(spark, "fct_loans", [
        loan("a", 1, t[0], t[1], t[1], status="default", late_days=20, tip_amount=2.0, fee=1.0),
        loan("b", 1, t[2], t[3], t[3], status="repaid", late_days=4, amount=50.0),
        loan("c", 1, t[4]),                      # never approved
        loan("d", 1, t[5]),                      # never approved
        loan("e", 1, t[6], t[7], t[7], status="repaid"),
        loan("f", 1, t[6], t[7], t[7], status="repaid"),  # same instant as e
        loan("g", 2, t[0], t[1]),                # approved, not disbursed
        loan("h", None, t[0], t[5]),             # no user
        loan("i", 2, t[2], t[4], None),
    ]))


def test_history_counts_multiply_unless_exact(history_loans):
    got = {r["loan_id"]: r for r in history.prior_loan_performance(history_loans).collect()}
    exact = {r["loan_id"]: r for r in
             history.prior_loan_performance(history_loans, exact=True).collect()}
    assert len(got) == 9
    for k in ("e", "f"):  # two approved and two unapproved before either
        assert got[k]["prior_approved_loans_count"] == 4
        assert got[k]["prior_unapproved_loans_count"] == 4
        assert exact[k]["prior_approved_loans_count"] == 2
        assert exact[k]["prior_unapproved_loans_count"] == 2
        assert got[k]["prior_avg_days_late"] == 12.0
        assert got[k]["prior_avg_amount"] == 75.0
        assert got[k]["prior_tip_take_rate"] == 0.5
        assert got[k]["prior_avg_revenue_to_loan"] == pytest.approx(0.015)
    assert got["c"]["prior_approved_loans_count"] == 0 and got["c"]["prior_loan_flag"] == 0
    assert got["h"]["prior_approved_loans_count"] == 0
    assert got["i"]["prior_loan_flag"] == 1 and got["i"]["prior_avg_amount"] is None
    assert got["i"]["prior_approved_loans_count"] == 1


def test_prior_default_is_strict(history_loans):
    got = {r["loan_id"]: r["prior_loan_default_flag"]
           for r in history.prior_default_flag(history_loans).collect()}
    assert got == {"a": 0, "b": 1, "e": 1, "f": 1, "g": 0, "h": 0, "i": 0}


def test_first_loan_flags_all_ties(spark):
    t = D(2024, 1, 1)
    df = clean.clean_loans(table(spark, "fct_loans", [
        loan("a", 1, t), loan("b", 1, t), loan("c", 1, D(2024, 1, 2)), loan("n", None, t)]))
    assert {r["loan_id"]: r["is_first_loan"] for r in df.collect()} == {
        "a": 1, "b": 1, "c": 0, "n": 1}


def _segments(spark, rows):
    cols = [*funnel.SEGMENT, "signup_month", "signup_year", "total_users", *funnel.STAGE_COUNTS]
    return spark.createDataFrame(rows, ", ".join(
        f"{c} {'string' if c in funnel.SEGMENT else 'bigint'}" for c in cols))


def test_zero_denominators(spark):
    seg = _segments(spark, [("p", "ios", "x", 1, 2024, 5, 0, 0, 0, 0, 0),
                            ("q", "ios", "x", 1, 2024, 5, 4, 2, 2, 0, 0)])
    rates = {r["province"]: r for r in funnel.segment_rates(seg).collect()}
    assert [rates["p"][c] for c in ("r12", "r23", "r34", "r45")] == [1.0] * 4
    assert [rates["q"][c] for c in ("r12", "r23", "r34", "r45")] == [0.5, 1.0, 0.0, 1.0]
    assert funnel.p75_levers(seg).count() == 4
    top = funnel.top_friction(seg, 8).collect()
    assert len(top) == 8 and all(r["incremental_disbursed"] >= 0 for r in top)
    empty = funnel.overall(seg.where("false")).collect()
    assert all(r["conversion_rate"] == 0.0 for r in empty)


def test_metrics_of_nothing(spark):
    users = clean.enrich_users(table(spark, "dim_users", []))
    loans = clean.enrich_loans(table(spark, "fct_loans", []))
    assert metrics.bank_link_rate(users).first()["bank_link_rate_pct"] is None
    assert metrics.signup_to_request(users, loans).first()["d1_rate_pct"] is None
    assert metrics.late_payment(loans).first()["late_payment_rate_pct"] is None
    assert metrics.scorecard(users, loans).count() == 9


def test_a_week_is_thirteen_days(spark):
    users = clean.enrich_users(table(spark, "dim_users", [
        dict(user_id=i, signup_at=D(2024, 1, 1)) for i in range(4)]))
    loans = clean.enrich_loans(table(spark, "fct_loans", [
        loan("a", 0, D(2024, 1, 2, 23)), loan("b", 1, D(2024, 1, 14)),
        loan("c", 2, D(2024, 1, 15))]))
    row = metrics.signup_to_request(users, loans).first()
    assert (row["d1_requests"], row["d7_requests"], row["w1_requests"]) == (1, 1, 2)


def test_quality_rules_fire(spark):
    as_of = "2024-06-01 00:00:00"
    users = table(spark, "dim_users", [
        dict(user_id=1, signup_at=D(2024, 1, 5), bank_linked_at=D(2024, 1, 4), province="ON",
             baseline_risk_score=1.5),
        dict(user_id=2, signup_at=D(2025, 1, 1), province="ON"),
        dict(user_id=None, signup_at=None, province="BC")])
    loans = table(spark, "fct_loans", [
        loan("a", 1, D(2024, 1, 2), D(2024, 1, 1), amount=0.0),
        loan("b", 9, D(2024, 1, 2), status="repaid"),
        loan("b", 9, D(2025, 1, 2))])
    txns = table(spark, "fct_transactions", [
        dict(txn_id="x", user_id=1, amount=-1.0, direction="inflow", posted_date=dt.date(2024, 1, 1)),
        dict(txn_id="y", user_id=7, amount=0.0, direction="outflow", posted_date=dt.date(2024, 1, 1)),
        dict(txn_id=None, user_id=1, amount=20000.0, direction="outflow",
             posted_date=dt.date(2024, 1, 1))])
    base = {"dim_users": users, "fct_loans": loans, "fct_transactions": txns,
            "fct_sessions": table(spark, "fct_sessions", []),
            "ab_assignments": table(spark, "ab_assignments", [
                dict(assignment_id="1", user_id=1, experiment_name="e", variant="A",
                     assigned_at=D(2025, 1, 1))])}
    c = LendingCatalog(base)
    checks = quality.all_checks(base, c.check_views(), c.row_views(), as_of).collect()
    got = {(r["category"], r["check_name"]): (r["measured"], r["status"]) for r in checks}
    want = {
        ("transaction_validations", "negative_amounts_in_inflows"): (1, "FAIL"),
        ("transaction_validations", "positive_amounts_in_outflows"): (1, "FAIL"),
        ("transaction_validations", "zero_amounts"): (1, "WARN"),
        ("transaction_validations", "extreme_amounts"): (1, "WARN"),
        ("business_rules", "transactions_zero_amounts"): (1, "FAIL"),
        ("business_rules", "loans_future_request_dates"): (1, "FAIL"),
        ("business_rules", "users_future_signup_dates"): (1, "FAIL"),
        ("business_rules", "experiment_assignments_future_dates"): (1, "FAIL"),
        ("loan_validations", "negative_loan_amounts"): (1, "FAIL"),
        ("loan_validations", "repaid_without_timestamp"): (1, "FAIL"),
        ("loan_validations", "invalid_loan_lifecycle_order"): (1, "FAIL"),
        ("user_validations", "bank_linked_before_signup"): (1, "FAIL"),
        ("user_validations", "invalid_risk_scores"): (1, "FAIL"),
        ("user_validations", "negative_days_to_bank_connect"): (1, "FAIL"),
        ("ab_test_validations", "invalid_experiment_variants"): (1, "WARN"),
        ("referential_integrity", "transactions_orphans"): (1, "FAIL"),
        ("referential_integrity", "loans_orphans"): (2, "FAIL"),
        ("referential_integrity", "ab_assignments_orphans"): (0, "PASS"),
        ("null_key_checks", "v_dim_users_clean.user_id"): (1, "FAIL"),
        ("null_key_checks", "v_fct_transactions_clean.txn_id"): (1, "FAIL"),
    }
    for key, value in want.items():
        assert got[key] == value, key
    statuses = [r for r in checks if r["status"] is not None]
    assert len(statuses) == 5 + 5 + 9 + 4 + 4 + 5 + 3 + 2 + 2 + 7
    status = quality.overall_status(spark.createDataFrame(checks)).first()
    assert status["overall_status"] == "FAIL"
    assert status["strict_failed_checks"] == sum(r["status"] == "FAIL" for r in checks)
    assert [quality.exit_code(s) for s in ("PASS", "FAIL", None)] == [0, 1, 2]
    load = {r["check_name"]: r["invalid_records"] for r in quality.load_checks(base).collect()}
    assert list(load.values()) == [1, 0, 2, 0]


def test_pivot_keeps_the_last_variant_and_skips_nulls(spark):
    rows = [("PriceTest_2025Q2", "A"), ("PriceTest_2025Q2", "B"), ("TipPrompt_2025Q2", None)]
    df = table(spark, "ab_assignments", [
        dict(assignment_id=str(i), user_id=1, experiment_name=e, variant=v,
             assigned_at=D(2024, 1, 1)) for i, (e, v) in enumerate(rows)])
    row = experiments.user_assignments(df).first()
    assert (row["price_test_group"], row["tip_test_group"]) == ("B", "not_assigned")
    assert (row["combined_variant"], row["is_overlapping_user"]) == ("B_none", 1)
    names = {r["assignment_id"]: r["experiment_variant"]
             for r in clean.enrich_assignments(df).collect()}
    assert names["2"] == "TipPrompt_2025Q2:"


def test_sample_ratio_with_known_counts(spark):
    rows = [("control", 345), ("persuasive", 323), ("social_proof", 332)]
    df = spark.createDataFrame(
        [(i * 1000 + j, a) for i, (a, n) in enumerate(rows) for j in range(n)],
        "user_id bigint, tip_test_group string")
    row = experiments.sample_ratio(df).first()
    want = sum((n - 1000 / 3) ** 2 / (1000 / 3) for _, n in rows)
    assert row["chi2"] == pytest.approx(want)
    assert row["p_value"] == pytest.approx(2.718281828459045 ** (-want / 2))
    empty = experiments.sample_ratio(df.where("false")).collect()
    assert [r["n_users"] for r in empty] == [0, 0, 0]


def test_cross_tab_keeps_empty_weekdays(spark):
    arms = ["control", "persuasive", "social_proof"]
    days = [D(2024, 1, 1), D(2024, 1, 3)]  # a Monday and a Wednesday
    counts = {(0, 0): 5, (0, 1): 7, (0, 2): 6, (1, 0): 9, (1, 1): 4, (1, 2): 8}
    rows = [dict(assignment_id=f"{d}{a}{i}", user_id=d * 1000 + a * 100 + i,
                 experiment_name="TipPrompt_2025Q2", variant=arms[a], assigned_at=days[d])
            for (d, a), n in counts.items() for i in range(n)]
    df = clean.enrich_assignments(table(spark, "ab_assignments", rows))
    got = experiments.by_weekday(df).collect()
    assert [r["weekday"] for r in got] == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    assert [got[2][a] for a in arms] == [9, 4, 8] and got[1]["control"] == 0
    assert got[1]["control_pct"] is None and got[0]["dof"] == 2
    total, by_arm, by_day = 39, [14, 11, 14], [18, 21]
    chi2 = sum((n - by_day[d] * by_arm[a] / total) ** 2 / (by_day[d] * by_arm[a] / total)
               for (d, a), n in counts.items())
    assert got[0]["chi2"] == pytest.approx(chi2)
    assert got[0]["p_value"] == pytest.approx(2.718281828459045 ** (-chi2 / 2))
    assert experiments.by_month(df).count() == 1
    assert experiments.by_weekday(df.where("false")).first()["chi2"] == 0.0


def test_power_with_published_inputs(catalog):
    rows = experiments.power(catalog.loans_with_experiments, mean=0.32, per_day=13.0).collect()
    got = {r["mde"]: (r["n_per_arm"], r["horizon_days"]) for r in rows}
    assert got == {"10%": (1568, 121), "15%": (697, 54), "20%": (392, 31)}


@pytest.mark.parametrize("x,dof,p", [(15.97, 12, 0.1926), (10.45, 8, 0.2347), (3.82, 2, 0.1481)])
def test_chi_square_tail(spark, x, dof, p):
    # published statistics and their rounded tail probabilities
    got = spark.range(1).select(chi2_sf_even(F.lit(x), F.lit(dof / 2)).alias("p")).first()["p"]
    assert got == pytest.approx(p, abs=2e-3)


def test_rounding_of_scaled_doubles(spark):
    row = spark.range(1).select(
        round_half_away(F.lit(1.005), 2).alias("a"), round_half_away(F.lit(0.285), 2).alias("b"),
        round_half_away(F.lit(-2.5), 0).alias("c")).first()
    assert tuple(row) == (1.0, 0.28, -3.0)


def test_rare_categories(spark):
    df = spark.createDataFrame([(v,) for v in ["a"] * 5 + ["b"] * 2 + [None] * 3], "c string")
    counts = {r["c"]: r["count"] for r in
              experiments.collapse_rare(df, "c", 3).groupBy("c").count().collect()}
    assert counts == {"a": 5, "OTHER": 2, None: 3}


def test_dashboard_filters(catalog):
    people = dashboard.user_funnel(catalog.users_enriched, catalog.loans_enriched)
    assert dashboard.apply_filters(people, province="All", device_os=None).count() == people.count()
    some = dashboard.apply_filters(people, device_os="ios", signup_month=12)
    assert some.count() == people.where("device_os = 'ios' AND signup_month = 12").count()
    with pytest.raises(ValueError):
        dashboard.apply_filters(people, shoe_size=4)
    nobody = dashboard.apply_filters(people, province="nowhere")
    assert dashboard.kpis(nobody).first()["approval_rate"] == 0.0
    assert [r["users"] for r in dashboard.funnel_stages(nobody).collect()] == [0] * 6


def test_trailing_deviation_of_equal_amounts_is_zero(spark):
    rows = [dict(txn_id=str(i), user_id=1, posted_date=dt.date(2024, 1, 1 + i), amount=0.1,
                 direction="inflow", category="payroll", balance_after=1e6 + 0.1 * (i // 12),
                 is_payroll=int(i == 3)) for i in range(13)]
    df = risk_base.transactions_for_risk(clean.clean_transactions(
        table(spark, "fct_transactions", rows)))
    got = {r["txn_id"]: r for r in df.collect()}
    assert all(r["inflow_std_14d"] == 0.0 for r in got.values())
    assert got["11"]["bal_std_14d"] == 0.0
    assert got["12"]["bal_std_14d"] == pytest.approx(0.1 * (12 ** 0.5) / 13, rel=1e-4)
    assert [got[str(i)]["days_since_last_payroll"] for i in (2, 3, 7)] == [1000, 0, 4]


def test_views_are_registered(spark, catalog):
    catalog.register()
    for view in catalog.views():
        assert spark.table(view).columns
    assert spark.sql("SELECT count(*) FROM v_user_funnel_base").first()[0] > 0
