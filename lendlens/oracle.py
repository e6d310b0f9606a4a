"""Expected results as DuckDB SQL over the supplied tables.

The binding is stated a second time here, and the operators are written in the
plain relational form (self joins, as-of join, range frames), so that the SQL
checks the Spark formulations and does not repeat them.
"""

from __future__ import annotations

import re

from lendlens.oracle_fits import logit_ame, ols_hc1
from lendlens.schemas import TABLES

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
ARMS = ["control", "persuasive", "social_proof"]

CTES: dict[str, str] = {}

# ---- binding -------------------------------------------------------------
CTES["u0"] = """
SELECT c_custkey AS user_id,
       TIMESTAMP '2023-12-01' + to_days((c_custkey % 75)::INT) AS signup_at,
       r_name AS province,
       ['ios', 'android'][(c_custkey % 2 + 1)::INT] AS device_os,
       lower(c_mktsegment) AS acquisition_channel,
       CASE WHEN c_custkey % 25 < 18 THEN TIMESTAMP '2023-12-01'
            + to_days((c_custkey % 75)::INT) + to_hours((c_custkey % 97)::INT) END AS bank_linked_at,
       ['weekly', 'biweekly', 'semimonthly', 'monthly', 'irregular'][(c_custkey % 5 + 1)::INT]
         AS payroll_frequency,
       (9998.0::DOUBLE - c_acctbal) / 11000.0::DOUBLE AS baseline_risk_score
FROM customer JOIN nation ON c_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey"""
CTES["ub"] = """
SELECT *, CASE WHEN baseline_risk_score < 0.15 THEN '740+'
               WHEN baseline_risk_score < 0.25 THEN '680-739'
               WHEN baseline_risk_score < 0.40 THEN '640-679'
               WHEN baseline_risk_score < 0.60 THEN '580-639'
               WHEN baseline_risk_score < 0.80 THEN '500-579' ELSE '<500' END AS fico_band
FROM u0"""
CTES["s0"] = """
SELECT event_id::VARCHAR AS event_id, user_id, ts,
       MAP {'view': 'app_open', 'click': 'link_bank_success', 'signup': 'start_advance_request',
            'purchase': 'submit_advance_request', 'error': 'approved'}[event_type] AS event_name,
       props AS properties_json
FROM events
UNION ALL
SELECT 'o-' || c_custkey, c_custkey, TIMESTAMP '2023-12-01' + to_days((c_custkey % 75)::INT),
       'app_open', '{}'
FROM customer"""
CTES["sb"] = """
SELECT event_id, user_id, user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, ts, event_name,
       CASE WHEN contains(event_name, 'bank') THEN 'onboarding'
            WHEN contains(event_name, 'request') THEN 'loan' ELSE 'home' END AS screen,
       properties_json
FROM s0"""
CTES["tb"] = """
SELECT 't-' || event_id AS txn_id, user_id, ts::DATE AS posted_date,
       if(event_type = 'signup', value, -value) AS amount,
       if(event_type = 'signup', 'inflow', 'outflow') AS direction,
       if(event_type = 'signup', '6011', '0000') AS mcc,
       MAP {'signup': 'payroll', 'view': 'groceries', 'click': 'dining', 'error': 'rent',
            'purchase': 'other'}[event_type] AS category,
       (event_id * 7919 % 100003) / 100.0::DOUBLE - 200.0::DOUBLE AS balance_after,
       (event_type = 'signup')::INT AS is_payroll
FROM events"""
CTES["l1"] = """
SELECT o_orderkey AS k,
       o_custkey - o_custkey % 25 + (o_custkey % 25) % 15 AS user_id,
       40.0::DOUBLE + o_totalprice / 2000.0::DOUBLE AS amount,
       TIMESTAMP '2024-01-01' + to_days((o_orderkey % 45)::INT)
         + to_hours((o_orderkey % 23)::INT) AS requested_at,
       CASE WHEN o_orderstatus = 'O' OR (o_custkey % 25) % 15 >= 12 THEN 'requested'
            WHEN (o_custkey % 25) % 15 >= 11 THEN 'approved'
            WHEN o_orderstatus = 'F' THEN 'repaid' ELSE 'default' END AS status
FROM orders"""
CTES["l2"] = """
SELECT *, CASE WHEN status <> 'requested' THEN requested_at + to_hours((k % 37)::INT) END
            AS approved_at,
       CASE status WHEN 'repaid' THEN k % 9 WHEN 'default' THEN 20 + k % 7 ELSE 0 END::INT
            AS late_days,
       ['A', 'B'][(user_id // 10 % 2 + 1)::INT] AS price_variant
FROM l1"""
CTES["l3"] = """
SELECT *, CASE WHEN status IN ('repaid', 'default') THEN approved_at + to_hours((k % 11)::INT) END
            AS disbursed_at
FROM l2"""
CTES["lb"] = """
SELECT 'L' || k AS loan_id, user_id, requested_at, approved_at, disbursed_at,
       (disbursed_at + INTERVAL 14 DAY)::DATE AS due_date,
       CASE WHEN status = 'repaid' THEN disbursed_at + to_days(14 + late_days) END AS repaid_at,
       amount,
       if(price_variant = 'B', amount / 100.0::DOUBLE, 0.0::DOUBLE) AS fee,
       if(status = 'requested', 0.0,
          [0, 0, 0, 0, 0, 0, 1, 2, 3, 5][(k % 10 + 1)::INT])::DOUBLE AS tip_amount,
       if(price_variant = 'B', [0, 0, 1.99, 2.99][(k % 4 + 1)::INT], 0)::DOUBLE
         AS instant_transfer_fee,
       status, late_days,
       (status = 'default' AND k % 2 = 0)::INT AS chargeoff_flag,
       (k % 3 = 0)::INT AS autopay_enrolled,
       CASE status WHEN 'repaid' THEN amount WHEN 'default' THEN amount * 0.25::DOUBLE
                   ELSE 0.0::DOUBLE END AS principal_repaid,
       if(status = 'default', amount * 0.75::DOUBLE, 0.0::DOUBLE) AS writeoff_amount,
       price_variant,
       ['control', 'persuasive', 'social_proof'][((user_id // 7 + user_id // 10) % 3 + 1)::INT]
         AS tip_variant
FROM l3"""
CTES["ab"] = """
SELECT 'P' || c_custkey AS assignment_id, c_custkey AS user_id,
       'PriceTest_2025Q2' AS experiment_name, ['A', 'B'][(c_custkey // 10 % 2 + 1)::INT] AS variant,
       TIMESTAMP '2023-12-01' + to_days((c_custkey % 75)::INT) AS assigned_at
FROM customer WHERE c_custkey % 10 BETWEEN 0 AND 5
UNION ALL
SELECT 'T' || c_custkey, c_custkey, 'TipPrompt_2025Q2',
       ['control', 'persuasive', 'social_proof'][((c_custkey // 7 + c_custkey // 10) % 3 + 1)::INT],
       TIMESTAMP '2023-12-01' + to_days((c_custkey % 75)::INT)
FROM customer WHERE c_custkey % 10 BETWEEN 3 AND 8"""

# ---- cleaned tables --------------------------------------------------------
CTES["uc"] = """
SELECT *, signup_at AS signup_at_utc, bank_linked_at AS bank_linked_at_utc,
       month(signup_at)::INT AS signup_month, year(signup_at)::INT AS signup_year,
       (isodow(signup_at) % 7)::INT AS signup_dow,
       (bank_linked_at IS NOT NULL)::INT AS bank_linked_flag,
       (bank_linked_at::DATE - signup_at::DATE)::INT AS days_taken_signup_bank_connect,
       ntile(10) OVER (ORDER BY baseline_risk_score NULLS LAST, user_id)::INT AS risk_score_decile
FROM ub"""
CTES["tc"] = """
SELECT *, posted_date::TIMESTAMP AS posted_date_utc,
       if(direction = 'outflow', 0 - amount, 0.0::DOUBLE) AS spend_amount_pos,
       if(direction = 'inflow', amount, 0.0::DOUBLE) AS inflow_amount_pos,
       (balance_after < 0)::INT AS neg_balance_flag,
       balance_after - amount AS balance_before,
       CASE WHEN list_contains(['groceries', 'utilities', 'rent', 'transport'], category)
              THEN 'essentials'
            WHEN list_contains(['entertainment', 'dining'], category) THEN 'discretionary'
            ELSE 'other' END AS spend_bucket
FROM tb"""
CTES["lc0"] = """
SELECT *, ifnull(fee, 0) + ifnull(tip_amount, 0) + ifnull(instant_transfer_fee, 0) AS revenue,
       (rank() OVER (PARTITION BY user_id ORDER BY requested_at) = 1)::INT AS is_first_loan
FROM lb"""
CTES["lc"] = """
SELECT *, date_trunc('year', requested_at)::TIMESTAMP AS requested_year,
       date_trunc('month', requested_at)::TIMESTAMP AS requested_month,
       requested_at AS requested_at_utc, approved_at AS approved_at_utc,
       disbursed_at AS disbursed_at_utc, due_date AS due_date_clean, repaid_at AS repaid_at_utc,
       (approved_at IS NOT NULL)::INT AS is_approved,
       (disbursed_at IS NOT NULL)::INT AS is_disbursed,
       (status = 'repaid')::INT AS is_repaid,
       (status = 'default' OR chargeoff_flag = 1)::INT AS is_default,
       (approved_at::DATE - requested_at::DATE)::INT AS days_to_approve,
       (disbursed_at::DATE - approved_at::DATE)::INT AS days_to_disburse,
       (repaid_at::DATE - disbursed_at::DATE)::INT AS days_to_repay,
       revenue - ifnull(writeoff_amount, 0) AS pnl,
       if(amount > 0, revenue / amount, NULL) AS revenue_to_loan,
       if(amount > 0, (revenue - ifnull(writeoff_amount, 0)) / amount, NULL) AS pnl_to_loan,
       if(amount > 0, ifnull(writeoff_amount, 0) / amount, NULL) AS writeoff_to_loan,
       if(amount > 0, ifnull(tip_amount, 0) / amount, NULL) AS tip_to_loan
FROM lc0"""
CTES["ac"] = """
SELECT *, assigned_at AS assigned_at_utc,
       date_trunc('month', assigned_at)::TIMESTAMP AS assigned_month,
       date_trunc('week', assigned_at)::TIMESTAMP AS assigned_week,
       year(assigned_at)::INT AS assigned_year, (isodow(assigned_at) % 7)::INT AS assigned_dow,
       contains(lower(experiment_name), 'price')::INT AS is_price_test,
       contains(lower(experiment_name), 'tip')::INT AS is_tip_test,
       lower(variant) AS variant_norm,
       row_number() OVER (PARTITION BY user_id ORDER BY assigned_at, assignment_id)
         AS assignment_order,
       (count(*) OVER (PARTITION BY user_id) > 1)::INT AS multi_test_user,
       concat_ws(':', experiment_name, variant) AS experiment_variant
FROM ab"""
CTES["sc0"] = """
SELECT *, ts AS ts_utc, date_trunc('month', ts)::TIMESTAMP AS event_month,
       date_trunc('week', ts)::TIMESTAMP AS event_week,
       (isodow(ts) % 7)::INT AS event_dow, hour(ts)::INT AS event_hour,
       (event_name = 'app_open')::INT AS is_app_open,
       (event_name = 'link_bank_success')::INT AS is_bank_linked,
       (event_name = 'start_advance_request')::INT AS is_request_start,
       (event_name = 'submit_advance_request')::INT AS is_request_submit,
       (event_name = 'approved')::INT AS is_approved_event,
       (event_name = 'disbursed')::INT AS is_disbursed_event,
       CASE WHEN contains(lower(screen), 'onboarding') THEN 'onboarding'
            WHEN contains(lower(screen), 'loan') THEN 'loan'
            WHEN contains(lower(screen), 'home') THEN 'home' ELSE 'other' END AS screen_bucket,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_order
FROM sb"""
CTES["sc"] = """
SELECT *, (event_order = 1)::INT AS is_first_event,
       (epoch_us(max(ts) OVER ses) - epoch_us(min(ts) OVER ses)) / 1e6 AS session_duration_sec,
       count(*) OVER ses AS events_per_session
FROM sc0 WINDOW ses AS (PARTITION BY session_id)"""

# ---- funnel ------------------------------------------------------------------
CTES["fao"] = """
SELECT user_id, min(ts_utc) FILTER (WHERE is_app_open = 1) AS first_app_open_ts
FROM sc0 GROUP BY user_id"""
CTES["fls"] = """
SELECT user_id, min(requested_at) AS first_request_ts, min(approved_at) AS first_approved_ts,
       min(disbursed_at) AS first_disbursed_ts, max(is_approved) AS any_approved,
       max(is_disbursed) AS any_disbursed
FROM lc GROUP BY user_id"""
CTES["fb"] = """
SELECT u.user_id, u.province, u.device_os, u.acquisition_channel, u.signup_month, u.signup_year,
       first_app_open_ts, u.bank_linked_at_utc AS bank_link_ts, first_request_ts,
       first_approved_ts, first_disbursed_ts,
       (first_app_open_ts IS NOT NULL)::INT AS did_app_open,
       u.bank_linked_flag AS did_bank_link,
       (first_request_ts IS NOT NULL)::INT AS did_request,
       (first_approved_ts IS NOT NULL OR ifnull(any_approved, 0) = 1)::INT AS did_approve,
       (first_disbursed_ts IS NOT NULL OR ifnull(any_disbursed, 0) = 1)::INT AS did_disburse
FROM uc u LEFT JOIN fao USING (user_id) LEFT JOIN fls USING (user_id)"""
CTES["fs"] = """
SELECT province, device_os, acquisition_channel, signup_month, signup_year,
       count(DISTINCT user_id) AS total_users,
       count(DISTINCT user_id) FILTER (WHERE first_app_open_ts IS NOT NULL) AS app_open_users,
       count(DISTINCT user_id) FILTER (WHERE did_bank_link = 1) AS bank_linked_users,
       count(DISTINCT user_id) FILTER (WHERE first_request_ts IS NOT NULL) AS requested_users,
       count(DISTINCT user_id) FILTER (WHERE first_approved_ts IS NOT NULL) AS approved_users,
       count(DISTINCT user_id) FILTER (WHERE first_disbursed_ts IS NOT NULL) AS disbursed_users
FROM fb GROUP BY ALL"""
CTES["ft"] = """
SELECT sum(app_open_users)::BIGINT AS c1, sum(bank_linked_users)::BIGINT AS c2,
       sum(requested_users)::BIGINT AS c3, sum(approved_users)::BIGINT AS c4,
       sum(disbursed_users)::BIGINT AS c5
FROM fs"""
CTES["fr0"] = """
SELECT province, device_os, acquisition_channel,
       sum(app_open_users)::BIGINT AS n1, sum(bank_linked_users)::BIGINT AS n2,
       sum(requested_users)::BIGINT AS n3, sum(approved_users)::BIGINT AS n4,
       sum(disbursed_users)::BIGINT AS n5
FROM fs GROUP BY ALL"""


def _clamped(a: str, b: str) -> str:
    return (f"CASE WHEN {a} = 0 OR {b} >= {a} THEN 1.0::DOUBLE"
            f" ELSE {b}::DOUBLE / {a} END")


CTES["fr"] = (
    "SELECT *, " + ", ".join(
        f"{_clamped(f'n{i}', f'n{i + 1}')} AS r{i}{i + 1}" for i in range(1, 5)
    ) + " FROM fr0"
)
CTES["fp"] = (
    "SELECT " + ", ".join(
        f"least(quantile_cont(r{i}{i + 1}, 0.75), 0.95::DOUBLE) AS t{i}{i + 1}"
        for i in range(1, 5)
    ) + " FROM fr"
)
CTES["fo"] = """
SELECT 'open→link' AS step, fr.*, n1 * t12 * r23 * r34 * r45 AS n5p FROM fr, fp
UNION ALL SELECT 'link→request', fr.*, n2 * t23 * r34 * r45 FROM fr, fp
UNION ALL SELECT 'request→approved', fr.*, n3 * t34 * r45 FROM fr, fp
UNION ALL SELECT 'approved→disbursed', fr.*, n4 * t45 FROM fr, fp"""

# ---- experiments ----------------------------------------------------------------
CTES["ua"] = """
SELECT user_id, max(variant) FILTER (WHERE experiment_name = 'PriceTest_2025Q2') AS price_variant,
       max(variant) FILTER (WHERE experiment_name = 'TipPrompt_2025Q2') AS tip_variant,
       count(DISTINCT experiment_name) AS num_experiments,
       (count(DISTINCT experiment_name) > 1)::INT AS is_overlapping_user,
       ifnull(max(variant) FILTER (WHERE experiment_name = 'PriceTest_2025Q2'), 'not_assigned')
         AS price_test_group,
       ifnull(max(variant) FILTER (WHERE experiment_name = 'TipPrompt_2025Q2'), 'not_assigned')
         AS tip_test_group,
       ifnull(max(variant) FILTER (WHERE experiment_name = 'PriceTest_2025Q2'), 'none') || '_' ||
       ifnull(max(variant) FILTER (WHERE experiment_name = 'TipPrompt_2025Q2'), 'none')
         AS combined_variant
FROM ab GROUP BY user_id"""
CTES["le"] = """
SELECT loan_id, user_id, amount, revenue, tip_amount, pnl, is_default, is_repaid, is_disbursed,
       disbursed_at_utc, price_test_group, tip_test_group, combined_variant, risk_score_decile,
       province, device_os, acquisition_channel
FROM lc JOIN ua USING (user_id) JOIN uc USING (user_id)"""
CTES["lt"] = """
SELECT * FROM le WHERE is_disbursed = 1 AND tip_test_group <> 'not_assigned'"""
CTES["ef"] = """
SELECT tip_test_group, price_test_group, risk_score_decile, province, amount, tip_amount, revenue, is_default,
       (tip_amount > 0)::INT AS tip_taken FROM lt"""
CTES["ei"] = """
SELECT price_test_group || '_' || tip_test_group AS arm, risk_score_decile, province, amount, revenue
FROM ef WHERE price_test_group IN ('A', 'B')"""
CTES["hd"] = """
SELECT * FROM (
  SELECT tip_test_group, price_test_group, risk_score_decile, amount / 1000.0::DOUBLE AS amount_k,
         if(count(*) OVER (PARTITION BY province) < 20, 'OTHER', province) AS province,
         (tip_amount > 0)::INT AS tip_taken, count(*) OVER (PARTITION BY risk_score_decile) AS in_decile
  FROM le WHERE is_disbursed = 1)
WHERE in_decile >= 50"""
CTES["la"] = "SELECT * FROM le WHERE is_disbursed = 1 AND price_test_group = 'A'"
CTES["nm"] = """
SELECT tip_test_group, count(*) AS loans, avg((tip_amount > 0)::INT) AS tip_take_rate,
       avg(tip_amount) AS mean_tip_all,
       avg(tip_amount) FILTER (WHERE tip_amount > 0) AS mean_tip_given_tip,
       avg(revenue) AS rpdl, avg(is_default) AS default_rate
FROM lt GROUP BY tip_test_group"""

# ---- dashboard ---------------------------------------------------------------------
CTES["du"] = """
SELECT user_id, province, device_os, acquisition_channel, signup_month, signup_at_utc,
       bank_linked_flag,
       (user_id IN (SELECT user_id FROM lc))::INT AS requested_loan,
       (user_id IN (SELECT user_id FROM lc WHERE is_approved = 1))::INT AS approved_loan,
       (user_id IN (SELECT user_id FROM lc WHERE is_disbursed = 1))::INT AS disbursed_loan,
       (user_id IN (SELECT user_id FROM lc WHERE is_repaid = 1))::INT AS repaid_loan,
       (user_id IN (SELECT user_id FROM lc WHERE is_default = 1))::INT AS defaulted_loan
FROM uc"""
CTES["de"] = """
SELECT loan_id, user_id, amount, tip_amount, revenue, is_disbursed, status,
       (tip_amount > 0)::INT AS tip_taken, (instant_transfer_fee > 0)::INT AS instant_transfer_used,
       price_test_group, tip_test_group
FROM lc JOIN ua USING (user_id) WHERE is_disbursed = 1"""

# ---- transactions, history, risk base ------------------------------------------------
_ROLL = """
  sum(inflow_amount_pos) OVER w{d} AS inflow_sum_{d}d,
  sum(spend_amount_pos) OVER w{d} AS spend_sum_{d}d,
  sum(if(spend_bucket = 'essentials', spend_amount_pos, 0)) OVER w{d} AS essentials_spend_sum_{d}d,
  sum(if(category = 'rent', spend_amount_pos, 0)) OVER w{d} AS rent_spend_sum_{d}d,
  (sum(neg_balance_flag) OVER w{d})::BIGINT AS neg_txn_count_{d}d,
  count(*) OVER w{d} AS txn_count_{d}d,
  stddev_pop(inflow_amount_pos) OVER w{d} AS inflow_std_{d}d,
  sum(inflow_amount_pos) OVER w{d} / {d} AS inflow_mean_{d}d,
  stddev_pop(balance_after) OVER w{d} AS bal_std_{d}d,
  avg(nullif(balance_after, 0)) OVER w{d} AS bal_mean_{d}d"""
CTES["tr"] = (
    "SELECT user_id, txn_id, posted_date_utc," + _ROLL.format(d=14) + ", "
    "ifnull((posted_date - max(if(is_payroll = 1, posted_date, NULL)) OVER so_far), 1000)::INT"
    " AS days_since_last_payroll," + _ROLL.format(d=30)
    + " FROM tc WINDOW so_far AS (PARTITION BY user_id ORDER BY posted_date),"
    + ",".join(
        f" w{d} AS (PARTITION BY user_id ORDER BY posted_date_utc"
        f" RANGE BETWEEN INTERVAL {d - 1} DAY PRECEDING AND CURRENT ROW)" for d in (14, 30)
    )
)
CTES["pp"] = """
SELECT c.loan_id, (count(a.loan_id) > 0)::INT AS prior_loan_flag,
       avg(a.late_days) FILTER (WHERE a.is_disbursed = 1) AS prior_avg_days_late,
       avg(a.amount) FILTER (WHERE a.is_disbursed = 1) AS prior_avg_amount,
       avg(a.revenue / a.amount) FILTER (WHERE a.is_disbursed = 1 AND a.amount > 0)
         AS prior_avg_revenue_to_loan,
       avg((ifnull(a.tip_amount, 0) > 0)::INT) FILTER (WHERE a.is_disbursed = 1)
         AS prior_tip_take_rate,
       count(a.loan_id) AS prior_approved_loans_count,
       count(b.loan_id) AS prior_unapproved_loans_count
FROM lc c
LEFT JOIN lc a ON a.user_id = c.user_id AND a.approved_at < c.approved_at
LEFT JOIN lc b ON b.user_id = c.user_id AND b.is_approved = 0 AND b.requested_at < c.approved_at
GROUP BY c.loan_id"""
CTES["pd"] = """
SELECT c.loan_id, (EXISTS (FROM lc p WHERE p.user_id = c.user_id AND p.is_default = 1
                             AND p.approved_at < c.approved_at))::INT AS prior_loan_default_flag
FROM lc c WHERE c.approved_at IS NOT NULL"""
CTES["td"] = "SELECT DISTINCT ON (user_id, posted_date_utc) * FROM tr"
CTES["sn"] = """
SELECT l.loan_id, l.user_id, l.approved_at_utc, d.* EXCLUDE (user_id, txn_id)
FROM (FROM lc WHERE approved_at IS NOT NULL) l
ASOF JOIN td d ON l.user_id = d.user_id AND l.approved_at_utc > d.posted_date_utc"""


def _ratios() -> str:
    out = []
    for d in (14, 30):
        inflow, spend = f"inflow_sum_{d}d", f"spend_sum_{d}d"
        net = f"({inflow} + {spend})"
        out += [
            f"rent_spend_sum_{d}d / nullif({spend}, 0) AS rent_share_outflows_{d}d",
            f"essentials_spend_sum_{d}d / nullif({spend}, 0) AS essentials_share_{d}d",
            f"{net} AS net_cashflow_{d}d",
            f"inflow_std_{d}d / nullif(abs({net}), 0) AS inflow_vol_to_netcashflow_{d}d",
            f"bal_std_{d}d / nullif(abs({net}), 0) AS bal_vol_to_netcashflow_{d}d",
            f"{inflow} / nullif({spend}, 0) AS cashin_to_cashout_{d}d",
            f"neg_txn_count_{d}d::DOUBLE / nullif(txn_count_{d}d, 0) AS overdraft_txshare_{d}d",
        ]
    return ", ".join(out)


CTES["sr"] = f"SELECT loan_id, {_ratios()} FROM sn"
CTES["rb"] = """
SELECT l.loan_id, l.user_id, l.amount, l.is_default, l.approved_at_utc, l.disbursed_at_utc,
       l.due_date_clean, u.province, u.device_os, u.acquisition_channel, u.baseline_risk_score,
       u.payroll_frequency, pd.prior_loan_default_flag, pp.* EXCLUDE (loan_id),
       (sn.loan_id IS NOT NULL)::INT AS txn_info_found,
       sn.* EXCLUDE (loan_id, user_id, approved_at_utc, posted_date_utc), sr.* EXCLUDE (loan_id)
FROM lc l JOIN uc u ON u.user_id = l.user_id
JOIN pd ON pd.loan_id = l.loan_id
LEFT JOIN pp ON pp.loan_id = l.loan_id
LEFT JOIN sn ON sn.loan_id = l.loan_id
LEFT JOIN sr ON sr.loan_id = l.loan_id"""

# ---- data quality -----------------------------------------------------------------------
BASE = [("dim_users", "ub", "user_id"), ("fct_transactions", "tb", "txn_id"),
        ("fct_loans", "lb", "loan_id"), ("fct_sessions", "sb", "event_id"),
        ("ab_assignments", "ab", "assignment_id")]
CLEAN = [("dim_users", "v_dim_users_clean", "uc", "user_id"),
         ("fct_transactions", "v_fct_transactions_clean", "tc", "txn_id"),
         ("fct_loans", "v_fct_loans_clean", "lc", "loan_id"),
         ("fct_sessions", "v_fct_sessions_clean", "sc", "event_id"),
         ("ab_assignments", "v_ab_assignments_clean", "ac", "assignment_id")]
DERIVED_VIEWS = [("v_user_funnel_base", "fb", "user_id"), ("v_funnel_by_segment", "fs", None),
                 ("v_user_experiment_assignments", "ua", "user_id"),
                 ("v_loans_with_experiments", "le", "loan_id"),
                 ("v_fct_transactions_for_risk", "tr", "txn_id"),
                 ("v_user_prior_loan_perf", "pp", "loan_id"),
                 ("v_risk_model_base", "rb", "loan_id")]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def _counts(label: str, name: str, cte: str, key: str | None) -> str:
    keys = f"count(DISTINCT {key})" if key else "0::BIGINT"
    return (f"SELECT '{name}' AS {label}, count(*) AS row_count, {keys} AS unique_keys"
            f" FROM {cte}")


CTES["qb"] = _union([_counts("table_name", *t) for t in BASE])
CTES["qv"] = _union(
    [_counts("view_name", v, cte, key) for _, v, cte, key in CLEAN]
    + [_counts("view_name", *v) for v in DERIVED_VIEWS]
)
CTES["qr"] = (
    "SELECT b.table_name, b.row_count AS base_count, v.row_count AS view_count,"
    " b.unique_keys AS base_unique_keys, v.unique_keys AS view_unique_keys,"
    " if(b.row_count = v.row_count, 'PASS', 'FAIL') AS row_count_check,"
    " if(b.unique_keys = v.unique_keys, 'PASS', 'FAIL') AS unique_key_check"
    " FROM qb b JOIN (" + _union([_counts("table_name", t, cte, k) for t, _, cte, k in CLEAN])
    + ") v USING (table_name)"
)
CTES["qn"] = _union([
    f"SELECT '{v}' AS table_name, '{c}' AS key_column, count(*) AS total_rows,"
    f" count_if({c} IS NULL)::BIGINT AS null_count,"
    f" if(count_if({c} IS NULL) = 0, 'PASS', 'FAIL') AS null_check FROM {cte}"
    for _, v, cte, k in CLEAN for c in dict.fromkeys([k, "user_id"])
])
CTES["qo"] = _union([
    f"SELECT '{label}_orphans' AS check_name, count(*) AS orphan_count,"
    f" if(count(*) = 0, 'PASS', 'FAIL') AS integrity_check FROM {cte} f"
    " WHERE NOT EXISTS (FROM uc WHERE uc.user_id = f.user_id)"
    for label, cte in (("transactions", "tc"), ("loans", "lc"), ("sessions", "sc"),
                       ("ab_assignments", "ac"))
])


def _rules(rows: list[tuple], name: str, check: str) -> str:
    return _union([
        f"SELECT '{rule}' AS {name}, count(*) AS violation_count,"
        f" if(count(*) = 0, 'PASS', '{bad}') AS {check} FROM {cte} WHERE {cond}"
        for rule, cte, cond, bad in rows
    ])


CTES["qt"] = _rules([
    ("negative_amounts_in_inflows", "tc", "direction = 'inflow' AND amount < 0", "FAIL"),
    ("positive_amounts_in_outflows", "tc", "direction = 'outflow' AND amount > 0", "FAIL"),
    ("zero_amounts", "tc", "amount = 0", "WARN"),
], "check_name", "validation_check") + """
UNION ALL SELECT 'extreme_amounts', count_if(abs(amount) > 10000)::BIGINT,
       if(count_if(abs(amount) > 10000) < count(*) / 100.0, 'PASS', 'WARN') FROM tc"""
CTES["ql"] = _rules([
    ("negative_loan_amounts", "lc", "amount <= 0", "FAIL"),
    ("approved_without_timestamp", "lc", "is_approved = 1 AND approved_at IS NULL", "FAIL"),
    ("disbursed_without_timestamp", "lc", "is_disbursed = 1 AND disbursed_at IS NULL", "FAIL"),
    ("repaid_without_timestamp", "lc", "is_repaid = 1 AND repaid_at IS NULL", "FAIL"),
    ("invalid_loan_lifecycle_order", "lc",
     "approved_at < requested_at OR disbursed_at < approved_at OR disbursed_at < requested_at",
     "FAIL"),
], "check_name", "validation_check")
CTES["qu"] = _rules([
    ("bank_linked_before_signup", "uc", "bank_linked_at < signup_at", "FAIL"),
    ("invalid_risk_scores", "uc", "NOT baseline_risk_score BETWEEN 0 AND 1", "FAIL"),
    ("negative_days_to_bank_connect", "uc", "days_taken_signup_bank_connect < 0", "FAIL"),
], "check_name", "validation_check")
CTES["qs"] = _rules([
    ("negative_session_duration", "sc", "session_duration_sec < 0", "FAIL"),
    ("zero_events_per_session", "sc", "events_per_session <= 0", "WARN"),
], "check_name", "validation_check")
CTES["qa"] = _rules([
    ("future_assignment_dates", "ac", f"assigned_at > {AS_OF}", "FAIL"),
    ("invalid_experiment_variants", "ac",
     "NOT list_contains(['control', 'treatment', 'variant_a', 'variant_b', 'low', 'high',"
     " 'enabled', 'disabled'], variant_norm)", "WARN"),
], "check_name", "validation_check")
CTES["qx"] = _rules([
    ("loans_negative_amounts", "lc", "amount <= 0", "FAIL"),
    ("loans_future_request_dates", "lc", f"requested_at > {AS_OF}", "FAIL"),
    ("disbursed_loans_no_disbursement_date", "lc", "is_disbursed = 1 AND disbursed_at IS NULL",
     "FAIL"),
    ("repaid_loans_no_repayment_date", "lc", "is_repaid = 1 AND repaid_at IS NULL", "FAIL"),
    ("transactions_zero_amounts", "tc", "amount = 0", "FAIL"),
    ("users_future_signup_dates", "uc", f"signup_at > {AS_OF}", "FAIL"),
    ("experiment_assignments_future_dates", "ac", f"assigned_at > {AS_OF}", "FAIL"),
], "rule_name", "rule_check")
CTES["qd"] = """
SELECT 'user_province_distribution' AS check_name, province, count(*) AS count,
       round(100.0 * count(*) / (SELECT count(*) FROM ub), 2) AS percentage
FROM ub GROUP BY province"""
CTES["qc"] = """
SELECT 'Total approved loans' AS metric, count(*) AS count FROM rb
UNION ALL SELECT 'Loans with transaction data', sum(txn_info_found)::BIGINT FROM rb
UNION ALL SELECT 'Loans with prior loan history', sum(prior_loan_flag)::BIGINT FROM rb
UNION ALL SELECT 'Default loans', sum(is_default)::BIGINT FROM rb
UNION ALL SELECT 'Disbursed loans', count(disbursed_at_utc) FROM rb"""
CTES["qf"] = """
SELECT 'Users with app open events' AS stage, count(first_app_open_ts) AS count FROM fb
UNION ALL SELECT 'Users who linked bank', sum(did_bank_link)::BIGINT FROM fb
UNION ALL SELECT 'Users who requested loans', count(first_request_ts) FROM fb
UNION ALL SELECT 'Users who got approved', count(first_approved_ts) FROM fb"""
_SUMMARY = [("Row Count Reconciliation", "row_count_check", "qr"),
            ("Unique Key Reconciliation", "unique_key_check", "qr"),
            ("Null Key Checks", "null_check", "qn"),
            ("Referential Integrity", "integrity_check", "qo"),
            ("Business Rules", "rule_check", "qx")]
CTES["qz"] = (
    "SELECT check_category, status, count(*) AS check_count,"
    " MAP {'PASS': '✓', 'FAIL': '✗'}[status] AS status_icon FROM ("
    + _union([f"SELECT '{c}' AS check_category, {s} AS status FROM {t}" for c, s, t in _SUMMARY])
    + ") GROUP BY ALL"
)
_TIDY = [
    ("row_count_reconciliation", "table_name", "view_count", "row_count_check", "qr"),
    ("unique_key_reconciliation", "table_name", "view_unique_keys", "unique_key_check", "qr"),
    ("null_key_checks", "table_name || '.' || key_column", "null_count", "null_check", "qn"),
    ("referential_integrity", "check_name", "orphan_count", "integrity_check", "qo"),
    ("transaction_validations", "check_name", "violation_count", "validation_check", "qt"),
    ("loan_validations", "check_name", "violation_count", "validation_check", "ql"),
    ("user_validations", "check_name", "violation_count", "validation_check", "qu"),
    ("session_validations", "check_name", "violation_count", "validation_check", "qs"),
    ("ab_test_validations", "check_name", "violation_count", "validation_check", "qa"),
    ("business_rules", "rule_name", "violation_count", "rule_check", "qx"),
    ("risk_model_coverage", "metric", "count", "NULL", "qc"),
    ("funnel_completeness", "stage", "count", "NULL", "qf"),
    ("distribution_checks", "province", "percentage", "NULL", "qd"),
]
CTES["qall"] = _union([
    f"SELECT '{c}' AS category, {n} AS check_name, {m}::DOUBLE AS measured,"
    f" {s}::VARCHAR AS status FROM {t}"
    for c, n, m, s, t in _TIDY
])

_NAMES = {name: re.compile(rf"\b(?:FROM|JOIN|from|join)\s*\(?\s*{name}\b|,\s*{name}\b")
          for name in CTES}


KEPT = {"hd"}  # read by many parts of one statement


def compose(final: str) -> str:
    """``final`` with the CTEs it reaches, in definition order."""
    needed: set[str] = set()
    todo = [final]
    while todo:
        text = todo.pop()
        for name, pattern in _NAMES.items():
            if name not in needed and pattern.search(text):
                needed.add(name)
                todo.append(CTES[name])
    if not needed:
        return final.strip()
    order = [n for n in CTES if n in needed]
    body = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in KEPT else ''}({CTES[n].strip()})" for n in order)
    return f"WITH {body}\n{final.strip()}"


def rounded(sql: str, columns: str, digits: int = 6) -> str:
    """Round the named double columns, nudged off exact halves as on the Spark side."""
    nudge = f"{0.00123 * 10.0 ** -digits!r}::DOUBLE"
    replaced = ", ".join(f"round({c} + {nudge}, {digits}) AS {c}" for c in columns.split())
    return f"SELECT * REPLACE ({replaced}) FROM ({sql})"


ORACLE: dict[str, str] = {}


def expect(name: str, sql: str, doubles: str = "", digits: int = 6) -> None:
    ORACLE[name] = compose(rounded(sql, doubles, digits) if doubles else sql)


def _trailing(*ranges: int) -> str:
    return " ".join(
        f"inflow_sum_{d}d spend_sum_{d}d essentials_spend_sum_{d}d rent_spend_sum_{d}d"
        f" inflow_std_{d}d inflow_mean_{d}d bal_std_{d}d bal_mean_{d}d" for d in ranges
    )


_RATIOS = " ".join(
    f"rent_share_outflows_{d}d essentials_share_{d}d net_cashflow_{d}d"
    f" inflow_vol_to_netcashflow_{d}d bal_vol_to_netcashflow_{d}d cashin_to_cashout_{d}d"
    f" overdraft_txshare_{d}d" for d in (14, 30)
)
_PRIOR = ("prior_avg_days_late prior_avg_amount prior_avg_revenue_to_loan"
          " prior_tip_take_rate")

# ingest and load
expect("ingest_typed", "FROM lb")
expect("schema_required_columns", _union([
    f"SELECT '{t}' AS table_name, '' AS missing_columns, count(*) AS complete_rows,"
    f" 'PASS' AS status FROM {cte} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols.split())}"
    for t, cte, cols in [
        ("dim_users", "ub", "user_id signup_at province device_os"),
        ("fct_transactions", "tb", "txn_id user_id amount category"),
        ("fct_loans", "lb", "loan_id user_id amount status"),
        ("fct_sessions", "sb", "event_id user_id event_name"),
        ("ab_assignments", "ab", "assignment_id user_id experiment_name")]
]))
expect("dataset_summary", """
SELECT dataset, rows, columns FROM (
  SELECT 'dim_users' AS dataset, count(*) AS rows, 9 AS columns FROM ub
  UNION ALL SELECT 'fct_sessions', count(*), 7 FROM sb
  UNION ALL SELECT 'fct_transactions', count(*), 9 FROM tb
  UNION ALL SELECT 'fct_loans', count(*), 19 FROM lb
  UNION ALL SELECT 'ab_assignments', count(*), 5 FROM ab)
UNION ALL SELECT 'TOTAL', (SELECT sum(row_count)::BIGINT FROM qb), NULL""")
expect("table_row_counts", "SELECT table_name, row_count FROM qb")


def _row_json(table: str) -> str:
    shown = {
        "double": "{}::DECIMAL(18,4)::VARCHAR", "timestamp_ntz": "strftime({}, '%Y-%m-%d %H:%M:%S')",
    }
    pairs = [
        f"'{f.name}', coalesce({shown.get(f.dataType.typeName(), '{}::VARCHAR').format(f.name)}, '')"
        for f in TABLES[table][1].fields
    ]
    return f"json_object({', '.join(pairs)})::VARCHAR"


expect("table_samples", _union([
    f"(SELECT '{t}' AS table_name, {k}::VARCHAR AS key, {_row_json(t)} AS row_json"
    f" FROM {cte} ORDER BY {k} LIMIT 3)"
    for t, cte, k in BASE
]))
expect("top_provinces", """
SELECT province, count(*) AS user_count FROM ub GROUP BY province
ORDER BY user_count DESC, province LIMIT 5""")
expect("loan_status_distribution", """
SELECT status, count(*) AS loan_count, round(avg(amount), 2) AS avg_amount
FROM lb GROUP BY status""")
expect("dedupe_append_index", """
SELECT if(count(*) OVER (PARTITION BY id) > 1, id || '-dup-' || pos, id) AS txn_id,
       pos AS row_index, l_extendedprice
FROM (SELECT l_orderkey || '-' || l_linenumber AS id, l_extendedprice,
             row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                l_quantity, l_extendedprice, l_shipdate) - 1 AS pos
      FROM lineitem)""")

# cleaned tables
expect("users_clean", "FROM uc")
expect("transactions_clean", "FROM tc",
       "amount balance_after spend_amount_pos inflow_amount_pos balance_before")
expect("loans_clean", "FROM lc",
       "amount fee tip_amount instant_transfer_fee principal_repaid writeoff_amount revenue pnl"
       " revenue_to_loan pnl_to_loan writeoff_to_loan tip_to_loan")
expect("assignments_clean", "FROM ac")
expect("sessions_clean", "FROM sc")

# funnel
expect("user_first_app_open", "FROM fao")
expect("user_bank_link", "SELECT user_id, bank_linked_flag, bank_linked_at AS bank_link_ts FROM uc")
expect("user_loan_steps", "FROM fls")
expect("user_funnel_base", "FROM fb")
expect("funnel_by_segment", "FROM fs")


def _step(label: str, a: str, b: str) -> str:
    return (f"SELECT '{label}' AS step, {a} AS from_cnt, {b} AS to_cnt,"
            f" if({a} > 0, {b}::DOUBLE / {a}, 0) AS conversion_rate,"
            f" {a} - {b} AS dropoff_count,"
            f" if({a} > 0, ({a} - {b})::DOUBLE / {a}, 0) AS dropoff_rate FROM ft")


expect("funnel_overall", _union([
    _step("open→link", "c1", "c2"), _step("link→request", "c2", "c3"),
    _step("request→approved", "c3", "c4"), _step("approved→disbursed", "c4", "c5"),
    _step("open→disbursed (absolute)", "c1", "c5"),
]), "conversion_rate dropoff_rate")
expect("funnel_segment_rates", "FROM fr", "r12 r23 r34 r45")
expect("funnel_p75_levers", """
SELECT step, round(sum(greatest(n5p - n5, 0)), 3) AS incremental_disbursed_dataset,
       round(sum(greatest(n5p - n5, 0)) / nullif(sum(n1), 0) * 1000, 3) AS incremental_per_1k_opens
FROM fo WHERE n1 > 0 GROUP BY step""")
expect("funnel_top_friction", """
SELECT step, province, device_os, acquisition_channel,
       round(greatest(n5p - n5, 0), 3) AS incremental_disbursed,
       round(if(n1 > 0, (n5p - n5) / n1 * 1000, 0), 3) AS incremental_per_1k_opens
FROM fo ORDER BY greatest(n5p - n5, 0) DESC, step, province, device_os, acquisition_channel
LIMIT 3""")


def _share(a: str, b: str) -> str:
    return f"coalesce({a}::DOUBLE / nullif({b}, 0), 0)"


expect("funnel_by_channel", f"""
SELECT acquisition_channel, sum(n3)::BIGINT AS requests, sum(n2)::BIGINT AS bank_links,
       {_share('sum(n3)', 'sum(n2)')} AS r_link_to_request, sum(n4)::BIGINT AS approvals,
       {_share('sum(n4)', 'sum(n3)')} AS r_request_to_approved
FROM fr0 GROUP BY acquisition_channel""", "r_link_to_request r_request_to_approved")
expect("funnel_by_cohort", f"""
SELECT signup_year, signup_month, open_cnt, link_cnt, request_cnt, approved_cnt, disbursed_cnt,
       {_share('link_cnt', 'open_cnt')} AS r_open_to_link,
       {_share('request_cnt', 'link_cnt')} AS r_link_to_request,
       {_share('approved_cnt', 'request_cnt')} AS r_request_to_approved,
       {_share('disbursed_cnt', 'approved_cnt')} AS r_approved_to_disbursed,
       {_share('disbursed_cnt', 'open_cnt')} AS r_open_to_disbursed,
       printf('%d-%02d', signup_year, signup_month) AS signup_period
FROM (SELECT signup_year, signup_month, sum(app_open_users)::BIGINT AS open_cnt,
             sum(bank_linked_users)::BIGINT AS link_cnt, sum(requested_users)::BIGINT AS request_cnt,
             sum(approved_users)::BIGINT AS approved_cnt,
             sum(disbursed_users)::BIGINT AS disbursed_cnt
      FROM fs GROUP BY ALL)""",
       "r_open_to_link r_link_to_request r_request_to_approved r_approved_to_disbursed"
       " r_open_to_disbursed")

# metrics
expect("metric_signup_to_request", """
SELECT *, round(100.0 * d1_requests / total_signups, 2) AS d1_rate_pct,
       round(100.0 * d7_requests / total_signups, 2) AS d7_rate_pct,
       round(100.0 * w1_requests / total_signups, 2) AS w1_rate_pct
FROM (SELECT count(*) AS total_signups,
             count_if(gap <= 1)::BIGINT AS d1_requests, count_if(gap <= 7)::BIGINT AS d7_requests,
             count_if(weeks <= 1)::BIGINT AS w1_requests
      FROM (SELECT first_request_ts::DATE - signup_at::DATE AS gap,
                   (first_request_ts::DATE - signup_at::DATE) // 7 AS weeks
            FROM uc LEFT JOIN fls USING (user_id)))""")
expect("metric_bank_link_rate", """
SELECT count(*) AS total_users, count(bank_linked_at) AS users_linked_bank,
       round(100.0 * count(bank_linked_at) / count(*), 2) AS bank_link_rate_pct FROM ub""")
expect("metric_approval_disbursement", """
SELECT count(*) AS total_loan_requests, count(approved_at) AS approved_loans,
       count(disbursed_at) AS disbursed_loans,
       round(100.0 * count(approved_at) / count(*), 2) AS approval_rate_pct,
       round(100.0 * count(disbursed_at) / count(*), 2) AS disbursement_rate_pct,
       round(100.0 * count(disbursed_at) / count(approved_at), 2)
         AS approval_to_disbursement_rate_pct
FROM lb""")
expect("metric_repayment_default", """
SELECT count(*) AS total_disbursed_loans, sum(is_repaid)::BIGINT AS repaid_loans,
       sum(is_default)::BIGINT AS defaulted_loans,
       round(100.0 * sum(is_repaid) / count(*), 2) AS repayment_rate_pct,
       round(100.0 * sum(is_default) / count(*), 2) AS default_rate_pct
FROM lc WHERE disbursed_at IS NOT NULL""")
expect("metric_take_rate", """
SELECT count(*) AS total_loans, round(avg(amount), 2) AS avg_loan_amount,
       round(avg(revenue), 2) AS avg_take, round(100 * avg(revenue_to_loan), 2) AS avg_take_rate_pct
FROM lc""")
expect("metric_instant_adoption", """
SELECT count(*) AS disbursed_loans,
       count(*) FILTER (WHERE instant_transfer_fee > 0) AS instant_transfer_users,
       round(100.0 * count(*) FILTER (WHERE instant_transfer_fee > 0) / count(*), 2)
         AS instant_adoption_rate_pct
FROM lb WHERE disbursed_at IS NOT NULL""")
expect("metric_revenue_per_loan", """
SELECT count(*) AS disbursed_loans, round(avg(revenue), 2) AS avg_revenue_per_loan,
       round(sum(revenue), 2) AS total_revenue, round(avg(fee), 2) AS avg_fee,
       round(avg(tip_amount), 2) AS avg_tip, round(avg(instant_transfer_fee), 2) AS avg_instant_fee
FROM lc WHERE disbursed_at IS NOT NULL""")
expect("metric_late_payment", """
SELECT count(*) AS repaid_loans, count(*) FILTER (WHERE late_days > 7) AS late_repaid_loans,
       round(100.0 * count(*) FILTER (WHERE late_days > 7) / count(*), 2) AS late_payment_rate_pct,
       round(avg(late_days), 1) AS avg_late_days
FROM lb WHERE status = 'repaid'""")


def _grade(good: int, monitor: int) -> str:
    return f"CASE WHEN v >= {good} THEN 'Good' WHEN v >= {monitor} THEN 'Monitor'" \
           " ELSE 'Needs Attention' END"


_PAID = "FROM lc WHERE is_disbursed = 1"
_CARD = [
    ("Activation (D7 signup-to-request)", _grade(25, 15),
     "SELECT round(100.0 * count_if(first_request_ts::DATE - signup_at::DATE <= 7) / count(*), 2)"
     " AS v FROM uc LEFT JOIN fls USING (user_id)"),
    ("Bank Link Rate", _grade(70, 60),
     "SELECT round(100.0 * count(bank_linked_at) / count(*), 2) AS v FROM ub"),
    ("Approval Rate", _grade(60, 50), "SELECT round(100.0 * avg(is_approved), 2) AS v FROM lc"),
    ("Repayment Rate", _grade(70, 60), f"SELECT round(100.0 * avg(is_repaid), 2) AS v {_PAID}"),
    ("Default Rate", "if(v < 30, 'Monitor', 'High')",
     f"SELECT round(100.0 * avg(is_default), 2) AS v {_PAID}"),
    ("Average Loan Amount", "'Baseline'", "SELECT round(avg(amount), 2) AS v FROM lc"),
    ("Revenue per Loan", "'Baseline'", f"SELECT round(avg(revenue), 2) AS v {_PAID}"),
    ("Instant Transfer Adoption", "if(v > 20, 'Good', 'Opportunity')",
     f"SELECT round(100.0 * avg((instant_transfer_fee > 0)::INT), 2) AS v {_PAID}"),
    ("Late Payment Rate (NPS Proxy)", "if(v < 5, 'Excellent', 'Monitor')",
     "SELECT round(100.0 * avg((late_days > 7)::INT), 2) AS v FROM lc WHERE is_repaid = 1"),
]
expect("metric_scorecard", _union([
    f"SELECT '{m}' AS metric, v AS value, {g} AS status FROM ({q})" for m, g, q in _CARD
]))
expect("metric_north_star", f"""
SELECT sum(amount) AS loan_volume, sum(principal_repaid) AS repaid_volume,
       sum(principal_repaid) / sum(amount) AS repaid_share {_PAID}""",
       "loan_volume repaid_volume repaid_share", 4)

# experiments
expect("user_experiment_assignments", "FROM ua")
expect("loans_with_experiments", "FROM le", "amount revenue tip_amount pnl")
expect("experiment_baseline_rpdl",
       "SELECT round(avg(revenue), 2) AS mean_rpdl, count(*) AS n_loans FROM la")
expect("experiment_window", """
SELECT min(disbursed_at_utc)::DATE AS start_date, max(disbursed_at_utc)::DATE AS end_date,
       (max(disbursed_at_utc)::DATE - min(disbursed_at_utc)::DATE + 1)::INT AS total_days FROM la""")
expect("experiment_power", """
SELECT (m * 100)::INT || '%' AS mde, round(mu * m, 2) AS abs_delta_usd, n AS n_per_arm,
       ceil(n / daily) AS horizon_days
FROM (SELECT *, ceil(2 * pow(1.96::DOUBLE + 0.84::DOUBLE, 2) * mu * mu / ((m * mu) * (m * mu)))
               AS n
      FROM (SELECT round(avg(revenue), 2) AS mu,
                   round(count(*) / (max(disbursed_at_utc)::DATE
                                     - min(disbursed_at_utc)::DATE + 1)) AS daily,
                   unnest([0.10::DOUBLE, 0.15::DOUBLE, 0.20::DOUBLE]) AS m FROM la))""")
expect("experiment_naive_means", "FROM nm",
       "tip_take_rate mean_tip_all mean_tip_given_tip rpdl default_rate")
expect("experiment_naive_effects", """
SELECT t.tip_test_group AS tip_variant, t.loans,
       round((t.tip_take_rate - c.tip_take_rate) * 100, 2) AS take_rate_delta_pp,
       round(t.mean_tip_given_tip - c.mean_tip_given_tip, 2) AS mean_tip_given_tip_delta,
       round(100 * (t.rpdl - c.rpdl) / nullif(c.rpdl, 0), 2) AS rpdl_lift_pct,
       round(t.rpdl - c.rpdl, 2) AS rpdl_delta,
       round((t.default_rate - c.default_rate) * 100, 3) AS default_delta_pp
FROM nm t JOIN nm c ON c.tip_test_group = 'control' AND t.tip_test_group <> 'control'""")
expect("srm_counts", """
SELECT tip_test_group AS variant, count(DISTINCT user_id) AS n_users FROM ua
WHERE tip_test_group <> 'not_assigned' GROUP BY ALL""")
expect("experiment_srm", """
SELECT *, exp(-chi2 / 2) AS p_value
FROM (SELECT variant, n_users, 100.0 * n_users / sum(n_users) OVER () AS pct_users,
             sum(pow(n_users - tot / 3.0::DOUBLE, 2) / (tot / 3.0::DOUBLE)) OVER () AS chi2
      FROM (SELECT variant, count(DISTINCT user_id) AS n_users,
                   (SELECT count(DISTINCT user_id) FROM ab
                    WHERE experiment_name = 'TipPrompt_2025Q2') AS tot
            FROM ab WHERE experiment_name = 'TipPrompt_2025Q2' GROUP BY variant))""",
       "pct_users chi2 p_value")


def _crosstab(label: str, bucket: str, domain: str = "") -> str:
    cells = ", ".join(f"count(DISTINCT user_id) FILTER (WHERE variant = '{a}') AS {a}"
                      for a in ARMS)
    row = " + ".join(ARMS)
    chi = " + ".join(
        f"pow({a} - rt * sum({a}) OVER () / sum(rt) OVER (), 2)"
        f" / (rt * sum({a}) OVER () / sum(rt) OVER ())" for a in ARMS
    )
    pct = ", ".join(f"100.0 * {a} / nullif(rt, 0) AS {a}_pct" for a in ARMS)
    counted = f"""SELECT {bucket} AS {label}, {cells} FROM ac
                  WHERE experiment_name = 'TipPrompt_2025Q2' GROUP BY 1"""
    if domain:
        filled = ", ".join(f"ifnull({a}, 0) AS {a}" for a in ARMS)
        counted = (f"SELECT {label}, {filled} FROM (SELECT unnest({domain}) AS {label})"
                   f" LEFT JOIN ({counted}) USING ({label})")
    return f"""
SELECT * EXCLUDE (part, h), sum(part) OVER () AS chi2, (2 * h)::INT AS dof,
       exp(-(sum(part) OVER ()) / 2)
         * list_sum([pow((sum(part) OVER ()) / 2, i) / factorial(i::INT) for i in range(h)])
         AS p_value
FROM (SELECT {label}, {', '.join(ARMS)}, {pct}, {chi} AS part,
             (count(*) FILTER (WHERE rt > 0) OVER ()) - 1 AS h
      FROM (SELECT *, ({row})::DOUBLE AS rt
            FROM ({counted})))"""


_WEEKDAY = _crosstab("weekday", "strftime(assigned_at, '%a')",
                     "['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun']")
_MONTH = _crosstab("assigned_month", "date_trunc('month', assigned_at)::DATE")
_PCT = " ".join(f"{a}_pct" for a in ARMS) + " chi2 p_value"
expect("assignment_by_weekday", _WEEKDAY, _PCT)
expect("assignment_by_month", _MONTH, _PCT)
expect("experiment_temporal_balance", f"""
SELECT 'weekday' AS dimension, max(chi2) AS chi2, max(dof) AS dof, max(p_value) AS p_value
FROM ({_WEEKDAY})
UNION ALL SELECT 'month', max(chi2), max(dof), max(p_value) FROM ({_MONTH})""", "chi2 p_value")
expect("rare_category_bucket", """
SELECT loan_id, if(count(*) OVER (PARTITION BY seg) < 150, 'OTHER', seg) AS segment
FROM (SELECT loan_id, concat_ws('/', province, acquisition_channel, device_os) AS seg
      FROM le WHERE is_disbursed = 1)""")
CTES["st"] = """
SELECT tip_test_group AS stratum,
       avg(revenue) FILTER (WHERE price_test_group = 'B')
         - avg(revenue) FILTER (WHERE price_test_group = 'A') AS effect,
       var_samp(revenue) FILTER (WHERE price_test_group = 'A')
           / count(*) FILTER (WHERE price_test_group = 'A')
         + var_samp(revenue) FILTER (WHERE price_test_group = 'B')
           / count(*) FILTER (WHERE price_test_group = 'B') AS variance,
       count(*) AS n
FROM le WHERE is_disbursed = 1 AND price_test_group <> 'not_assigned' GROUP BY ALL"""
_NAMES["st"] = re.compile(r"FROM st\b")
expect("experiment_stratified", """
SELECT stratum, effect, sqrt(variance) AS std_err, n FROM st
UNION ALL SELECT 'pooled', sum(effect / variance) / sum(1 / variance), sqrt(1 / sum(1 / variance)),
                 sum(n)::BIGINT FROM st WHERE variance > 0""", "effect std_err")

expect("views_by_name", """
SELECT province, risk_score_decile, count(*) AS loans, sum(is_default)::BIGINT AS defaults,
       count(one) AS assignments
FROM lc JOIN uc USING (user_id) LEFT JOIN (SELECT DISTINCT user_id, 1 AS one FROM ab) USING (user_id)
GROUP BY ALL""")

# adjusted effects
TERMS = {"tip_test_group": "control", "price_test_group": "A", "risk_score_decile": None, "province": None}


def _effect_rows(metric: str, unit: str, fit: str, scale: int) -> str:
    return (
        f"SELECT '{metric}' AS metric, split_part(term, '=', 2) AS tip_variant, {scale} * effect AS effect,"
        f" {scale} * ci_low AS ci_low, {scale} * ci_high AS ci_high, p_value, '{unit}' AS unit"
        f" FROM ({fit}) WHERE term LIKE 'tip_test_group=%'"
    )


OLS = _union([
    _effect_rows("Mean tip ($)", "$", ols_hc1("ef", "tip_amount", TERMS, "amount"), 1),
    _effect_rows("RPDL ($)", "$", ols_hc1("ef", "revenue", TERMS, "amount"), 1),
])
LOGIT = _union([
    _effect_rows("Take-rate (AME)", "pp", logit_ame("ef", "tip_taken", TERMS, "amount"), 100),
    _effect_rows("Default (AME)", "pp", logit_ame("ef", "is_default", TERMS, "amount"), 100),
])
FITTED = "effect ci_low ci_high p_value"
expect("experiment_ols_hc1", OLS, FITTED)
expect("experiment_logit_ame", LOGIT, FITTED)
expect("experiment_interaction", f"""
SELECT split_part(term, '=', 2) AS combination, effect, std_err, p_value
FROM ({ols_hc1("ei", "revenue", {"arm": "A_control", "risk_score_decile": None, "province": None}, "amount")})
WHERE term LIKE 'arm=%'""", "effect std_err p_value")
_SHOWN = ", ".join(
    f"CASE WHEN unit = 'pp' THEN round(round({c}, 3), 1) ELSE round(round({c}, 3), 2) END AS {c}"
    for c in ("effect", "ci_low", "ci_high")
)
expect("experiment_effects", f"""
SELECT metric, tip_variant, {_SHOWN}, round(p_value, 3) AS p_value, unit FROM ({_union([OLS, LOGIT])})""")



_FIT = logit_ame("hd", "tip_taken", {"tip_test_group": "control", "price_test_group": "A", "province": None},
                 "amount_k", 12, "risk_score_decile")
_PP = ", ".join(f"CASE WHEN fits THEN round(100 * {c}, 2) END AS {c}_pp" for c in ("effect", "ci_low", "ci_high"))
BY_DECILE = f"""
SELECT stratum AS risk_decile, split_part(term, '=', 2) AS tip_variant, {_PP},
       CASE WHEN fits THEN round(p_value, 3) END AS p_value, n, fits AS converged,
       CASE WHEN NOT fits THEN 'no finite optimum' END AS reason
FROM (SELECT *, moved < 1e-6 AS fits FROM ({_FIT}))
WHERE term IN ('tip_test_group=persuasive', 'tip_test_group=social_proof')"""
expect("experiment_heterogeneity", BY_DECILE)
expect("experiment_flags", f"""
SELECT risk_decile, tip_variant, effect_pp, ci_low_pp, ci_high_pp, p_value, p_value < 0.05 AS is_sig,
       CASE WHEN effect_pp > 0 THEN 'positive' WHEN effect_pp IS NOT NULL THEN 'negative' END AS direction,
       abs(effect_pp) > 5 AS large_effect, n, converged, reason FROM ({BY_DECILE})""")

# dashboard
expect("dash_user_funnel", "FROM du")
expect("dash_experiment_loans", "FROM de", "amount tip_amount revenue")
expect("dash_filter_values", """
SELECT DISTINCT filter, value FROM (
  SELECT unnest([{'filter': 'province', 'value': province},
                 {'filter': 'device_os', 'value': device_os},
                 {'filter': 'acquisition_channel', 'value': acquisition_channel},
                 {'filter': 'signup_month', 'value': signup_month::VARCHAR}], recursive := true)
  FROM du)""")
expect("dash_filtered_funnel", "FROM du WHERE (province, device_os) = ('ASIA', 'ios')")
expect("dash_filtered_experiments", """
SELECT * FROM de WHERE user_id IN (SELECT user_id FROM du
                                   WHERE province = 'ASIA' AND device_os = 'ios')""",
       "amount tip_amount revenue")
expect("dash_funnel_stages", """
SELECT 'Signups' AS stage, count(*) AS users FROM du
UNION ALL SELECT 'Bank Linked', sum(bank_linked_flag)::BIGINT FROM du
UNION ALL SELECT 'Loan Requested', sum(requested_loan)::BIGINT FROM du
UNION ALL SELECT 'Loan Approved', sum(approved_loan)::BIGINT FROM du
UNION ALL SELECT 'Loan Disbursed', sum(disbursed_loan)::BIGINT FROM du
UNION ALL SELECT 'Loan Repaid', sum(repaid_loan)::BIGINT FROM du""")
expect("dash_kpis", """
SELECT count(*) AS total_users, 100 * avg(bank_linked_flag) AS bank_link_rate,
       100 * avg(requested_loan) AS request_rate,
       100.0::DOUBLE * sum(approved_loan) / sum(requested_loan) AS approval_rate FROM du""",
       "bank_link_rate request_rate approval_rate")
expect("dash_experiment_kpis", """
SELECT count(*) AS total_loans, avg(revenue) AS avg_revenue, 100 * avg(tip_taken) AS tip_take_rate,
       avg(amount) AS avg_amount FROM de""", "avg_revenue tip_take_rate avg_amount")
expect("dash_tip_table", """
SELECT tip_test_group AS variant, count(*) AS total_loans, sum(tip_taken)::BIGINT AS tips_taken,
       avg(tip_amount) AS avg_tip_amount, avg(revenue) AS avg_revenue,
       100 * avg(tip_taken) AS tip_take_rate_pct FROM de GROUP BY ALL""",
       "avg_tip_amount avg_revenue tip_take_rate_pct")
expect("dash_price_table", """
SELECT price_test_group AS variant, count(*) AS total_loans, avg(revenue) AS avg_revenue,
       sum(revenue) AS total_revenue, avg(amount) AS avg_loan_amount FROM de GROUP BY ALL""",
       "avg_revenue total_revenue avg_loan_amount", 4)
_PRICES = ["A", "B", "not_assigned"]
_CELLS = ", ".join(
    f"avg(revenue) FILTER (WHERE price_test_group = '{p}') AS {p}_revenue,"
    f" 100 * avg(tip_taken) FILTER (WHERE price_test_group = '{p}') AS {p}_take_rate,"
    f" nullif(count(*) FILTER (WHERE price_test_group = '{p}'), 0) AS {p}_loans" for p in _PRICES
)
_MEANS = ", ".join(f"{p}_revenue" for p in _PRICES)
expect("dash_experiment_matrix", f"""
SELECT *, (min_revenue + max_revenue) / 2 AS mid_revenue
FROM (SELECT *, min(least({_MEANS})) OVER () AS min_revenue,
             max(greatest({_MEANS})) OVER () AS max_revenue
      FROM (SELECT tip_test_group, {_CELLS} FROM de GROUP BY tip_test_group))""",
       " ".join(f"{p}_revenue {p}_take_rate" for p in _PRICES)
       + " min_revenue max_revenue mid_revenue")

# transactions, history, risk base
for _d in (14, 30):
    expect(f"txn_rolling_{_d}d", f"""
SELECT txn_id, user_id, posted_date_utc, inflow_sum_{_d}d, spend_sum_{_d}d,
       essentials_spend_sum_{_d}d, rent_spend_sum_{_d}d, neg_txn_count_{_d}d, txn_count_{_d}d,
       inflow_std_{_d}d, inflow_mean_{_d}d, bal_std_{_d}d, bal_mean_{_d}d FROM tr""", _trailing(_d))
expect("days_since_payroll", "SELECT txn_id, days_since_last_payroll FROM tr")
expect("transactions_for_risk", "FROM tr", _trailing(14, 30))
expect("prior_approved_history", """
SELECT c.loan_id, count(p.loan_id) AS n_approved,
       coalesce(sum(p.late_days) FILTER (WHERE p.is_disbursed = 1), 0)::BIGINT AS late_sum,
       coalesce(sum(p.amount) FILTER (WHERE p.is_disbursed = 1), 0) AS amount_sum
FROM lc c LEFT JOIN lc p ON p.user_id = c.user_id AND p.approved_at < c.approved_at
GROUP BY c.loan_id""", "amount_sum")
expect("prior_unapproved_history", """
SELECT c.loan_id, count(p.loan_id) AS n_unapproved
FROM lc c LEFT JOIN lc p ON p.user_id = c.user_id AND p.is_approved = 0
                        AND p.requested_at < c.approved_at
GROUP BY c.loan_id""")
expect("user_prior_loan_perf", "FROM pp", _PRIOR)
expect("prior_default_flag", "FROM pd")
expect("txn_snapshot_asof", "FROM sn", _trailing(14, 30))
expect("risk_derived_features", "FROM sr", _RATIOS, 5)
expect("risk_model_base", "FROM rb",
       f"amount baseline_risk_score {_PRIOR} {_trailing(14, 30)} {_RATIOS}", 5)

# data quality
expect("dq_row_counts", "FROM qb")
expect("dq_canonical_view_counts", "FROM qv")
expect("dq_row_count_reconciliation", "FROM qr")
expect("dq_null_key_checks", "FROM qn")
expect("dq_referential_integrity", "FROM qo")
expect("dq_transaction_validations", "FROM qt")
expect("dq_loan_validations", "FROM ql")
expect("dq_user_validations", "FROM qu")
expect("dq_session_validations", "FROM qs")
expect("dq_ab_test_validations", "FROM qa")
expect("dq_distribution_checks", "FROM qd")
expect("dq_risk_model_coverage", "FROM qc")
expect("dq_funnel_completeness", "FROM qf")
expect("dq_business_rules", "FROM qx")
expect("dq_summary_report", "FROM qz")
expect("dq_dashboard", """
SELECT 'CANONICAL VIEWS' AS section, 'Total Views Created' AS metric,
       (SELECT count(*) FROM qv)::DOUBLE AS value
UNION ALL SELECT 'DATA COVERAGE', 'Risk Model Coverage %',
       (SELECT round(100.0 * avg(txn_info_found), 1) FROM rb)
UNION ALL SELECT 'DATA QUALITY', 'Failed Checks',
       (SELECT coalesce(sum(check_count) FILTER (WHERE status = 'FAIL'), 0) FROM qz)
UNION ALL SELECT 'DATA QUALITY', 'Passed Checks',
       (SELECT coalesce(sum(check_count) FILTER (WHERE status = 'PASS'), 0) FROM qz)""")
expect("dq_report", """
SELECT category, count(*) AS total_checks,
       count(*) FILTER (WHERE status = 'FAIL') AS failed_checks,
       count(*) FILTER (WHERE status = 'WARN') AS warned_checks,
       count(*) FILTER (WHERE status = 'PASS') AS passed_checks
FROM qall GROUP BY category""")
expect("dq_failed_checks", "FROM qall WHERE status = 'FAIL'", "measured")
expect("dq_overall_status", """
SELECT if(f = 0, 'PASS', 'FAIL') AS overall_status, f AS total_failed_checks,
       n AS total_check_categories, if(sf = 0, 'PASS', 'FAIL') AS strict_status,
       sf AS strict_failed_checks
FROM (SELECT count(*) FILTER (WHERE status = 'FAIL') AS f, count(*) AS n,
             (SELECT count(*) FROM qall WHERE status = 'FAIL') AS sf FROM qz)""")
expect("dq_load_checks", _union([
    f"SELECT '{label}' AS check_name, count(*) AS invalid_records,"
    f" if(count(*) = 0, 'PASS', 'FAIL') AS status FROM {t} x WHERE {cond}"
    for label, t, cond in [
        ("Users have valid signup dates", "ub", "signup_at IS NULL"),
        ("Transactions have valid amounts", "tb", "amount IS NULL"),
        ("Loans have valid user references", "lb",
         "NOT EXISTS (FROM ub WHERE ub.user_id = x.user_id)"),
        ("Sessions have valid user references", "sb",
         "NOT EXISTS (FROM ub WHERE ub.user_id = x.user_id)")]
]))
expect("dq_contracts", _union([
    f"SELECT '{name}' AS contract, count(*) AS violation_count,"
    f" if(count(*) = 0, 'PASS', 'FAIL') AS status FROM {t} WHERE {cond}"
    for name, t, cond in [
        ("amount_within_cap", "lc", "NOT (amount > 0 AND amount <= 250)"),
        ("timestamps_in_order", "lc",
         "approved_at < requested_at OR disbursed_at < approved_at"
         " OR due_date::TIMESTAMP <= disbursed_at"),
        ("disbursed_within_limit", "lc", "disbursed_at > approved_at + INTERVAL 24 HOUR"),
        ("score_in_unit_range", "uc", "baseline_risk_score < 0 OR baseline_risk_score > 1"),
        ("score_null_share", "uc", "baseline_risk_score IS NULL")]
]))


# score evaluation on the given risk score
CTES["xs"] = """
SELECT l.loan_id, l.user_id, l.amount, l.revenue, l.days_to_repay, l.is_default AS y,
       l.approved_at_utc, u.baseline_risk_score AS s, u.province, u.device_os
FROM lc l JOIN uc u ON u.user_id = l.user_id WHERE l.approved_at IS NOT NULL"""
CTES["xc"] = """
SELECT DISTINCT s,
       (sum(y) OVER down)::DOUBLE AS tp, (sum(1 - y) OVER down)::DOUBLE AS fp,
       (sum(y) OVER ())::DOUBLE AS pos, (sum(1 - y) OVER ())::DOUBLE AS neg
FROM xs WINDOW down AS (ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _auc(group: str = "") -> str:
    """Rank-sum form: mean rank of the positives, ties at their middle rank."""
    part = f"PARTITION BY {group}" if group else ""
    return f"""
SELECT {group + ',' if group else ''} count(*) AS n_samples,
       (sum(mid) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE)
         / nullif(sum(y) * sum(1 - y), 0)::DOUBLE AS auc,
       (sum(prec) FILTER (WHERE y = 1) / nullif(sum(y), 0))::DOUBLE AS ap
FROM (SELECT *, rank() OVER ({part} ORDER BY s)
                + (count(*) OVER ({part + ',' if part else 'PARTITION BY'} s) - 1) / 2.0::DOUBLE
                  AS mid,
             (sum(y) OVER dn)::DOUBLE / count(*) OVER dn AS prec
      FROM xs WINDOW dn AS ({part} ORDER BY s DESC RANGE UNBOUNDED PRECEDING))
{'GROUP BY ' + group if group else ''}"""


_NAMES.update({
    n: re.compile(rf"\b(?:FROM|JOIN)\s*\(?\s*{n}\b|,\s*{n}\b") for n in ("xs", "xc")
})
expect("risk_eval", f"""
SELECT auc, ap, brier, log_loss FROM ({_auc()}),
  (SELECT avg((s - y) * (s - y)) AS brier,
          avg(-ln(if(y = 1, s, 1 - s))) AS log_loss
   FROM (SELECT y, least(greatest(s, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS s FROM xs))""",
       "auc ap brier log_loss")
expect("risk_roc", "SELECT s AS threshold, fp / neg AS fpr, tp / pos AS tpr FROM xc"
       " UNION ALL SELECT NULL, 0, 0",
       "threshold fpr tpr")
expect("risk_pr", "SELECT s AS threshold, tp / (tp + fp) AS precision, tp / pos AS recall FROM xc"
       " UNION ALL SELECT NULL, 1, 0",
       "threshold precision recall")
expect("risk_calibration", """
SELECT list_count(list_filter(e, lambda q: s > q))::INT AS bin, count(*) AS n,
       avg(s) AS prob_pred, avg(y) AS prob_true
FROM xs, (SELECT quantile_cont(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM xs)
GROUP BY 1""", "prob_pred prob_true")
expect("risk_stability", f"""
SELECT 'province' AS segment, province AS value, n_samples, round(auc, 3) AS auc,
       round(ap, 3) AS ap FROM ({_auc('province')}) WHERE n_samples >= 50
UNION ALL SELECT 'device_os', device_os, n_samples, round(auc, 3), round(ap, 3)
FROM ({_auc('device_os')}) WHERE n_samples >= 50""")
expect("risk_operating_points", """
SELECT name, t AS threshold, avg((s < t)::INT) AS approval_rate,
       avg(y) FILTER (WHERE s < t) AS def_rate_approved,
       avg(y) FILTER (WHERE s >= t) AS def_rate_declined,
       (count(*) FILTER (WHERE s >= t AND y = 1))::DOUBLE / sum(y) AS sensitivity,
       (count(*) FILTER (WHERE s < t AND y = 0))::DOUBLE / sum(1 - y) AS specificity,
       avg(y) FILTER (WHERE s >= t) AS precision
FROM xs, (
  SELECT 'Fixed Approval ' || (q * 100)::INT || '%' AS name, v AS t
  FROM (SELECT unnest([0.3, 0.35, 0.4]) AS q,
               unnest(quantile_cont(s, [0.3, 0.35, 0.4])) AS v FROM xs)
  UNION ALL
  SELECT 'Fixed Default ≤ ' || (target * 100)::INT || '%', t
  FROM (SELECT target, t FROM (SELECT unnest([0.45, 0.5, 0.55]) AS target),
             (SELECT DISTINCT s AS t, rank() OVER (ORDER BY s) - 1 AS ok,
                     (sum(y) OVER ()) - (sum(y) OVER (ORDER BY s DESC RANGE UNBOUNDED PRECEDING))
                       AS bad FROM xs
              UNION ALL SELECT 1.0, count(*) FILTER (WHERE s < 1),
                               sum(y) FILTER (WHERE s < 1) FROM xs)
        WHERE ok > 0 AND bad::DOUBLE / ok <= target
        QUALIFY row_number() OVER (PARTITION BY target ORDER BY ok DESC, t DESC) = 1))
GROUP BY name, t""",
       "threshold approval_rate def_rate_approved def_rate_declined sensitivity specificity"
       " precision")
expect("risk_features", _union([
    f"SELECT '{c}' AS feature, '{kind}' AS kind, count({c}) AS filled_rows FROM rb"
    for kind, cols in (
        ("numeric", "baseline_risk_score prior_loan_flag prior_loan_default_flag"
         f" {_PRIOR} prior_approved_loans_count prior_unapproved_loans_count txn_info_found"
         " days_since_last_payroll neg_txn_count_14d txn_count_14d neg_txn_count_30d"
         f" txn_count_30d {_trailing(14, 30)} {_RATIOS}"),
        ("categorical", "province device_os acquisition_channel payroll_frequency"))
    for c in cols.split()
]))
_NUMERIC = ("baseline_risk_score prior_loan_flag prior_loan_default_flag"
            f" {_PRIOR} prior_approved_loans_count prior_unapproved_loans_count txn_info_found"
            " days_since_last_payroll neg_txn_count_14d txn_count_14d neg_txn_count_30d"
            f" txn_count_30d {_trailing(14, 30)} {_RATIOS}").split()
_DUMMIES = {
    "province": ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
    "device_os": ["ios"],
    "acquisition_channel": ["building", "furniture", "household", "machinery"],
    "payroll_frequency": ["irregular", "monthly", "semimonthly", "weekly"],
}
_NUDGE = f"{0.00123 * 10.0 ** -5!r}::DOUBLE"
expect("risk_imputed", "SELECT loan_id, is_default, " + ", ".join(
    [f"round(ifnull({c}, (SELECT quantile_cont({c}, 0.5) FROM rb)) + {_NUDGE}, 5)::DOUBLE AS {c}"
     for c in _NUMERIC]
    + [f"round(({c} = '{v}')::INT + {_NUDGE}, 5)::DOUBLE AS \"{c}_{v}\""
       for c, vs in _DUMMIES.items() for v in vs]
) + " FROM rb")
expect("risk_split", """
SELECT loan_id, is_default,
       (('0x' || substr(md5(is_default || ':' || loan_id), 1, 8))::BIGINT % 100 < 30)::INT
         AS is_test
FROM lc WHERE approved_at IS NOT NULL""")
expect("policy_limits", """
SELECT loan_id, q AS risk_quartile, [200.0::DOUBLE, 150, 100, 75][q] AS loan_limit
FROM (SELECT loan_id, ntile(4) OVER (ORDER BY s NULLS LAST, loan_id)::INT AS q FROM xs)""")
expect("policy_pnl", """
SELECT policy, t AS threshold, count(*) AS approved_loans, sum(revenue) AS revenue,
       sum(s * amount * 0.85::DOUBLE) AS expected_loss,
       sum(0.3::DOUBLE + amount * 0.012::DOUBLE) AS processing_cost,
       sum(amount * 0.12::DOUBLE * d / 365.0::DOUBLE) AS capital_cost,
       sum(revenue - s * amount * 0.85::DOUBLE - (0.3::DOUBLE + amount * 0.012::DOUBLE)
           - amount * 0.12::DOUBLE * d / 365.0::DOUBLE) AS expected_pnl
FROM (SELECT *, ifnull(days_to_repay, 14) AS d FROM xs),
     (VALUES ('approve all', 1.1::DOUBLE), ('score below 0.5', 0.5), ('score below 0.35', 0.35))
       AS p(policy, t)
WHERE s < t GROUP BY policy, t""",
       "threshold revenue expected_loss processing_cost capital_cost expected_pnl", 4)
expect("drift_psi", """
SELECT *, if(psi > 0.25, 'critical', if(psi > 0.1, 'warning', 'ok')) AS status
FROM (SELECT bucket, share_before, share_after,
             (share_after - share_before) * ln(share_after / share_before) AS psi_part,
             sum((share_after - share_before) * ln(share_after / share_before)) OVER () AS psi
      FROM (SELECT list_count(list_filter(e, lambda q: s > q))::INT AS bucket,
                   greatest(count_if(early) / (SELECT count(*) FROM xs
                     WHERE approved_at_utc < TIMESTAMP '2024-01-20'), 0.0001) AS share_before,
                   greatest(count_if(NOT early) / (SELECT count(*) FROM xs
                     WHERE approved_at_utc >= TIMESTAMP '2024-01-20'), 0.0001) AS share_after
            FROM (SELECT s, approved_at_utc < TIMESTAMP '2024-01-20' AS early FROM xs),
                 (SELECT quantile_cont(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e
                  FROM xs WHERE approved_at_utc < TIMESTAMP '2024-01-20')
            GROUP BY 1))""", "share_before share_after psi_part psi")


# further risk features
CTES["xd"] = """
SELECT user_id, posted_date AS d, sum(inflow_amount_pos) AS inflow, sum(spend_amount_pos) AS spend,
       coalesce(sum(spend_amount_pos) FILTER (WHERE spend_bucket = 'discretionary'), 0) AS discr,
       arg_max(balance_after, txn_id) AS eod, min(balance_after) AS low,
       bool_or(is_payroll = 1) AS paid
FROM tc GROUP BY ALL"""
CTES["xg"] = """
SELECT user_id, d, d - lag(d) OVER (PARTITION BY user_id ORDER BY d) AS gap FROM xd WHERE paid"""


def _range_features(d: int) -> str:
    def over(expr: str, low: int, high: int) -> str:
        return (f"(SELECT {expr} FROM xd p WHERE p.user_id = x.user_id"
                f" AND p.d BETWEEN x.d - {high} AND x.d - {low})")

    def now(expr: str) -> str:
        return over(expr, 0, d - 1)

    return f"""
       {now('avg(eod)')} AS avg_eod_balance_{d}d, {now('min(low)')} AS min_balance_{d}d,
       {now('count(*) FILTER (WHERE low < 0)')} AS overdraft_days_{d}d,
       {now('sum(spend) / nullif(sum(inflow), 0)')} AS outflow_to_inflow_{d}d,
       {now('sum(discr) / nullif(sum(spend), 0)')} AS discretionary_share_{d}d,
       {now('sum(inflow - spend)')} - ifnull({over('sum(inflow - spend)', d, 2 * d - 1)}, 0)
         AS net_cf_momentum_{d}d,
       {now('avg(eod) / nullif(sum(spend), 0)')} AS balance_to_outflow_{d}d,
       {now('avg(eod) / nullif(sum(inflow), 0)')} AS balance_to_inflow_{d}d"""


CTES["xf"] = f"""
SELECT x.user_id, x.d::TIMESTAMP AS day_at,
       (SELECT quantile_cont(gap, 0.5) FROM xg g WHERE g.user_id = x.user_id AND g.d <= x.d)
         AS median_payroll_gap_days, {_range_features(14)}, {_range_features(30)}
FROM xd x"""
CTES["xh"] = """
SELECT c.loan_id, c.user_id, c.approved_at, avg(p.is_repaid) AS hist_repay_rate,
       avg(p.is_default) AS hist_default_rate,
       coalesce(sum(p.is_default), 0)::BIGINT AS hist_default_count,
       avg(p.late_days) AS hist_avg_late_days, count(p.late_days) AS hist_avg_late_days_count
FROM lc c LEFT JOIN lc p ON p.user_id = c.user_id AND p.approved_at < c.approved_at
                        AND p.is_disbursed = 1
WHERE c.approved_at IS NOT NULL GROUP BY ALL"""
_NAMES.update({
    n: re.compile(rf"\b(?:FROM|JOIN)\s*\(?\s*{n}\b|,\s*{n}\b") for n in ("xd", "xg", "xf", "xh")
})
expect("risk_extra_features", """
SELECT h.* EXCLUDE (approved_at), f.* EXCLUDE (user_id, day_at)
FROM xh h ASOF LEFT JOIN xf f ON h.user_id = f.user_id AND h.approved_at > f.day_at""",
       "hist_repay_rate hist_default_rate hist_avg_late_days median_payroll_gap_days " + " ".join(
           f"avg_eod_balance_{d}d min_balance_{d}d outflow_to_inflow_{d}d"
           f" discretionary_share_{d}d net_cf_momentum_{d}d balance_to_outflow_{d}d"
           f" balance_to_inflow_{d}d" for d in (14, 30)), 5)
