"""Column contracts of the five base tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "string": T.StringType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(),
}


def struct_of(spec: str) -> T.StructType:
    # built without a session, which StructType.fromDDL would need
    pairs = [column.split() for column in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


USERS = struct_of(
    "user_id bigint, signup_at timestamp_ntz, province string, device_os string,"
    " acquisition_channel string, bank_linked_at timestamp_ntz, payroll_frequency string,"
    " baseline_risk_score double, fico_band string"
)
SESSIONS = struct_of(
    "event_id string, user_id bigint, session_id string, ts timestamp_ntz,"
    " event_name string, screen string, properties_json string"
)
TRANSACTIONS = struct_of(
    "txn_id string, user_id bigint, posted_date date, amount double, direction string,"
    " mcc string, category string, balance_after double, is_payroll int"
)
LOANS = struct_of(
    "loan_id string, user_id bigint, requested_at timestamp_ntz, approved_at timestamp_ntz,"
    " disbursed_at timestamp_ntz, due_date date, repaid_at timestamp_ntz, amount double,"
    " fee double, tip_amount double, instant_transfer_fee double, status string,"
    " late_days int, chargeoff_flag int, autopay_enrolled int, principal_repaid double,"
    " writeoff_amount double, price_variant string, tip_variant string"
)
ASSIGNMENTS = struct_of(
    "assignment_id string, user_id bigint, experiment_name string, variant string,"
    " assigned_at timestamp_ntz"
)

# table name -> (file, schema, primary key)
TABLES = {
    "dim_users": ("users.csv", USERS, "user_id"),
    "fct_sessions": ("sessions.csv", SESSIONS, "event_id"),
    "fct_transactions": ("transactions.csv", TRANSACTIONS, "txn_id"),
    "fct_loans": ("loans.csv", LOANS, "loan_id"),
    "ab_assignments": ("ab_assignments.csv", ASSIGNMENTS, "assignment_id"),
}

# columns a dataset must carry to be accepted (fixed values)
REQUIRED_COLUMNS = {
    "dim_users": ["user_id", "signup_at", "province", "device_os"],
    "fct_transactions": ["txn_id", "user_id", "amount", "category"],
    "fct_loans": ["loan_id", "user_id", "amount", "status"],
    "fct_sessions": ["event_id", "user_id", "event_name"],
    "ab_assignments": ["assignment_id", "user_id", "experiment_name"],
}

# fixed values: experiment names and arms
PRICE_TEST = "PriceTest_2025Q2"
TIP_TEST = "TipPrompt_2025Q2"
PRICE_ARMS = ["A", "B"]
TIP_ARMS = ["control", "persuasive", "social_proof"]
