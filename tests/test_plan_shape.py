"""What the physical plans must not hold, with broadcasting off as for large sides."""

import re

import pytest

from __spark_entry__ import oracle_sql, queries

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


@pytest.fixture(scope="module", autouse=True)
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_no_cross_joins_and_no_python(spark, sf_dir, name):
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [f for f in FORBIDDEN if f in plan]


@pytest.mark.parametrize("name,key", [
    ("sessions_clean", "session_id"), ("loans_clean", "user_id"),
    ("prior_default_flag", "user_id"), ("transactions_for_risk", "txn_id"),
])
def test_wide_rows_meet_in_small_windows_only(spark, sf_dir, name, key):
    """No window partitioned by a user or session alone runs over fact rows.

    Such windows are fine above an aggregate, which leaves a row per calendar unit.
    """
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" not in line:
            continue
        partition, _ = re.findall(r"\[([^\[\]]*)\]", line)[-2:]
        names = {c.split("#")[0].strip() for c in partition.split(",")}
        alone = names & {"user_id", "session_id", "__key"} and "__cell" not in names
        assert not alone or "HashAggregate" in "\n".join(lines[i + 1:])


@pytest.mark.parametrize("name,columns", [
    ("metric_bank_link_rate", ["c_custkey", "c_nationkey"]),
    ("metric_approval_disbursement", ["o_orderkey", "o_custkey", "o_orderstatus"]),
    ("days_since_payroll", ["event_id", "ts", "user_id", "event_type"]),
])
def test_scans_read_needed_columns_only(spark, sf_dir, name, columns):
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet [" in line]
    read = {c.split("#")[0] for line in scans
            for c in line.split("FileScan parquet [")[1].split("]")[0].split(",")}
    fact = {c for c in read if not c.startswith(("n_", "r_"))}
    assert fact <= set(columns), fact
