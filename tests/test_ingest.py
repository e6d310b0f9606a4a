"""CSV scan, duplicate repair, typed load, sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lendlens.plans import jobs, quality
from lendlens.plans.catalog import LendingCatalog
from lendlens.schemas import TABLES
from lendlens.sources import ingest, quoted_csv, snapshots

USERS = """user_id,signup_at,province,device_os,acquisition_channel,bank_linked_at,payroll_frequency,baseline_risk_score,fico_band
1,2025-01-01T10:00:00,ON,ios,email,2025-01-02 09:30:00.250000,weekly,0.25,640-679
2,2025-01-03 00:00:00,BC,android,organic,,monthly,0.5,580-639
"""
TRANSACTIONS = """txn_id,user_id,posted_date,amount,direction,mcc,category,balance_after,is_payroll
a,1,2025-01-05,100.5,inflow,0000,payroll,20,1
b,1,2025-01-06,-3,outflow,6011,rent,17,0
a,2,2025-01-05,-1,outflow,6011,dining,-4,0
a,2,2025-01-07,-2,outflow,6011,dining,-6,0
"""


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "users.csv").write_text(USERS)
    (tmp_path / "transactions.csv").write_text(TRANSACTIONS)
    return str(tmp_path)


def test_missing_directory(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ingest.load_csv_files(spark, str(tmp_path / "nowhere"))


def test_scan_repairs_duplicates_and_lists_missing(spark, folder):
    loaded, failed = ingest.load_csv_files(spark, folder)
    assert set(loaded) == {"dim_users", "fct_transactions"}
    assert set(failed) == set(TABLES) - set(loaded)
    ids = [r["txn_id"] for r in loaded["fct_transactions"].collect()]
    assert sorted(ids) == ["a-dup-0", "a-dup-2", "a-dup-3", "b"]


def test_positions_span_file_splits(spark, tmp_path):
    # many splits of one file: the position is that of the row in the file
    rows = [f"k{i % 50},{i}" for i in range(5000)]
    (tmp_path / "t.csv").write_text("txn_id,n\n" + "\n".join(rows) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = ingest.read_csv(spark, str(tmp_path / "t.csv"))
        assert df.rdd.getNumPartitions() > 3
        path = str(tmp_path / "t.csv")
        fixed = ingest.repair_file_duplicates(spark, path, "txn_id", "append_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(fixed) == 5000
    assert all(r["txn_id"] == f"k{int(r['n']) % 50}-dup-{r['n']}" for r in fixed)


def test_typed_load(spark, folder, tmp_path):
    loaded, _ = ingest.load_csv_files(spark, folder)
    target = str(tmp_path / "db")
    assert ingest.write_tables(loaded, target) == {"dim_users": 2, "fct_transactions": 4}
    tables = ingest.read_tables(spark, target)
    users = {r["user_id"]: r for r in tables["dim_users"].collect()}
    assert users[1]["signup_at"] == dt.datetime(2025, 1, 1, 10)
    assert users[1]["bank_linked_at"] == dt.datetime(2025, 1, 2, 9, 30, 0, 250000)
    assert users[2]["bank_linked_at"] is None
    txns = tables["fct_transactions"]
    assert txns.where("mcc = '0000'").count() == 1  # codes keep their zeros
    assert txns.schema["posted_date"].dataType.typeName() == "date"


def test_a_repeated_key_is_not_loaded(spark, folder, tmp_path):
    text = ingest.read_csv(spark, f"{folder}/users.csv")
    got = ingest.write_tables({"dim_users": text.union(text)}, str(tmp_path / "db2"))
    assert got == {"dim_users": -1}


def test_unreadable_text_fails_the_table(spark, folder, tmp_path):
    text = ingest.read_csv(spark, f"{folder}/users.csv").withColumn(
        "baseline_risk_score", F.lit("high"))
    assert ingest.write_tables({"dim_users": text}, str(tmp_path / "db3")) == {"dim_users": -1}


def test_load_job_and_quality_suite(spark, folder, tmp_path):
    target = str(tmp_path / "db4")
    loaded = jobs.load(spark, folder, target)
    assert loaded["dim_users"] == 2 and loaded["fct_loans"] == -1
    catalog = LendingCatalog(ingest.read_tables(spark, target))
    out = jobs.run_quality_suite(catalog, str(tmp_path / "reports"), "2025-06-01 00:00:00")
    assert out["overall_status"] == "PASS" and out["exit_code"] == 0
    assert out["strict_failed_checks"] == 0 and "failed_checks" not in out["files"]
    late = jobs.run_quality_suite(catalog, str(tmp_path / "late"), "2025-01-02 00:00:00")
    assert late["exit_code"] == 1
    failed = spark.read.option("header", True).csv(late["files"]["failed_checks"])
    assert [r["check_name"] for r in failed.collect()] == ["users_future_signup_dates"]


def test_columns_match_by_name(spark, folder):
    text = ingest.read_csv(spark, f"{folder}/users.csv")
    turned = text.select(*reversed(text.columns))
    assert ingest.coerce(turned, "dim_users").collect() == ingest.coerce(text, "dim_users").collect()


def test_required_columns(spark, folder):
    text = ingest.read_csv(spark, f"{folder}/users.csv").drop("province", "device_os")
    row = ingest.required_columns({"dim_users": text}).first()
    assert (row["status"], row["missing_columns"]) == ("FAIL", "device_os,province")


def test_row_counts_report_unreadable_tables(spark, folder):
    users = ingest.read_csv(spark, f"{folder}/users.csv")
    broken = users.where(F.raise_error(F.lit("unreadable")).isNull())
    assert quality.table_row_counts({"ok": users, "broken": broken}) == {"ok": 2, "broken": -1}


def test_sinks(spark, tmp_path):
    checks = spark.createDataFrame(
        [("c", "x", 1.0, "FAIL"), ("c", "y", 0.0, "PASS"), ("d", "z", 3.0, None)],
        "category string, check_name string, measured double, status string",
    )
    ingest.write_report_json(quality.report(checks), str(tmp_path / "report"))
    lines = [json.loads(line) for f in (tmp_path / "report").glob("*.json")
             for line in f.read_text().splitlines()]
    assert {r["category"]: r["failed_checks"] for r in lines} == {"c": 1, "d": 0}
    assert ingest.write_failed_csv(checks, str(tmp_path / "failed"))
    back = spark.read.option("header", True).csv(str(tmp_path / "failed"))
    assert [r["check_name"] for r in back.collect()] == ["x"]
    assert not ingest.write_failed_csv(checks.where("status = 'PASS'"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_a_row_with_too_many_fields_fails_its_table(spark, tmp_path):
    (tmp_path / "users.csv").write_text(USERS + "3,2025-01-03 00:00:00,BC,ios,email,,weekly,0.5,580-639,extra\n")
    (tmp_path / "transactions.csv").write_text(TRANSACTIONS)
    loaded, failed = ingest.load_csv_files(spark, str(tmp_path))
    assert "dim_users" in failed and set(loaded) == {"fct_transactions"}


def test_quoted_line_breaks_and_short_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,note,n\n1,"two\nlines, ""quoted""",3\n2,short\n')
    rows = sorted(tuple(r) for r in ingest.read_csv(spark, str(tmp_path / "t.csv")).collect())
    assert rows == [("1", 'two\nlines, "quoted"', "3"), ("2", "short", None)]


def _many_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.mark.parametrize("size", [1 << 27, 4096, 700])
def test_quoted_line_breaks_in_many_splits(spark, tmp_path, size):
    """Equal to the reader that takes a file in one task, wherever the splits fall."""
    import csv
    import random

    rng = random.Random(size)
    parts = ["a", "", "b c", 'say ""', "x\ny", "\n", "\n\n", "1,2", "é", "q" * 300, "l\n" * 40, '"', ",", "end\r\nof"]
    path = tmp_path / "t.csv"
    with open(path, "w", newline="") as out:
        writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        writer.writerow(["txn_id", "the note", "n"])
        for k in range(1500):
            writer.writerow([f"k{k % 400}", "".join(rng.choice(parts) for _ in range(rng.randrange(4))), k])
            if k % 100 == 0:
                out.write("\n")
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    plain = spark.read.options(header=True, multiLine=True, escape='"').csv(str(path)).collect()
    assert len(plain) == 1500
    try:
        _many_splits(spark, size)
        lines = quoted_csv._lines(spark, str(path))
        assert size > 10_000 or lines.select("block").distinct().count() > 10
        got = ingest.read_csv(spark, str(path), "place").collect()
        fixed = ingest.repair_file_duplicates(spark, str(path), "txn_id", "append_index").collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    got = sorted(got, key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1500))
    assert [tuple(r)[:3] for r in got] == [tuple(r) for r in plain]
    assert {r["txn_id"] for r in fixed} == {f"k{k % 400}-dup-{k}" for k in range(1500)}


def test_quotes_that_do_not_pair_up_are_left_to_one_task(spark, tmp_path):
    for k, text in enumerate(['id,note\n1,"two\nlines"\n2,5" pipe\n3,6" pipe\n', 'id,note\n1,"two\nlines"\n2,5" pipe\n']):
        path = str(tmp_path / f"p{k}.csv")
        (tmp_path / f"p{k}.csv").write_text(text)
        plain = spark.read.options(header=True, multiLine=True, escape='"').csv(path).collect()
        assert sorted(map(tuple, ingest.read_csv(spark, path).collect())) == sorted(map(tuple, plain))
    wide = str(tmp_path / "wide.csv")
    (tmp_path / "wide.csv").write_text('id,note\n1,"two\nlines",more\n')
    with pytest.raises(ValueError):
        ingest.read_csv(spark, wide)


def test_reload_replaces_everything(spark, folder, tmp_path):
    target = str(tmp_path / "db3")
    assert jobs.load(spark, folder, target)["dim_users"] == 2
    assert spark.sql("select count(*) from v_dim_users_clean").first()[0] == 2
    # a bad value outside the key: the table of the earlier load is gone, others are replaced
    (tmp_path / "users.csv").write_text(USERS.replace("0.25", "high"))
    got = jobs.load(spark, folder, target)
    assert got["dim_users"] == -1 and got["fct_transactions"] == 4
    tables = ingest.read_tables(spark, target)
    assert tables["dim_users"].count() == 0 and tables["fct_transactions"].count() == 4


def test_a_suite_that_cannot_run_says_so(spark, tmp_path):
    class Broken:
        base, row_views = {}, dict

        def check_views(self):
            raise ValueError("no views")

    out = jobs.run_quality_suite(Broken(), str(tmp_path))
    assert (out["overall_status"], out["exit_code"], out["error"]) == ("ERROR", 2, "no views")


def test_report_document(spark):
    import datetime

    checks = spark.createDataFrame(
        [("a", "x", "1", "PASS"), ("a", "y", "2", "FAIL"), ("b", "z", "3", None)],
        "category string, check_name string, measured string, status string",
    )
    row = jobs.report_document(checks, {"overall_status": "FAIL"}, datetime.datetime(2025, 1, 1)).first()
    assert (row.timestamp, row.overall_status, row.total_checks, row.total_failed) == ("2025-01-01T00:00:00", "FAIL", 3, 1)
    assert [(c.category, c.checks, len(c.details)) for c in row.categories] == [("a", 2, 2), ("b", 1, 1)]


def test_a_reader_sees_one_whole_load(spark, folder, tmp_path, monkeypatch):
    """A load that stops anywhere before its commit leaves the load before it."""
    target = str(tmp_path / "db5")
    ingest.write_tables(ingest.load_csv_files(spark, folder)[0], target)
    (tmp_path / "users.csv").write_text(USERS.replace("1,2025", "7,2025"))
    (tmp_path / "transactions.csv").write_text(TRANSACTIONS.replace("a,1", "z,7"))
    texts = ingest.load_csv_files(spark, folder)[0]

    def seen():
        tables = ingest.read_tables(spark, target)
        users = {r["user_id"] for r in tables["dim_users"].collect()}
        return users, {r["user_id"] for r in tables["fct_transactions"].collect()}

    before, coerce, calls = seen(), ingest.coerce, []

    def stopping(text, table):
        calls.append(table)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return coerce(text, table)

    monkeypatch.setattr(ingest, "coerce", stopping)
    with pytest.raises(KeyboardInterrupt):
        ingest.write_tables(texts, target)
    monkeypatch.setattr(ingest, "coerce", coerce)
    assert seen() == before == ({1, 2}, {1, 2})
    held = ingest.read_tables(spark, target)["dim_users"]
    ingest.write_tables(texts, target)
    assert seen() == ({7, 2}, {7, 1, 2})
    assert {r["user_id"] for r in held.collect()} == {1, 2}  # a reader keeps the version it began with


def test_versions_are_numbered_and_tidied(spark, tmp_path):
    target = str(tmp_path / "v")
    assert snapshots.current(spark, target) is None
    for k in range(4):
        place = snapshots.new_folder(target)
        spark.range(k).write.parquet(f"{place}/t")
        assert snapshots.commit(spark, target, place, {"k": k}) == k + 1
    found, facts = snapshots.current(spark, target)
    assert facts == {"k": 3} and spark.read.parquet(f"{found}/t").count() == 3
    assert len(list((tmp_path / "v").glob("load-*"))) == snapshots.KEPT
    # a number taken by another writer is left alone
    taken = tmp_path / "v" / snapshots.LOG / f"{5:020d}.json"
    real = snapshots._numbers
    taken.write_text(json.dumps({"folder": found.rsplit("/", 1)[1], "facts": {"k": 9}}))
    place, calls = snapshots.new_folder(target), []
    spark.range(1).write.parquet(f"{place}/t")

    def late(*args):
        calls.append(1)
        return [4] if len(calls) == 1 else real(*args)

    snapshots._numbers = late
    try:
        assert snapshots.commit(spark, target, place, {"k": 10}) == 6
    finally:
        snapshots._numbers = real
    assert json.loads(taken.read_text())["facts"] == {"k": 9}
    assert snapshots.current(spark, target)[1] == {"k": 10}


def test_checks_are_of_their_version(spark, folder, tmp_path):
    target, at = str(tmp_path / "db6"), "2025-06-01 00:00:00"
    with pytest.raises(FileNotFoundError):
        jobs.checks_of_version(spark, target, at)

    def rows():
        found = jobs.checks_of_version(spark, target, at).where("check_name like '%users%'")
        return sorted((r["check_name"], str(r["measured"])) for r in found.collect())

    jobs.load(spark, folder, target)
    first = rows()
    assert first and rows() == first
    (tmp_path / "users.csv").write_text(USERS + USERS.splitlines()[1].replace("1,", "9,", 1) + "\n")
    jobs.load(spark, folder, target)
    assert rows() != first


def test_reports_follow_their_tables(spark, tmp_path):
    """No result outlives the tables it was made from."""
    import shutil

    from lendlens.registry import QUERIES

    names = ["region", "nation", "customer", "orders", "events", "lineitem"]
    for name in names:
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    first = sorted(map(str, QUERIES["dq_report"](spark, str(tmp_path)).collect()))
    rest = spark.read.parquet(str(tmp_path / "customer.parquet")).where("c_custkey % 3 <> 0").toPandas()
    rest.to_parquet(tmp_path / "customer.parquet")
    spark.catalog.clearCache()
    assert sorted(map(str, QUERIES["dq_report"](spark, str(tmp_path)).collect())) != first
