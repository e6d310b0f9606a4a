"""Skew-safe operators against the plain window or join form, one key dominating."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lendlens.operators.asof import latest_before
from lendlens.operators.dedupe import repair_duplicates
from lendlens.operators.position import with_row_position
from lendlens.operators.ntile import fit_ntile, ntile_bucket
from lendlens.operators.quantile import exact_quantiles
from lendlens.operators.skew import attach_group, ordered_index, sums_before


@pytest.fixture(scope="module")
def events(spark):
    """2,000 rows; a third belong to user 1, some keys and times are NULL, many tie."""
    rng = np.random.default_rng(3)
    n = 2000
    user = np.where(rng.uniform(size=n) < 1 / 3, 1, rng.integers(2, 60, n)).astype(object)
    minutes = rng.integers(0, 60 * 24 * 6, n) // 30 * 30
    start = dt.datetime(2024, 1, 1)
    ts = [start + dt.timedelta(minutes=int(m)) for m in minutes]
    for i in range(0, n, 97):
        user[i] = None
    for i in range(5, n, 113):
        ts[i] = None
    rows = [(i, None if u is None else int(u), t, float(v))
            for i, (u, t, v) in enumerate(zip(user, ts, rng.integers(1, 50, n)))]
    return spark.createDataFrame(
        rows, "id bigint, user bigint, ts timestamp_ntz, v double"
    ).cache()


def test_ordered_index_equals_row_number(events):
    w = Window.partitionBy("user").orderBy(F.asc_nulls_last("ts"), "id")
    want = events.withColumn("want", F.row_number().over(w))
    got = ordered_index(want, "user", "ts", "id", "got")
    assert got.count() == events.count()
    assert got.where("got <> want").count() == 0


def test_one_instant_is_numbered_by_several_tasks(spark):
    """All rows of one user at one timestamp."""
    rows = spark.range(20_000).select(
        F.col("id"), F.lit(1).alias("user"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
        F.lit(1.0).alias("v"),
    )
    placed = with_row_position(rows, ["user", "ts", "id"], "n")
    assert placed.where("n <> id").count() == 0
    # each written file is what one task numbered
    files = [f for f in placed.inputFiles() if f.endswith(".parquet")]
    sizes = [spark.read.parquet(f).count() for f in files]
    assert sum(sizes) == 20_000 and len(sizes) > 3 and max(sizes) < 10_000
    got = ordered_index(rows, "user", "ts", "id", "n")
    assert got.where("n <> id + 1").count() == 0 and got.count() == 20_000
    # they do not see each other
    assert sums_before(rows, "user", "ts", ["v"]).agg(F.sum("v")).first()[0] == 0


def test_a_user_is_numbered_by_several_tasks(spark):
    """One user with all rows: hours are numbered apart, in one wide shuffle and without a job beforehand."""
    rows = spark.range(20_000).select(
        "id", F.when(F.col("id") < 19_990, 1).otherwise(2).alias("user"), F.lit(1.0).alias("v"),
        F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.concat(F.lit("x"), F.col("id")).alias("wide"),
    )
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "views are built without a job")
    numbered, summed = ordered_index(rows, "user", "ts", "id", "n"), sums_before(rows, "user", "ts", ["v"])
    assert not tracker.getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert numbered.where("n <> id + 1 - if(user = 2, 19990, 0)").count() == 0 and numbered.count() == 20_000
    assert summed.where("v <> id - if(user = 2, 19990, 0)").count() == 0
    parts = numbered.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]
    assert parts < 10_000
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (numbered, summed):
            plan = df._jdf.queryExecution().executedPlan().toString()
            lines = plan.splitlines()
            wide = [b for a, b in zip(lines, lines[1:]) if " Exchange " in a and "wide#" in b]
            assert len(wide) == 1 and plan.count("SortMergeJoin") == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_attach_group_keeps_null_groups(events):
    w = Window.partitionBy("user")
    want = events.withColumn("want", F.sum("v").over(w))
    got = attach_group(want, ["user"], got=F.sum("v"))
    assert got.count() == events.count()
    assert got.where("NOT (got <=> want)").count() == 0


def test_sums_before_is_strict(events):
    a, b = events.alias("a"), events.alias("b")
    pairs = a.join(
        b, (F.col("a.user") == F.col("b.user")) & (F.col("b.ts") < F.col("a.ts")), "left"
    )
    want = {r["id"]: r["s"] for r in pairs.groupBy("a.id").agg(
        F.coalesce(F.sum("b.v"), F.lit(0.0)).alias("s")).collect()}
    got = {r["id"]: r["v"] for r in sums_before(events, "user", "ts", ["v"]).collect()}
    assert got == want


def test_latest_before(spark, events):
    days = [(u, dt.datetime(2024, 1, d), d * 100 + u) for u in range(1, 40) for d in (1, 3, 4)
            if (u + d) % 5]
    snaps = spark.createDataFrame(days, "user bigint, day timestamp_ntz, x int")
    want = {}
    by_user = {}
    for u, d, x in days:
        by_user.setdefault(u, []).append((d, x))
    for r in events.collect():
        past = [p for p in by_user.get(r["user"], []) if r["ts"] is not None and p[0] < r["ts"]]
        want[r["id"]] = max(past)[1] if past else None
    left = latest_before(events, snaps, "user", "ts", "day", how="left")
    assert {r["id"]: r["x"] for r in left.collect()} == want
    inner = latest_before(events, snaps, "user", "ts", "day")
    assert {r["id"]: r["x"] for r in inner.collect()} == {
        k: v for k, v in want.items() if v is not None}


@pytest.mark.parametrize("rows,buckets", [(1000, 10), (1003, 10), (7, 10), (1, 10), (12, 4)])
def test_ntile_with_ties_and_nulls(spark, rows, buckets):
    values = [(i, None if i % 9 == 4 else float(i * 7 % 5)) for i in range(rows)]
    df = spark.createDataFrame(values, "id bigint, score double")
    w = Window.orderBy(F.asc_nulls_last("score"), "id")
    want = df.withColumn("want", F.ntile(buckets).over(w))
    cuts = fit_ntile(df, "score", "id", buckets)
    got = want.withColumn("got", ntile_bucket(F.col("score"), F.col("id"), cuts))
    assert got.where("got <> want").count() == 0


def test_ntile_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, score double")
    assert fit_ntile(df, "score", "id", 10) == [None] * 9


def test_duplicate_repair(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("c",), ("a",)], "txn_id string")
    df = df.withColumn("row_index", F.monotonically_increasing_id())
    numbered = with_row_position(df.withColumnRenamed("row_index", "o"), ["o"])
    fixed = repair_duplicates(numbered, "txn_id")
    assert sorted(r["txn_id"] for r in fixed.collect()) == [
        "a-dup-0", "a-dup-2", "a-dup-4", "b", "c"]
    with pytest.raises(ValueError):
        repair_duplicates(numbered, "txn_id", "drop")
    assert repair_duplicates(numbered, "absent") is numbered


@pytest.mark.parametrize("limits", [(20_000, 0.002), (10 ** 9, 1.0), (0, 0.002), (0, 1.0), (300, 1e-7)])
def test_exact_quantiles_on_every_path(spark, limits):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rng.normal(size=5000), "b": rng.integers(0, 4, 5000) * 1.0,
                          "c": np.where(rng.uniform(size=5000) < 0.6, 7.0, rng.normal(size=5000))})
    frame.loc[::10, "a"] = np.nan
    df = spark.createDataFrame(frame).withColumn("a", F.nanvl("a", F.lit(None)))
    wanted = {"a": [0.0, 0.25, 0.5, 0.9, 1.0], "b": [0.5, 0.75], "c": [0.1, 0.5, 0.61]}
    got = exact_quantiles(df, wanted, *limits)
    for c, qs in wanted.items():
        assert np.allclose(got[c], np.nanquantile(frame[c], qs), atol=1e-12), c
    assert exact_quantiles(df.where("a > 100"), {"a": [0.5]}, *limits) == {"a": [None]}
