"""Point-in-time lookup of day-stamped snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_before(
    queries: DataFrame, snapshots: DataFrame, key: str, at: str, stamp: str, how: str = "inner"
) -> DataFrame:
    """Every query row with the latest snapshot of its key stamped strictly before ``at``.

    Snapshots carry a midnight stamp, one per (key, day). "Strictly before ``at``"
    therefore only depends on the last day whose midnight precedes ``at``, and the
    lookup runs on the distinct (key, day) pairs: a key holds at most one row per
    day on either side, whatever its number of queries. Queries without a
    snapshot drop out, or stay with NULLs where ``how`` is "left".
    """
    payload = [c for c in snapshots.columns if c != key]
    midnight = F.date_trunc("DAY", F.col(at).cast("timestamp")).cast("timestamp_ntz")
    last_day = F.when(F.col(at) > midnight, F.col(at).cast("date")).otherwise(
        F.date_sub(F.col(at).cast("date"), 1)
    )
    asked = queries.withColumn("__cutoff", last_day)
    points = asked.select(key, F.col("__cutoff").alias("__day")).dropna().distinct()
    snap = F.struct(*payload)
    facts = snapshots.select(
        key, F.col(stamp).cast("date").alias("__day"), F.lit(0).alias("__ask"), snap.alias("__s")
    )
    empty = facts.schema["__s"].dataType
    asks = points.select(
        key, "__day", F.lit(1).alias("__ask"), F.lit(None).cast(empty).alias("__s")
    )
    order = (
        Window.partitionBy(key).orderBy("__day", "__ask")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        facts.unionByName(asks)
        .withColumn("__hit", F.last("__s", ignorenulls=True).over(order))
        .where((F.col("__ask") == 1) & F.col("__hit").isNotNull())
        .select(F.col(key).alias("__k"), F.col("__day").alias("__d"), "__hit")
    )
    return (
        asked.join(found, (F.col(key) == F.col("__k")) & (F.col("__cutoff") == F.col("__d")), how)
        .select(*queries.columns, *[F.col(f"__hit.{c}").alias(c) for c in payload])
    )
