"""NTILE over a whole table without moving the table to one partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

_INDEX_BITS = 33  # monotonically_increasing_id: partition id above, row index below


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fit_ntile(df: DataFrame, value: str, tie: str, buckets: int) -> list[tuple | None]:
    """The first (value, tie) of buckets 2..n, in ``value NULLS LAST, tie`` order.

    Two narrow columns are range-partitioned and sorted once; a count per
    partition locates the n-1 boundary rows, and only those reach the driver.
    The persisted rows keep both steps on one and the same partitioning. A
    boundary is None where the table has fewer rows than buckets.
    """
    order = [F.col("v").asc_nulls_last(), F.col("t").asc()]
    ranged = (
        df.select(F.col(value).alias("v"), F.col(tie).alias("t"))
        .repartitionByRange(_partitions(df), *order)
        .sortWithinPartitions(*order)
        .withColumn("pos", F.monotonically_increasing_id())
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        part = F.shiftright("pos", _INDEX_BITS)
        sizes = sorted(
            (r["p"], r["n"]) for r in ranged.groupBy(part.alias("p"))
            .agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition
        )
        total = sum(n for _, n in sizes)
        small, wide = divmod(total, buckets)
        wanted = {}
        for b in range(1, buckets):
            first = b * small + min(b, wide)  # 0-based rank of the first row of bucket b+1
            if first >= total or (small == 0 and b >= wide):
                continue
            seen = 0
            for p, n in sizes:
                if first < seen + n:
                    wanted[(p << _INDEX_BITS) + first - seen] = b
                    break
                seen += n
        cuts: list[tuple | None] = [None] * (buckets - 1)
        for r in ranged.where(F.col("pos").isin(list(wanted))).collect():
            cuts[wanted[r["pos"]] - 1] = (r["v"], r["t"])
        return cuts
    finally:
        ranged.unpersist()


def ntile_bucket(value: Column, tie: Column, cuts: list[tuple | None]) -> Column:
    """Bucket number of a row, a plain expression over the fitted boundaries."""

    def reached(cut) -> Column:
        v, t = cut
        if v is None:
            return value.isNull() & (tie >= F.lit(t))
        after = (value > F.lit(v)) | ((value == F.lit(v)) & (tie >= F.lit(t)))
        return value.isNull() | after

    steps = [F.when(reached(c), 1).otherwise(0) for c in cuts if c is not None]
    return reduce(lambda a, b: a + b, steps, F.lit(1))
