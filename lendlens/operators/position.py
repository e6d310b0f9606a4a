"""Positions of rows in a stated order or in their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendlens.operators.cache import written
from lendlens.operators.ntile import _INDEX_BITS, _partitions


def with_row_position(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """0-based position of every row in the stated order, as a distributed numbering.

    Range partitions are sorted and numbered locally; one row per partition
    carries the offset. Ties in ``order`` may be numbered either way. The numbered
    rows are written once, as another run of the range partitioning might cut
    elsewhere.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    placed = written(
        df.repartitionByRange(_partitions(df), *by)
        .sortWithinPartitions(*by)
        .withColumn("__pos", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftright("__pos", _INDEX_BITS))
    return _shifted(placed, ["__part"], name).drop("__pos", "__part")


def with_file_position(scan: DataFrame, name: str) -> DataFrame:
    """0-based position of every row of a file scan, files in path order.

    The rows of one file split are contiguous in the scan, so a row's place is the
    number of rows in earlier splits plus its distance from the first row of its
    own split: no sort and no shuffle of the rows. The scan is written once, as
    another one might be split differently.
    """
    placed = written(scan.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__pos"),
    ))
    return _shifted(placed, ["__file", "__block"], name).drop("__file", "__block", "__pos")


def _shifted(placed: DataFrame, part: list[str], name: str) -> DataFrame:
    """Turn positions inside contiguous parts into positions overall.

    One row per part takes part in the prefix, however many rows there are.
    """
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*part).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__first")
    ).select(
        *part, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")
    )
    return placed.join(parts, part).withColumn(
        name, F.col("__pos") + F.col("__shift")
    ).drop("__shift")
