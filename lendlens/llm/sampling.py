"""Bounded, repeatable samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT = 1  # remainder of crc32(id as text) modulo 3 that no model learns from


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning; a row without an id is."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == HELD_OUT, F.lit(True))


def counts(rows: DataFrame, label: str) -> dict:
    """Rows per label; labels are a handful of values."""
    found = rows.groupBy(label).count().orderBy(label).limit(1001).collect()
    if len(found) > 1000:
        raise ValueError(f"{label} has over 1000 values")
    return {r[label]: r["count"] for r in found}


def stratified(rows: DataFrame, id_col: str, label: str, per_label: int, sizes: dict) -> DataFrame:
    """About per_label rows of each label, chosen by a hash of the id; all rows of a smaller label."""
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_label / n))).otherwise(share)
    unit = F.pmod(F.xxhash64(F.lit(41), F.col(id_col)), F.lit(1 << 20)) / F.lit(1 << 20)
    return rows.filter(unit < share)
