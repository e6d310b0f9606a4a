"""Repair of duplicate identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.operators.skew import attach_group

STRATEGIES = ("append_index",)


def repair_duplicates(
    df: DataFrame, id_column: str, strategy: str = "append_index", index: str = "row_index"
) -> DataFrame:
    """Every member of a duplicate group gets ``id-dup-<position>``.

    ``index`` holds the 0-based position of the row in its file. A frame without
    the id column passes through; an unknown strategy is an error.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown duplicate strategy: {strategy}")
    if id_column not in df.columns:
        return df
    counted = attach_group(df, [id_column], __members=F.count(F.lit(1)))
    text = F.col(id_column).cast("string")
    return counted.withColumn(
        id_column,
        F.when(
            F.col("__members") > 1,
            F.concat_ws("-dup-", text, F.col(index).cast("string")),
        ).otherwise(text),
    ).drop("__members")
