"""Persistence for frames that several passes read."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


@contextmanager
def persisted(df: DataFrame) -> Iterator[DataFrame]:
    """Keep the frame for the block; its plan stays usable afterwards."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


# shuffle files of a write go when it ends: the table stands for them
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LEVELS = 10_000  # values of a category that may reach the driver


@lru_cache(maxsize=1)
def _local_folder() -> str:
    """A folder for local sessions without a setting; it goes when the process ends."""
    folder = tempfile.TemporaryDirectory(prefix="lendlens-", ignore_cleanup_errors=True)
    atexit.register(folder.cleanup)
    return folder.name


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only locally."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder()


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the checkpoint folder, with its lineage cut.

    For values that must not change between reads, such as row numbers that
    depend on how a scan was split. The table is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/lendlens-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def column_levels(df: DataFrame, columns: list[str]) -> dict[str, list]:
    """Sorted distinct values per categorical column, in one pass.

    Only for category domains: one value set per column reaches the driver, and a
    column with more than about LEVELS values is an error.
    """
    if not columns:
        return {}
    sizes = df.agg(*[F.approx_count_distinct(c) for c in columns]).first()
    for c, n in zip(columns, sizes):
        if n > LEVELS:
            raise ValueError(f"{c} has about {n} levels; at most {LEVELS} are brought together")
    row = df.agg(*[F.collect_set(c) for c in columns]).first()
    return {c: sorted(row[i]) for i, c in enumerate(columns)}
