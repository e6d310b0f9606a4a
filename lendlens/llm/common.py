"""What the corpus operators share: session settings, batch slices, component labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from lendlens.operators.cache import written
from lendlens.session import configure

ARROW_ROWS, ARROW_BYTES = 512, "4m"  # of a batch sent to Python: texts may be long
SLICE_BYTES = 1 << 19  # text bytes that one vectorised step looks at (one text may be longer)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; sizing stays with the cluster."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text column of each piece holds few bytes."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        total = np.cumsum(lengths)
        begin = 0
        while begin < batch.num_rows:
            before = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, before + SLICE_BYTES, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def over_slices(column: str, step: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A function for mapInArrow that applies a step to small pieces of its input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, column):
            out = step(piece)
            if out is not None:
                yield out

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Pieces of about so many rows that hold all rows of each key they have; the input is sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        piece = pa.concat_batches(held)
        keys = piece.column(key)
        last = keys[piece.num_rows - 1]
        begin = pc.index(keys, last).as_py()  # the last key may go on in the next batch
        if begin:
            yield piece.slice(0, begin)
        held = [piece.slice(begin)]
        rows = max(rows, 2 * held[0].num_rows)  # a long key is not put together anew for each batch
    if held:
        piece = pa.concat_batches(held)
        if piece.num_rows:
            yield piece


def bounds(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the number of keys at the end."""
    if not len(sorted_keys):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text of words and ASCII white space, in lists of about so many bytes."""
    begin = 0
    while begin < len(text):
        end = text.find(b" ", begin + size)
        end = len(text) if end < 0 else end
        yield text[begin:end].split()
        begin = end


def extended(df: DataFrame, *columns: tuple[str, str]) -> StructType:
    """The frame's schema with further nullable columns."""
    out = StructType(list(df.schema.fields))
    for name, kind in columns:
        out = out.add(name, DataType.fromDDL(kind), True)
    return out


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores until the frame has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each end of the links (a, b): the smallest id reachable.

    Labels travel along links and then jump to their label's label; every
    round is a written table, so that lineage stays short. Nothing is collected
    but the number of changes, and the joins are merge joins, as a broadcast of
    labels would pass through the driver in each round.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = both.union(both.select("dst", "src"))
    # each node is its own neighbour too
    both = written(both.union(both.select("src", F.col("src").alias("dst"))).distinct())
    labels = written(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("component")))
    while True:
        known = labels.select(F.col("id").alias("dst"), F.col("component").alias("c")).hint("merge")
        spread = both.join(known, "dst").groupBy(F.col("src").alias("id")).agg(
            F.min("c").alias("component"), F.min(F.when(F.col("src") == F.col("dst"), F.col("c"))).alias("was")
        )
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further")).hint("merge")
        after = written(spread.join(jump, "component", "left").select(
            "id", F.least("component", F.coalesce("further", "component")).alias("component"), "was"
        ))
        changed = after.filter(F.col("component") != F.col("was")).limit(1).count()
        labels = after.select("id", "component")
        if not changed:
            return labels
