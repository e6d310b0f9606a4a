"""Per-key windows that survive a key owning a large share of the rows.

``Window.partitionBy(key)`` sends all rows of a key to one task, and AQE cannot
split a window partition. The operators here replace such windows:

* whole-group values: partial aggregation, then a join AQE may split;
* row numbers and running values: (key, calendar unit) cells, and a prefix over one
  row a cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_back(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join that keeps the left keys only."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def attach_group(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """``aggregate OVER (PARTITION BY keys)`` as map-side aggregation plus join."""
    totals = df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggregates.items()])
    return join_back(df, totals, keys)


def _in_cells(rows: DataFrame, key: str, ts: str, unit: str, known: Column | None = None) -> DataFrame:
    """Adds ``__key``, ``__null`` and ``__cell``: the key and the calendar unit of a row, never NULL.

    Windows over a cell and joins of its totals agree on these columns, so rows
    are shuffled once for both. Rows without a time are a cell of their own; rows
    that are not ``known`` take no part and are spread by their content.
    """
    at = F.unix_micros(F.date_trunc(unit, F.col(ts).cast("timestamp")))
    cell = F.coalesce(at, F.lit(2**63 - 1))
    if known is not None:
        cell = F.when(known, cell).otherwise(F.xxhash64(*rows.columns))
    kind = rows.schema[key].dataType
    return rows.withColumns({
        "__key": F.coalesce(F.col(key), F.lit("0").cast(kind)), "__null": F.col(key).isNull(), "__cell": cell,
    })


CELL = ["__key", "__null", "__cell"]


def _earlier_cells(totals: DataFrame, sums: dict[str, str]) -> DataFrame:
    """One row a cell: each sum over the cells of the key before it, under its new name."""
    before = Window.partitionBy("__key", "__null").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*CELL, *[F.sum(c).over(before).alias(new) for c, new in sums.items()])


def ordered_index(df: DataFrame, key: str, ts: str, tie: str, name: str, unit: str = "HOUR") -> DataFrame:
    """``row_number() OVER (PARTITION BY key ORDER BY ts, tie)`` without a per-key task.

    Rows are numbered inside the calendar unit, and the rows of the key's earlier
    units are added: a prefix over one count a unit. Nothing runs until the result
    is read, and the wide rows are shuffled once, by key and unit. The largest
    group that meets in a task is what one key has in one unit.
    """
    placed = _in_cells(df, key, ts, unit)
    counts = placed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("__n"))
    inside = Window.partitionBy(*CELL).orderBy(F.asc_nulls_last(ts), tie)
    numbered = placed.withColumn("__index", F.row_number().over(inside))
    joined = numbered.join(_earlier_cells(counts, {"__n": "__before"}), CELL)
    return joined.withColumn(name, F.coalesce("__before", F.lit(0)) + F.col("__index")).select(*df.columns, name)


def sums_before(
    rows: DataFrame, key: str, ts: str, columns: list[str], unit: str = "HOUR"
) -> DataFrame:
    """Replace ``columns`` by their sums over strictly earlier rows of the same key.

    Equal timestamps do not see each other. A row's sums are those of earlier rows
    in its calendar unit, a range frame that ends before its own instant, and a
    prefix over the totals of the key's earlier units. The rows are shuffled once,
    by key and unit, and joined once, to one row a unit. Rows without key or
    timestamp have nothing before them and are spread over the tasks.
    """
    known = F.col(key).isNotNull() & F.col(ts).isNotNull()
    placed = _in_cells(rows, key, ts, unit, known).withColumns({
        "__known": known, "__at": F.unix_micros(F.col(ts).cast("timestamp")),
    })
    totals = placed.where("__known").groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in columns])
    prefix = _earlier_cells(totals, {c: f"__p_{c}" for c in columns})
    inside = Window.partitionBy(*CELL).orderBy("__at").rangeBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"__l_{c}": F.sum(c).over(inside) for c in columns})
    joined = local.join(prefix, CELL, "left")

    def before(c: str) -> Column:
        total = F.coalesce(f"__p_{c}", F.lit(0)) + F.coalesce(f"__l_{c}", F.lit(0))
        return F.when(F.col("__known"), total).otherwise(F.lit(0)).alias(c)

    kept = [c for c in rows.columns if c not in columns]
    return joined.select(*kept, *[before(c) for c in columns])
