"""CSV scan, typed load, column checks and report sinks."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendlens.functions import coerced, round_half_away
from lendlens.operators.dedupe import repair_duplicates
from lendlens.operators.position import with_file_position
from lendlens.schemas import REQUIRED_COLUMNS, TABLES
from lendlens.sources import quoted_csv, snapshots

log = logging.getLogger(__name__)

# table -> (id column, strategy): files known to repeat ids (fixed values)
DUPLICATE_REPAIR = {"fct_transactions": ("txn_id", "append_index")}
FILE_POSITION = "__file_position"
EXCESS = "__excess"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_csv(spark: SparkSession, path: str, position: str | None = None) -> DataFrame:
    """A CSV file with a header, every column as text: codes keep their leading zeros.

    A row with more fields than the header is an error; a shorter one ends in NULLs.
    Quoted line breaks are read as part of their field, also by many tasks. Only a
    file with such breaks and with quotes inside of unquoted fields is read by one
    task. With ``position`` a column of that name tells the row's place in the file.
    """
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    broken = not lines.where(quotes % 2 == 1).limit(1).isEmpty()
    options = {"header": True, "multiLine": broken, "escape": '"', "mode": "PERMISSIVE"}
    columns = spark.read.options(**options).csv(path).columns
    if not columns:
        return spark.createDataFrame([], T.StructType([]))
    # one more column than the header has takes what is too much
    fields = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, EXCESS]])
    wide = quoted_csv.read(spark, path, fields, FILE_POSITION) if broken else None
    placed = wide is not None
    if not placed:
        wide = spark.read.options(**options, enforceSchema=True).schema(fields).csv(path)
    excess = wide.where(F.col(EXCESS).isNotNull()).limit(1)
    if not excess.isEmpty():
        raise ValueError(f"a row has more than {len(columns)} fields")
    wide = wide.drop(EXCESS)
    if not position:
        return wide.drop(FILE_POSITION)
    return wide.withColumnRenamed(FILE_POSITION, position) if placed else with_file_position(wide, position)


def load_csv_files(spark: SparkSession, directory: str) -> tuple[dict[str, DataFrame], list[str]]:
    """Text frames per table, and the tables whose file is missing or unreadable.

    A missing directory is an error; a bad file is listed and skipped. Files with a
    known duplicate problem get their ids repaired.
    """
    if not path_exists(spark, directory):
        raise FileNotFoundError(f"no such directory: {directory}")
    loaded, failed = {}, []
    for table, (file, _, _) in TABLES.items():
        try:
            if table in DUPLICATE_REPAIR:
                df = repair_file_duplicates(spark, f"{directory}/{file}", *DUPLICATE_REPAIR[table])
            else:
                df = read_csv(spark, f"{directory}/{file}")
            if not df.columns:
                raise ValueError("no columns")
            loaded[table] = df
        except Exception as error:  # one bad file must not stop the others
            log.warning("skipped %s: %s", file, error)
            failed.append(table)
    return loaded, failed


def repair_file_duplicates(spark: SparkSession, path: str, id_column: str, strategy: str) -> DataFrame:
    """A file's rows with duplicate ids renamed by the 0-based row position in the file."""
    placed = read_csv(spark, path, FILE_POSITION)
    if id_column not in placed.columns:
        log.warning("no column %s, left as it is", id_column)
        return placed.drop(FILE_POSITION)
    return repair_duplicates(placed, id_column, strategy, FILE_POSITION).drop(FILE_POSITION)


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, blank for NULL, the way a CSV file holds it."""
    def text(f: T.StructField):
        c = F.col(f.name).cast("string")
        if isinstance(f.dataType, T.TimestampNTZType) and f.name == "requested_at":
            c = F.regexp_replace(c, " ", "T")  # the second timestamp spelling
        return F.coalesce(c, F.lit("")).alias(f.name)

    return df.select(*[text(f) for f in df.schema.fields])


def coerce(df: DataFrame, table: str) -> DataFrame:
    """Cast text columns to the table's contract, matched by name."""
    _, schema, _ = TABLES[table]
    return df.select(*[coerced(f.name, f.dataType) for f in schema.fields])


def missing_columns(df: DataFrame, table: str) -> list[str]:
    return sorted(set(REQUIRED_COLUMNS[table]) - set(df.columns))


def required_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: are the required columns there, and in how many rows are they all filled."""
    from lendlens.plans.quality import union_all

    def check(table: str) -> DataFrame:
        df, missing = tables[table], missing_columns(tables[table], table)
        present = [c for c in REQUIRED_COLUMNS[table] if c not in missing]
        filled = F.lit(True)
        for c in present:
            filled = filled & F.col(c).isNotNull()
        return df.agg(F.count_if(filled).alias("complete_rows")).select(
            F.lit(table).alias("table_name"),
            F.lit(",".join(missing)).alias("missing_columns"),
            "complete_rows",
            F.lit("FAIL" if missing else "PASS").alias("status"),
        )

    return union_all([check(t) for t in REQUIRED_COLUMNS if t in tables])


def write_tables(tables: dict[str, DataFrame], target: str) -> dict[str, int]:
    """Full refresh: typed Parquet per table as one new version; -1 for a failed table.

    All tables are written and checked in a folder of their own, which then
    becomes current in one step: a reader sees all of this load or all of the one
    before, also if this one is stopped. A table with a value that does not fit
    its column, or whose primary key repeats or is NULL, is not loaded, as the
    contract demands. A failed or absent table has no rows in the new version:
    what is there is of one load.
    """
    out: dict[str, int] = {}
    if not tables:
        return out
    spark = next(iter(tables.values())).sparkSession
    folder = snapshots.new_folder(target)
    for table, text in tables.items():
        key = TABLES[table][2]
        try:
            coerce(text, table).write.parquet(f"{folder}/{table}")
            written = spark.read.schema(TABLES[table][1]).parquet(f"{folder}/{table}")
            counts = written.agg(
                F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("k")
            ).first()
            if counts["n"] != counts["k"]:
                raise ValueError(f"{table}.{key} is not unique")
            out[table] = counts["n"]
        except Exception as error:
            log.error("failed to load %s: %s", table, error)
            out[table] = -1
    snapshots.commit(spark, target, folder, out)
    return out


def read_tables(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The tables of the current version; one that failed has no rows."""
    found = snapshots.current(spark, target)
    folder, rows = found if found else ("", {})
    return {
        t: spark.read.schema(s).parquet(f"{folder}/{t}") if rows.get(t, -1) >= 0 else spark.createDataFrame([], s)
        for t, (_, s, _) in TABLES.items()
    }


def _shown(f: T.StructField) -> Column:
    """A value as text for a sample: four decimals, seconds, blank for NULL."""
    c = F.col(f.name)
    if isinstance(f.dataType, T.DoubleType):
        c = c.cast("decimal(18,4)")
    elif isinstance(f.dataType, T.TimestampNTZType):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(c.cast("string"), F.lit(""))


def samples(tables: dict[str, DataFrame], n: int) -> DataFrame:
    """The first n keys of every table with their row as JSON (a top-k per table)."""
    from lendlens.plans.quality import union_all

    def first(table: str) -> DataFrame:
        key = TABLES[table][2]
        rows = tables[table].orderBy(key).limit(n)
        return rows.select(
            F.lit(table).alias("table_name"), F.col(key).cast("string").alias("key"),
            F.to_json(F.struct(*[_shown(f).alias(f.name) for f in rows.schema.fields])).alias("row_json"),
        )

    return union_all([first(t) for t in TABLES])


def status_distribution(loans: DataFrame) -> DataFrame:
    return loans.groupBy("status").agg(
        F.count(F.lit(1)).alias("loan_count"),
        round_half_away(F.avg("amount"), 2).alias("avg_amount"),
    ).orderBy(F.desc("loan_count"), "status")


def write_report_json(df: DataFrame, path: str) -> None:
    """A small report as one JSON file; the reports hold one row per check or category."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_failed_csv(checks: DataFrame, path: str) -> bool:
    """Failed checks as CSV; nothing is written when none failed."""
    failed = checks.where(F.col("status") == "FAIL")
    if failed.isEmpty():
        return False
    failed.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return True
