"""CSV files with quoted line breaks, read by many tasks.

A line break ends a record if the quotes before it are even in number. The file
is split by bytes as any text file; the quotes of the earlier splits, a prefix
over one row a split, say whether a split begins inside of a field. Records of one
line stay where they are, and the lines of the others are brought together by
the number of their record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendlens.operators.cache import written

SPLIT = ["file", "block"]
# fields without quotes, or in quotes with inner ones doubled
WELL_FORMED = r'^(?:(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+),)*+(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)$'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return written(spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"),
    ))


def _before(parts: DataFrame, column: str, name: str) -> DataFrame:
    """One row a split: the sum over the file's earlier splits, and what else it has."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(name, F.coalesce(F.sum(column).over(earlier), F.lit(0))).drop(column)


def records(spark: SparkSession, path: str) -> DataFrame | None:
    """(file, number, record) with numbers from 0, the header's; None if the quotes do not pair up."""
    lines = _lines(spark, path)
    quotes = lines.groupBy(*SPLIT).agg(
        F.sum("quotes").alias("quotes"), F.min_by(F.endswith("value", F.lit("\r")), "at").alias("crlf")
    )
    if not quotes.groupBy("file").agg((F.sum("quotes") % 2).alias("odd")).where("odd = 1").isEmpty():
        return None
    order = Window.partitionBy(*SPLIT).orderBy("at")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # a file whose first line ends in CRLF has that between all lines, also in fields
    first = Window.partitionBy("file").orderBy("block")
    places = _before(quotes, "quotes", "open").withColumn("crlf", F.first("crlf").over(first))
    text = F.when(F.col("crlf"), F.regexp_replace("value", r"\r$", "")).otherwise(F.col("value"))
    inside = F.col("open") + F.coalesce(F.sum("quotes").over(earlier), F.lit(0))
    begun = written(lines.join(places, SPLIT).select(
        *SPLIT, "at", text.alias("value"), (inside % 2 == 0).alias("begins"),
    ).withColumns({
        "starts": (F.col("begins") & (F.col("value") != "")).cast("long"),  # an empty line is no record
        "ends": F.coalesce(F.lead("begins").over(order), F.lit(False)),  # unknown for the last line of a split
    }))
    starts = begun.groupBy(*SPLIT).agg(F.sum("starts").alias("starts"))
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = begun.join(_before(starts, "starts", "records"), SPLIT).withColumn(
        "number", F.col("records") + F.sum("starts").over(up_to) - 1
    ).where("starts = 1 or not begins")
    alone = (F.col("starts") == 1) & F.col("ends")
    line = F.struct("block", "at", "value")
    joined = numbered.where(~alone).groupBy("file", "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["value"]), "\n").alias("record")
    )
    return numbered.where(alone).select("file", "number", F.col("value").alias("record")).unionByName(joined)


def read(spark: SparkSession, path: str, fields: T.StructType, position: str) -> DataFrame | None:
    """The rows as text columns, with their 0-based position in the file.

    None where fields are not quoted as a whole: what such a file means depends on
    the reader, so that has to read it.
    """
    found = records(spark, path)
    if found is None:
        return None
    found = written(found)
    if not found.where(~F.col("record").rlike(WELL_FORMED)).limit(1).isEmpty():
        return None
    options = {"escape": '"', "mode": "PERMISSIVE"}
    names = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)
    parsed = F.from_csv("record", names, options)
    return found.where("number > 0").select(parsed.alias("row"), (F.col("number") - 1).alias(position)).select(
        "row.*", position
    )

