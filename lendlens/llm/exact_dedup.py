"""Exact dedup by deterministic block naming, with DataFrame functions only.

A text is cut into blocks of a fixed number of bytes. Equal blocks get one
integer name, in the order of the sorted distinct blocks; then adjacent pairs
of names are named the same way, until each text is one name. Names stand for
contents without collisions: no hash decides that two texts are equal.

Only blocks (pairs) that occur more than once need a common name. A text with
a block of its own equals no other text, so its row leaves the recursion at
once and is its own identity; what moves on is the part of the corpus that may
repeat. Counts are combined before they are shuffled, and the names reach the
rows by joins that adaptive execution can split, so a text copied over a third
of all rows overloads no task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import prepare
from lendlens.operators.cache import written

BLOCK_BYTES = 2048


def _named(parts: DataFrame, content: list[str]) -> DataFrame:
    """(content, name) of the contents that occur in more than one place, as a written table.

    The distinct contents are sorted inside their hash partitions and numbered
    there. The table is written, since the numbers must not change when an
    executor is lost and its partition runs again.
    """
    repeated = parts.groupBy(*content).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    return written(
        repeated.sortWithinPartitions(*content).withColumn("name", F.monotonically_increasing_id())
    )


def _with_names(parts: DataFrame, content: list[str]) -> DataFrame:
    """Parts of the rows all of whose parts have a common name: key, place, parts, name."""
    names = _named(parts, content)
    joined = parts.join(names, content, "left").select("key", "place", "parts", "name")
    return written(joined.filter("name is not null"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, round, name) for each row whose text may repeat.

    `key` is a digest of id and text that carries a row through the rounds; it
    takes no part in deciding what is equal. Rows with the same (round, name)
    have equal texts, and rows that are not listed have texts of their own.
    """
    content = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / F.lit(block_bytes))).cast("int")
    rows = docs.select(row_key(id_col, text_col).alias("key"), content.alias("content")).withColumn("parts", n_blocks)
    blocks = rows.select(
        "key", "parts", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda i: F.substring(F.col("content"), i * block_bytes + 1, F.lit(block_bytes)),
        )).alias("place", "block"),
    )
    level = _with_names(blocks, ["block"])
    done, number = None, 0
    while True:
        # every part must have a common name; repeated rows have one key and the same parts
        whole = level.dropDuplicates(["key", "place"])
        alive = whole.groupBy("key").agg(F.count(F.lit(1)).alias("have"), F.max("parts").alias("parts"))
        alive = written(alive.filter("have = parts"))
        whole = whole.join(alive.select("key"), "key", "left_semi")
        ended = whole.filter("parts = 1").select("key", F.lit(number).alias("round"), "name")
        done = ended if done is None else done.unionByName(ended)
        if not alive.filter("parts > 1").limit(1).count():
            return done
        pairs = (
            whole.filter("parts > 1")
            .groupBy("key", F.floor(F.col("place") / 2).cast("int").alias("place"))
            .agg(
                F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
                F.max(F.ceil(F.col("parts") / 2).cast("int")).alias("parts"),
            )
        )
        number += 1
        level = _with_names(written(pairs), ["left", "right"])


def row_key(id_col: str, text_col: str):
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.sha2(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.sha2(text, 256)), 256)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row.

    A null text counts as empty, and an empty text is one empty block. The row
    with the largest id of a group of equal texts stays; a null id is smaller
    than all others. Rows that repeat id and text whole are equal texts like
    others and one of them stays. Other columns are not read. An empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(id_col, text_col)
    named = written(identities(rows, id_col, text_col, block_bytes))
    text = F.coalesce(F.col(text_col), F.lit(""))
    listed = rows.select(
        F.col(id_col).alias("id"), F.sha2(text, 256).alias("text_sha256"), row_key(id_col, text_col).alias("key")
    )
    counted = listed.groupBy("key").agg(
        F.first("id").alias("id"), F.first("text_sha256").alias("text_sha256"), F.count(F.lit(1)).alias("copies")
    )
    counted = counted.join(named, "key", "left")
    classes = (
        counted.filter("name is not null").groupBy("round", "name")
        .agg(F.max("id").alias("keep_id"), F.sum("copies").alias("size"))
    )
    joined = counted.join(classes, ["round", "name"], "left")
    alone = F.col("name").isNull()
    keep_id = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    out = joined.select(
        F.col("id"), keep_id.alias("keep_id"),
        F.when(alone, F.col("copies")).otherwise(F.col("size")).alias("group_size"),
        "text_sha256",
        # rows that repeat id and text are one line until here; the first of them may stay
        F.posexplode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("nth", "one"),
    )
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 0)).alias("kept"), "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat id and text, one."""
    stay = (
        groups(docs, id_col, text_col)
        .groupBy(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha2"))
        .agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__copies"))
        .filter("__kept")
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumn("__sha", F.sha2(text, 256))
    out = marked.join(stay, F.col("__id").eqNullSafe(F.col(id_col)) & (F.col("__sha") == F.col("__sha2")))
    once = out.filter("__copies = 1")
    repeated = out.filter("__copies > 1").dropDuplicates([id_col, "__sha"])
    return once.unionByName(repeated).select(*docs.columns)


SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""
