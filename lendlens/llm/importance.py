"""Target-distribution importance resampling of documents by hashed word n-grams.

A document's weight is the sum of gains of its features, the runs of one to
three words, looked up in an array with one gain for each hash bucket: how much
more likely the bucket is in the target texts than in the corpus. A Gumbel
variate drawn from the id is added, so the highest scores are a draw without
replacement in proportion to exp(weight / SCALE).

The cutoff of the draw is found by bisection: exact count jobs over the written
scores, each of which answers STEPS halvings at once, and then the same over the
ids of the rows that have the cutoff's score. Only the drawn rows are moved: a
range partitioning in the order of the draw gives their ranks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import over_slices, prepare, word_blocks
from lendlens.operators.cache import written
from lendlens.operators.position import with_row_position

BUCKETS = 10_000
RUN = 3  # words of the longest feature
SCALE = 1000  # scores are whole thousandths
LEAST_WORDS = 20
SHARE = (5, 100)
SEED = 42
STEPS = 5  # halvings that one count job answers

# lower-cases A-Z and turns what is no part of a word into blanks; bytes of other characters are word bytes
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def buckets(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) of consecutive parts of a text."""
    earlier: list[int] = []  # sums of the runs of 1, 2, ... words that end in the last word so far
    for words in word_blocks(text.translate(_WORDS)):
        if not words:
            continue
        spaced = [b" " + w for w in words]
        shorter = list(map(zlib.crc32, words))
        found, ends = [*shorter], [shorter[-1]]
        for n in range(2, RUN + 1):
            # a run is the run of one word less before it, continued
            before = [*earlier[n - 2 : n - 1], *shorter[:-1]]
            longer = list(map(zlib.crc32, spaced[len(spaced) - len(before) :], before))
            found += longer
            ends += longer[-1:]
            shorter = longer
            if not longer:
                break
        earlier = ends
        yield len(words), np.array(found, dtype=np.uint32) % np.uint32(BUCKETS)


def _totals(text_col: str):
    """Occurrences of each bucket in a partition."""

    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(text_col).cast(pa.large_binary()):
                if text.is_valid:
                    for _, found in buckets(text.as_py()):
                        total += np.bincount(found, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    return run


def bucket_totals(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Occurrences of each bucket in all texts: BUCKETS numbers, however large the table."""
    parts = texts.select(text_col).mapInArrow(_totals(text_col), "bucket bigint, n bigint")
    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The smoothed log ratio of each bucket in whole thousandths, rounded down."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratios = [((t + 1.0) * s_all) / ((s + 1.0) * t_all) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(SCALE * math.log(r)) for r in ratios], dtype=np.int64)


def _weigh(id_col: str, text_col: str, gain: np.ndarray):
    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros((3, piece.num_rows), dtype=np.int64)
        for r, text in enumerate(piece.column(text_col).cast(pa.large_binary())):
            if text.is_valid:
                for n, found in buckets(text.as_py()):
                    out[:, r] += n, len(found), gain[found].sum()
        return pa.RecordBatch.from_arrays(
            [piece.column(id_col), *map(pa.array, out)], ["id", "n_words", "n_features", "weight"]
        )

    return over_slices(text_col, step)


def _cutoff(rows: DataFrame, column: str, wanted: int, low: int, high: int) -> int:
    """The least value in [low, high] that at least ``wanted`` rows do not exceed.

    Each count job halves the range STEPS times: it counts at all places that
    those halvings could ask for.
    """
    while low < high:
        width = high - low
        places = sorted({low + width * k // (1 << STEPS) for k in range(1 << STEPS)})
        counted = rows.filter(F.col(column) <= high).agg(
            *[F.coalesce(F.sum((F.col(column) <= F.lit(p)).cast("long")), F.lit(0)).alias(f"n{k}")
              for k, p in enumerate(places)]
        ).first()
        enough = [p for p, n in zip(places, counted) if n >= wanted]
        short = [p for p, n in zip(places, counted) if n < wanted]
        low, high = (short[-1] + 1 if short else low), (enough[0] if enough else high)
    return low


def _luck(id_col: Column, seed: int) -> Column:
    """A Gumbel variate in thousandths, from the id alone."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row; rank is null for what is not drawn.

    Drawn are floor(share[0] * N / share[1]) of the N rows with at least
    ``least_words`` words, of the highest score and then the smallest id; the
    id is an integer. Null and empty texts have no features and weight 0. Of
    rows of one id and score the one with fewer features is drawn first; equal
    rows take ranks in any order. A row without id has no score, does not count
    in N and is never drawn. Other columns are not read; an empty table or
    target gives every bucket the gain of its smoothed counts.
    """
    prepare(docs.sparkSession)
    gain = gains(bucket_totals(docs, text_col), bucket_totals(target, target_col))
    kind = docs.schema[id_col].dataType.simpleString()
    weighed = docs.select(id_col, text_col).mapInArrow(
        _weigh(id_col, text_col, gain), f"id {kind}, n_words bigint, n_features bigint, weight bigint"
    )
    scored = written(weighed.withColumn("score", F.col("weight") + _luck(F.col("id"), seed)))
    able = (F.col("n_words") >= least_words) & F.col("id").isNotNull()
    eligible = scored.filter(able)
    n, low, high = eligible.agg(F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    wanted = share[0] * n // share[1]
    if not wanted:
        drawn = F.lit(False)
    else:
        # the score that n - wanted + 1 rows do not exceed is the lowest one drawn
        at = _cutoff(eligible, "score", n - wanted + 1, low, high)
        tied = eligible.filter(F.col("score") == at)
        above, first, last = (
            eligible.filter(F.col("score") > at).count(), *tied.agg(F.min("id"), F.max("id")).first()
        )
        until = _cutoff(tied, "id", wanted - above, first, last)
        drawn = able & ((F.col("score") > at) | ((F.col("score") == at) & (F.col("id") <= until)))
    chosen = with_row_position(
        scored.filter(drawn).withColumn("__down", -F.col("score")), ["__down", "id", "n_features"], "__place"
    )
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    # beyond the number wanted are only further rows of the cutoff's own id
    rank = F.when(F.col("__place") < wanted, F.col("__place") + 1).cast("long")
    rest = scored.filter(~F.coalesce(drawn, F.lit(False)))
    return rest.select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(
        chosen.select(*columns, rank.alias("rank"))
    )
