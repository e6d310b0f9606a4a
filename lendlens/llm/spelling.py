"""Spelling variant grouping by blocked Gram matrices of letter counts.

Words are compared in blocks of adjacent lengths: one Gram product of the letter
counts of the shorter and of all words of a block gives their squared distances.
One edit changes the counts by at most 2 (a replaced letter) or 1 (one more
letter), so pairs beyond 2 are dropped and the rest is verified letter by letter.

A block is named by the length of the shorter words and a span of places where
the edit may be; its words agree before and after the span. A block with more
than CELLS products is split: the edit is in one half of the span or in the
other, and the words that agree outside of that half are a block. Halving goes
on until all blocks are small or the span is one place, where a block holds at
most one word a letter, and one a pair of letters. So no pair is lost, and each
is counted in the block that holds its first place of difference only. Counts
and the best neighbour of each word are formed inside the block; no pair leaves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import bounds, prepare, whole_groups
from lendlens.operators.cache import written

RUNS = "[A-Za-z\u00C0-\u00FF]"
LEAST_LENGTH, LEAST_COUNT = 5, 3
DAMAGE = 97  # of so many (document, run) pairs one loses a letter
CELLS = 1 << 19  # products of one Gram matrix
BANDS = 32  # letters are counted by their code modulo BANDS, which never enlarges the distance of one edit
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n): words of the texts with their damage, and how often they occur."""
    # shorter runs cannot give a word, damaged or not
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{RUNS}{{{LEAST_LENGTH},}}"), F.lit(0))
    lower = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).select(
        "id", F.translate("run", UPPER, LOWER).alias("run")
    )
    name = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    hashed = lower.select("run", F.crc32(name.cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % DAMAGE == 0, damaged).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH))


def _keyed(rows: DataFrame) -> DataFrame:
    """Members with the key of their block: what is outside of the span, which is longer for a longer word."""
    head = F.substring("word", F.lit(1), F.col("lo"))
    tail = F.substring(F.col("word"), F.col("hi") + F.col("long") + 1, F.length("word"))
    key = F.xxhash64("size", "lo", "hi", head, F.lit("\n"), tail)
    return rows.select(key.alias("key"), "word", "n", "size", "lo", "hi", "long")


def _halves() -> Column:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    first = F.struct(F.col("lo").alias("lo"), middle.alias("hi"))
    return F.explode(F.array(first, F.struct(middle.alias("lo"), F.col("hi").alias("hi")))).alias("half")


def _split(rows: DataFrame) -> DataFrame:
    return _keyed(rows.select("word", "n", "size", "long", _halves()).select(
        "word", "n", "size", "half.lo", "half.hi", "long"
    ))


def blocks(words: DataFrame, cells: int = CELLS) -> DataFrame:
    """Members (key, word, n, size, lo, hi, long) of blocks with few products, which keep all near pairs together."""
    roles = F.explode(F.array(F.lit(0), F.lit(1))).alias("long")
    rows = words.select("word", "n", roles).withColumn("size", F.length("word") - F.col("long"))
    level = written(_split(rows.withColumn("lo", F.lit(0)).withColumn("hi", F.col("size"))))
    done = None
    while True:
        short = F.sum(1 - F.col("long"))
        sizes = written(
            level.groupBy("key").agg(
                (short * F.count(F.lit(1))).alias("cells"), short.alias("short"),
                F.count(F.lit(1)).alias("all"), F.max(F.col("hi") - F.col("lo")).alias("span"),
            ).filter("short > 0 and all > 1").select("key", ((F.col("cells") > cells) & (F.col("span") > 1)).alias("over"))
        )
        fit = level.join(sizes.filter("not over").select("key"), "key")
        done = fit if done is None else done.unionByName(fit)
        over = sizes.filter("over").select("key")
        if not over.limit(1).count():
            return done
        level = written(_split(level.join(over, "key")))


def _matrix(words: list[bytes], width: int) -> np.ndarray:
    return np.array(words, dtype=f"S{width}").view(np.uint8).reshape(len(words), width)


def _letter_counts(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    m, width = letters.shape
    at = np.arange(m, dtype=np.int64)[:, None] * BANDS + (letters & (BANDS - 1))
    counts = np.bincount(at.reshape(-1), minlength=m * BANDS).reshape(m, BANDS)
    counts[:, 0] -= width - lengths  # the empty places at the end
    return counts.astype(np.float32 if width < 1024 else np.float64)


def _verified(a: np.ndarray, b: np.ndarray, longer: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Which pairs differ by one edit whose first place is in the span; b may have one letter more."""
    size = a.shape[1] - 1
    differs = a[:, :size] != b[:, :size]
    place = np.where(differs.any(axis=1), differs.argmax(axis=1), size)
    replaced = differs.sum(axis=1) == 1
    moved = a[:, :size] != b[:, 1:]  # behind the place, the letters of b stand one further
    moved &= np.arange(size) >= place[:, None]
    edited = np.where(longer, ~moved.any(axis=1), replaced)
    return edited & (lo <= place) & ((place < hi) | (hi == size))


def near_in_block(words: list[bytes], long: np.ndarray, size: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (one, two) of the near pairs of a block, each pair once."""
    lengths = size + long
    if long.all():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    letters = _matrix(words, size + 1)
    counts = _letter_counts(letters, lengths)
    square = (counts * counts).sum(axis=1)
    short = np.flatnonzero(long == 0)
    one, two = [], []
    step = max(1, 4 * CELLS // len(words))  # blocks over one place may have more than CELLS products
    for begin in range(0, len(short), step):
        rows = short[begin : begin + step]
        distance = square[rows][:, None] + square[None, :] - 2 * (counts[rows] @ counts.T)
        r, c = np.nonzero(distance <= 2)
        r = rows[r]
        kept = (long[c] == 1) | (r < c)
        r, c = r[kept], c[kept]
        for part in range(0, len(r), max(1, (1 << 22) // (size + 1))):
            x, y = r[part : part + (1 << 22) // (size + 1) + 1], c[part : part + (1 << 22) // (size + 1) + 1]
            near = _verified(letters[x], letters[y], long[y] == 1, lo, hi)
            one.append(x[near])
            two.append(y[near])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(one or [none]), np.concatenate(two or [none])


def _neighbours(batches):
    """(word, n_near, best, best_n) of the words of each block that have near words in it."""
    for piece in whole_groups(batches, "key"):
        edge = bounds(piece.column("key").to_numpy())
        words = [w.encode("latin-1") for w in piece.column("word").to_pylist()]
        n = piece.column("n").to_numpy()
        long = piece.column("long").to_numpy()
        span = np.stack([piece.column(c).to_numpy() for c in ("size", "lo", "hi")], axis=1)
        # keys that are equal by chance are told apart by their spans
        edge = np.union1d(edge, np.flatnonzero((span[1:] != span[:-1]).any(axis=1)) + 1).tolist()
        one, two = [], []
        for begin, end in zip(edge[:-1], edge[1:]):
            if end - begin > 1:
                a, b = near_in_block(words[begin:end], long[begin:end], *span[begin].tolist())
                if len(a):
                    one += [begin + a, begin + b]
                    two += [begin + b, begin + a]
        if not one:
            continue
        x, y = np.concatenate(one), np.concatenate(two)
        if not len(x):
            continue
        spelled = np.array(words, dtype=object)[y]
        by_word = np.empty(len(y), dtype=np.int64)
        by_word[np.argsort(spelled, kind="stable")] = np.arange(len(y))
        order = np.lexsort((by_word, -n[y], x))
        x, y = x[order], y[order]
        first = bounds(x)
        top = first[:-1]
        yield pa.RecordBatch.from_arrays(
            [
                piece.column("word").take(pa.array(x[top])), pa.array(np.diff(first), pa.int64()),
                piece.column("word").take(pa.array(y[top])), pa.array(n[y[top]], pa.int64()),
            ],
            ["word", "n_near", "best", "best_n"],
        )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form (word, form): each round doubles the steps taken."""
    level = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = level.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(level.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        level = after.select("word", "root")
        if not after.filter(F.col("next").isNotNull()).limit(1).count():
            return level


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the vocabulary.

    Words are runs of letters with A-Z lower-cased; by a hash of id and run some
    lose a letter, as a misspelling would. Null and empty texts have none. A
    row with a null id is hashed as if its id were empty; repeated rows count
    again. Ties of the near words' counts go to the smaller word. Other columns
    are not read, and an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    words = written(vocabulary(docs, id_col, text_col))
    near = (
        blocks(words, cells).repartition("key").sortWithinPartitions("key", "size", "lo", "hi")
        .mapInArrow(_neighbours, "word string, n_near bigint, best string, best_n bigint")
        .groupBy("word").agg(
            F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("down"), "best")).alias("top")
        )
    )
    is_form = -F.col("top.down") >= 2 * F.col("n")
    found = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("top.best")).alias("form"), F.when(is_form, -F.col("top.down")).alias("form_n"),
    ))
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
