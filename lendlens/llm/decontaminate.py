"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive benchmark words. All patterns of one
length share a shift table over hashed blocks of two words: at a block no
pattern contains, the search skips nearly a whole window. A block with shift 0
ends some pattern; its suffix-hash bucket names the candidates, and the words
themselves are compared. Patterns are broadcast in blocks of bounded size, and
documents are streamed once through each, whole and without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendlens.llm.common import lists, over_slices, prepare
from lendlens.llm.words import ALPHANUMERIC, Words, mix, rolling, words

WINDOW = 10
BLOCK_PATTERNS = 50_000  # patterns broadcast at once
MAX_WORD_BYTES = 4096  # longer patterns are compared by digest, so that a broadcast stays bounded
SEGMENT = 512  # words that one cursor searches
TABLE_BITS = 20


def windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows (pattern, length, items, word hashes) of the benchmark.

    A shorter item is one window; an item without an id counts for hits, not for items.
    """

    def cut(piece: pa.RecordBatch) -> pa.RecordBatch:
        w = words(piece.column(text_col), ALPHANUMERIC, lower=True)
        ids = piece.column(id_col)
        hashes = w.hashes().view(np.int64)
        item, pattern, length, parts = [], [], [], []
        for r in range(piece.num_rows):
            begin, end = int(w.first[r]), int(w.first[r + 1])
            for s in range(begin, max(begin + (end > begin), end - n + 1)):
                stop = min(s + n, end)
                item.append(r)
                pattern.append(_key(w.text(s, stop)))
                length.append(stop - s)
                parts.append(hashes[s:stop].tolist())
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(item, pa.int64())), pa.array(pattern, pa.binary()),
                pa.array(length, pa.int32()), pa.array(parts, pa.list_(pa.int64())),
            ],
            ["item", "pattern", "length", "hashes"],
        )

    id_type = benchmark.schema[id_col].dataType.simpleString()
    cuts = benchmark.select(id_col, text_col).mapInArrow(
        over_slices(text_col, cut), f"item {id_type}, pattern binary, length int, hashes array<bigint>"
    )
    return cuts.groupBy("pattern", "length").agg(
        F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"), F.first("hashes").alias("hashes")
    )


def _key(text: bytes) -> bytes:
    return text if len(text) <= MAX_WORD_BYTES else b"\x00" + hashlib.sha256(text).digest()


class Patterns:
    """Shift table, suffix buckets and patterns of one length."""

    def __init__(self, length: int, texts: list[bytes], hashes: np.ndarray, items: list[list[str]]):
        """hashes: those of the words of each pattern, one row each."""
        self.m, self.b, self.texts, self.items = length, min(2, length), texts, items
        blocks = _blocks(hashes.reshape(-1), self.b).reshape(-1)
        # a block lies inside one pattern where it does not cross into the next row
        at = np.arange(len(texts))[:, None] * length + np.arange(length - self.b + 1)[None, :]
        blocks = blocks[at]
        self.shift = np.full(1 << TABLE_BITS, length - self.b + 1, dtype=np.int16)
        for j in range(length - self.b + 1):
            slot = (blocks[:, j] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            np.minimum.at(self.shift, slot, np.int16(length - self.b - j))
        self.buckets: dict[int, list[int]] = defaultdict(list)
        for k, h in enumerate(blocks[:, -1].tolist()):
            self.buckets[h].append(k)
        self.firsts = np.unique(hashes[:, 0])

    def find(self, w: Words, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of each occurrence."""
        m, b = self.m, self.b
        blocks = _blocks(hashes, b)  # blocks[i] ends at word i + b - 1
        # cursors stand on the last word of a window; a segment's windows begin inside it
        n_words = np.diff(w.first)
        n_windows = np.maximum(0, n_words - m + 1)
        parts = -(-n_windows // SEGMENT)
        row = np.repeat(np.arange(len(n_words)), parts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        cursor = w.first[row] + nth * SEGMENT + m - 1
        stop = w.first[row] + np.minimum((nth + 1) * SEGMENT, n_windows[row]) + m - 1
        while len(cursor):
            block = blocks[cursor - b + 1]
            step = self.shift[(block >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].astype(np.int64)
            at = np.flatnonzero(step == 0)
            if len(at):
                begin = cursor[at] - m + 1
                near = np.searchsorted(self.firsts, hashes[begin])
                near[near == len(self.firsts)] = 0
                likely = self.firsts[near] == hashes[begin]
                for s, h in zip(begin[likely].tolist(), block[at][likely].tolist()):
                    bucket = self.buckets.get(h)
                    if bucket:
                        text = _key(w.text(s, s + m))
                        for k in bucket:
                            if self.texts[k] == text:
                                yield s, k
            cursor = cursor + np.maximum(step, 1)
            more = cursor < stop
            cursor, stop = cursor[more], stop[more]


def _blocks(hashes: np.ndarray, b: int) -> np.ndarray:
    return mix(hashes) if b == 1 else rolling(hashes, b)


def _compile(rows: list) -> list[tuple]:
    """The plain parts of the patterns of a block, by length: (length, keys, word hashes, items)."""
    by_length = defaultdict(list)
    for r in rows:
        by_length[r["length"]].append(r)
    return [
        (n, [bytes(r["pattern"]) for r in rs], np.array([r["hashes"] for r in rs], dtype=np.int64), [r["items"] for r in rs])
        for n, rs in sorted(by_length.items())
    ]


def search(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = WINDOW,
    item_col: str = "item_id", item_text_col: str = "text", found: str = "found",
) -> DataFrame:
    """The documents with a struct column: n_words, hits (begin and end word, merged), items.

    Words are maximal runs of letters, digits and non-ASCII characters, with
    A-Z lower-cased. A null or empty text has no words. Repeated rows are
    searched alike. An empty benchmark hits nothing. Other columns pass through,
    but one named `found` is replaced.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.drop(found)
    patterns = windows(benchmark, n, item_col, item_text_col)
    total = patterns.count()
    n_blocks = max(1, -(-total // BLOCK_PATTERNS))
    shape = T.StructType([
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ])
    out = docs
    for block in range(n_blocks):
        rows = patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(n_blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(_compile(rows))
        schema = T.StructType([*docs.schema.fields, T.StructField(found, shape)])
        out = out.mapInArrow(_searcher(shared, text_col, found, block > 0), schema)
    return out


def _searcher(shared, text_col: str, found: str, again: bool):
    def run(batches):
        classes = [
            Patterns(length, texts, hashes.view(np.uint64), items)
            for length, texts, hashes, items in shared.value
        ]

        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            w = words(piece.column(text_col), ALPHANUMERIC, lower=True)
            hashes = w.hashes()
            depth = np.zeros(len(hashes) + 1, dtype=np.int64)
            items: list[set[str]] = [set() for _ in range(piece.num_rows)]
            if again:
                before = piece.column(found)
                hits = before.field("hits")
                for r, (h, i) in enumerate(zip(hits.to_pylist(), before.field("items").to_pylist())):
                    items[r].update(i)
                    for s, e in zip(h[::2], h[1::2]):
                        depth[w.first[r] + s] += 1
                        depth[w.first[r] + e] -= 1
            for c in classes:
                for s, k in c.find(w, hashes):
                    depth[s] += 1
                    depth[s + c.m] -= 1
                    items[w.row[s]].update(c.items[k])
            hit = np.cumsum(depth[:-1]) > 0
            n_rows = piece.num_rows
            new_row = np.zeros(len(hit), dtype=bool)
            new_row[w.first[:-1][np.diff(w.first) > 0]] = True
            prev = np.zeros(len(hit), dtype=bool)
            prev[1:] = hit[:-1]
            begin = np.flatnonzero(hit & (~prev | new_row))
            last_row = np.zeros(len(hit), dtype=bool)
            last_row[:-1] = new_row[1:]
            last_row[-1:] = True
            nxt = np.zeros(len(hit), dtype=bool)
            nxt[:-1] = hit[1:]
            end = np.flatnonzero(hit & (~nxt | last_row)) + 1
            base = w.first[w.row[begin]]
            flat = np.stack([begin - base, end - base], axis=1).reshape(-1)
            per_row = 2 * np.bincount(w.row[begin], minlength=n_rows)
            arr = pa.StructArray.from_arrays(
                [
                    pa.array(np.diff(w.first), pa.int64()),
                    lists(flat, np.concatenate([[0], np.cumsum(per_row)]), pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                ["n_words", "hits", "items"],
            )
            keep = [x for x in piece.schema.names if x != found]
            return pa.RecordBatch.from_arrays([*[piece.column(x) for x in keep], arr], [*keep, found])

        yield from over_slices(text_col, step)(batches)

    return run


def n_hit(found: str = "found"):
    """Words inside the hits of the struct that search() adds."""
    hits = F.col(f"{found}.hits")
    return F.aggregate(hits, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")),
                       lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")))["n"]


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of documents."""
    out = search(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return out.select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.size("found.hits") > 0).alias("contaminated"),
    )
