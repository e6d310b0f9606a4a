"""Substring dedup with repeated-phrase automata.

A window is 20 consecutive words of one document; a word goes if a window over
it also starts earlier. Equal windows hold equal phrases of 4 words, so each
window is filed under the phrase with the least hash inside it (its anchor):

1. Anchors of all documents are counted; only windows under a phrase that
   recurs can recur. The windows that follow each other under one anchor are
   one passage; equal passages are merged to one with their first place and
   their number, and only the first fetches its text.
2. Passages are routed to shards by anchor. In a shard, windows that occur twice
   or more confirm recurring passages; these are compiled into Aho-Corasick
   automata of bounded size, and the shard's passages stream through them to
   locate each occurrence.
3. What was located goes back to every place of the passages in the documents,
   which are then rewritten in one pass.

An anchor with many different passages around it (a line that many documents
hold) is not one group: its windows are routed one by one under their own hash,
where equal ones merge before and after the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import over_slices, prepare
from lendlens.llm.words import HASH, HASH2, NOT_SPACE, Words, rolling, words
from lendlens.operators.cache import written

WINDOW = 20
PHRASE = 4
CROWDED = 1000  # different passages from which an anchor's windows are routed one by one
PATTERNS = 8_000  # passages compiled into one automaton
# A place is one number: 27 bits of the text's hash, 31 for the first word, 5 for the number of windows.
# Without the last 5 bits it is a spot, and spots of following words follow each other.
_TAG, _COUNT, _FIRST = 36, 5, (1 << 31) - 1


def _tags(column: pa.Array) -> np.ndarray:
    """27 bits that tell rows with one id but different texts apart."""
    return np.array(
        [0 if x is None else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=4).digest(), "big") >> 5
         for x in column.to_pylist()], dtype=np.int64,
    )


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Position of the least (leftmost of equal) of each n consecutive values."""
    best, width = np.arange(len(values)), 1
    while width < n:
        step = min(width, n - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        width += step
    return best


def _anchors(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word in the row, windows, phrase hash) of each passage."""
    empty = np.zeros(0, dtype=np.int64)
    if len(w.row) < n:
        return empty, empty, empty, empty.view(np.uint64)
    phrases = rolling(w.hashes(), PHRASE)
    best = _least(phrases, n - PHRASE + 1)
    start = np.flatnonzero(w.row[: len(w.row) - n + 1] == w.row[n - 1 :])
    if not len(start):
        return empty, empty, empty, empty.view(np.uint64)
    anchor = best[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(new)
    first = start[begin]
    count = np.diff(np.append(begin, len(start)))
    return w.row[first], first - w.first[w.row[first]], count, phrases[anchor[begin]]


def _file(n: int):
    """(anchor, digest, doc, place) of each passage."""

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        column = piece.column("text")
        w = words(column, NOT_SPACE)
        row, first, count, phrase = _anchors(w, n)
        place = (_tags(column)[row] << _TAG) | (first << _COUNT) | count
        begin = w.first[row] + first
        digest = HASH2.runs(w.hashes(HASH2), begin, begin + count + n - 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(phrase.view(np.int64)), pa.array(digest.view(np.int64)),
                piece.column("doc").take(pa.array(row)), pa.array(place),
            ],
            ["anchor", "digest", "doc", "place"],
        )

    return over_slices("text", step)


_TEXTS = (
    "key bigint, digest bigint, passage binary, doc bigint, spot bigint, n bigint, "
    "of_key bigint, of_digest bigint, nth bigint"
)


def _texts(n: int, crowded: bool):
    """The passages marked in a document; those of crowded anchors as single windows."""
    names = [c.split()[0] for c in _TEXTS.split(", ")]

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        column = piece.column("text")
        w = words(column, NOT_SPACE)
        tags = _tags(column)
        marks = piece.column("marks")
        at = marks.offsets.to_numpy() - marks.offsets[0].as_py()
        row = np.repeat(np.arange(piece.num_rows), np.diff(at))
        m = {f: marks.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("anchor", "digest", "place", "n", "crowded")}
        own = ((m["place"] >> _TAG) == tags[row]) & (m["crowded"] == crowded)
        row, m = row[own], {f: v[own] for f, v in m.items()}
        count = m["place"] & ((1 << _COUNT) - 1)
        lines = count if crowded else np.ones(len(row), dtype=np.int64)
        line = np.repeat(np.arange(len(row)), lines)
        nth = np.arange(len(line)) - np.repeat(np.cumsum(lines) - lines, lines)
        spot = (m["place"][line] >> _COUNT) + nth
        begin = w.first[row[line]] + (spot & _FIRST)
        end = begin + (n if crowded else count[line] + n - 1)
        key = HASH.runs(w.hashes(HASH), begin, end).view(np.int64) if crowded else m["anchor"][line]
        digest = HASH2.runs(w.hashes(HASH2), begin, end).view(np.int64) if crowded else m["digest"][line]
        text = [w.text(a, b) for a, b in zip(begin.tolist(), end.tolist())]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key), pa.array(digest), pa.array(text, pa.binary()),
                piece.column("doc").take(pa.array(row[line])), pa.array(spot), pa.array(m["n"][line]),
                pa.array(m["anchor"][line]), pa.array(m["digest"][line]), pa.array(nth),
            ],
            names,
        )

    return over_slices("text", step)


class _Passage:
    __slots__ = ("key", "digest", "words", "doc", "spot", "count", "found", "own")

    def __init__(self, key: int, digest: int, text: bytes, doc: int, spot: int, count: int):
        self.key, self.digest, self.doc, self.spot, self.count = key, digest, doc, spot, count
        self.words = text.decode("utf-8", "surrogateescape").split(" ")
        self.found = self.own = 0


def _locate(shard: list[list[_Passage]], n: int) -> Iterator[_Passage]:
    """Passages with their recurring windows, as bits, found by one automaton."""
    automaton = ahocorasick.Automaton()
    for group in shard:
        # confirm: how often and where first does each window of the group occur
        seen: dict[str, list] = {}
        cuts = []
        for p in group:
            texts = [" ".join(p.words[j : j + n]) for j in range(len(p.words) - n + 1)]
            cuts.append(texts)
            for j, t in enumerate(texts):
                place = (p.doc, p.spot + j)
                known = seen.get(t)
                if known is None:
                    seen[t] = [p.count, place]
                else:
                    known[0] += p.count
                    known[1] = min(known[1], place)
        # each run of recurring windows is a recurring passage, and a pattern
        for p, texts in zip(group, cuts):
            j = 0
            while j < len(texts):
                run = j
                while run < len(texts) and seen[texts[run]][0] > 1:
                    run += 1
                if run > j:
                    pattern = f" {' '.join(p.words[j : run + n - 1])} "
                    if pattern not in automaton:
                        automaton.add_word(pattern, (len(pattern), [seen[t][1] for t in texts[j:run]]))
                j = max(run, j + 1)
    if not len(automaton):
        return
    automaton.make_automaton()
    for group in shard:
        for p in group:
            text = f" {' '.join(p.words)} "
            for end, (length, firsts) in automaton.iter(text):
                offset = text.count(" ", 0, end - length + 1)
                for j, first in enumerate(firsts, offset):
                    p.found |= 1 << j
                    if first == (p.doc, p.spot + j):
                        p.own |= 1 << j
            if p.found:
                yield p


def _shards(n: int):
    """Decisions (key, digest, found, own, at_doc, at_spot) for passages sorted by key."""

    def emit(shard: list[list[_Passage]]) -> pa.RecordBatch:
        out = list(_locate(shard, n))
        return pa.RecordBatch.from_arrays(
            [pa.array([getattr(p, x) for p in out], pa.int64()) for x in ("key", "digest", "found", "own", "doc", "spot")],
            ["key", "digest", "found", "own", "at_doc", "at_spot"],
        )

    def run(batches):
        shard: list[list[_Passage]] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("key", "digest", "passage", "doc", "spot", "n"))):
                if not shard or shard[-1][0].key != r[0]:
                    if size >= PATTERNS:
                        yield emit(shard)
                        shard, size = [], 0
                    shard.append([])
                shard[-1].append(_Passage(*r))
                size += 1
        if shard:
            yield emit(shard)

    return run


def _rewrite(kept_text: bool, n: int, names: list[str]):
    """Documents without their removed words."""

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        column = piece.column("text")
        w = words(column, NOT_SPACE)
        tags = _tags(column)
        depth = np.zeros(len(w.row) + 1, dtype=np.int64)
        for r, marks in enumerate(piece.column("removed").to_pylist()):
            for m in marks or ():
                if m["place"] >> _TAG == tags[r]:
                    base = int(w.first[r]) + ((m["place"] >> _COUNT) & _FIRST)
                    for j in range(m["bits"].bit_length()):
                        if m["bits"] >> j & 1:
                            depth[base + j] += 1
                            depth[base + j + n] -= 1
        gone = np.cumsum(depth[:-1]) > 0
        size, removed, digest, text = [], [], [], []
        for r in range(piece.num_rows):
            a, b = int(w.first[r]), int(w.first[r + 1])
            at = np.flatnonzero(~gone[a:b]) + a
            left = b" ".join([w.data[s:e].tobytes() for s, e in zip(w.start[at].tolist(), w.end[at].tolist())])
            size.append(b - a)
            removed.append(b - a - len(at))
            digest.append(hashlib.sha256(left).hexdigest())
            text.append(left if kept_text else None)
        out = [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)]
        if kept_text:
            out.append(pa.array(text, pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays([piece.column("id"), *out], names)

    return over_slices("text", step)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW, kept_text: bool = True
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text) for each row.

    Words are runs without ASCII white space. A null or empty text has no words.
    Ids are integers; a null id is smaller than all others. Rows that repeat id
    and text are one document: their places are the same and do not repeat each
    other. Rows with one id and different texts are ordered by a hash of the text.
    Other columns are not read. An empty table gives an empty result.
    """
    if not PHRASE <= n <= 34:
        raise ValueError("a window has 4 to 34 words")
    prepare(docs.sparkSession)
    least = F.lit(-(2**63)).cast("long")
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), least).alias("doc"), F.col(text_col).alias("text"),
    )
    filed = rows.mapInArrow(_file(n), "anchor bigint, digest bigint, doc bigint, place bigint")
    # written, so that the join below has plain shuffles on both sides and a hot anchor can be split
    recurring = written(filed.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor"))
    # written, as two later steps read these few rows and would file all documents again
    places = written(filed.join(recurring, "anchor").select("anchor", "digest", "doc", "place"))
    merged = (
        places.groupBy("anchor", "digest")
        .agg(F.min(F.struct("doc", "place")).alias("at"), F.count(F.lit(1)).alias("n"))
    )
    crowded = merged.groupBy("anchor").agg(F.count(F.lit(1)).alias("passages")).filter(F.col("passages") > CROWDED)
    marks = (
        merged.join(crowded, "anchor", "left").groupBy(F.col("at.doc").alias("doc"))
        .agg(F.collect_list(F.struct(
            "anchor", "digest", F.col("at.place").alias("place"), "n", F.col("passages").isNotNull().alias("crowded")
        )).alias("marks"))
    )
    marked = rows.join(marks, "doc").select("doc", "text", "marks")

    def decided(passages: DataFrame) -> DataFrame:
        return passages.repartition("key").sortWithinPartitions("key").mapInArrow(
            _shards(n), "key bigint, digest bigint, found bigint, own bigint, at_doc bigint, at_spot bigint"
        )

    whole = decided(marked.mapInArrow(_texts(n, False), _TEXTS).select("key", "digest", "passage", "doc", "spot", "n"))
    # windows of crowded anchors are decided one by one and go back to the passages they were cut from
    windows = marked.mapInArrow(_texts(n, True), _TEXTS)
    single = decided(
        windows.groupBy("key", "digest", "passage")
        .agg(F.min(F.struct("doc", "spot")).alias("at"), F.sum("n").alias("n"))
        .select("key", "digest", "passage", "at.doc", "at.spot", "n")
    )
    bit = F.expr("shiftleft(1L, cast(nth as int))")
    is_own = (F.col("doc") == F.col("at_doc")) & (F.col("spot") == F.col("at_spot"))
    regrouped = (
        windows.select("key", "digest", "of_key", "of_digest", "nth", "doc", "spot").join(single, ["key", "digest"])
        .groupBy(F.col("of_key").alias("key"), F.col("of_digest").alias("digest"))
        .agg(
            F.bit_or(bit).alias("found"), F.bit_or(F.when(is_own, bit).otherwise(F.lit(0).cast("long"))).alias("own"),
            F.min("doc").alias("at_doc"), F.min(F.col("spot") - F.col("nth")).alias("at_spot"),
        )
    )
    decisions = whole.unionByName(regrouped).select(
        F.col("key").alias("anchor"), "digest", "found", "own", "at_doc", "at_spot"
    )
    # the first place of a window keeps it
    is_first = (F.col("doc") == F.col("at_doc")) & (F.shiftright("place", _COUNT) == F.col("at_spot"))
    bits = F.when(is_first, F.col("found").bitwiseAND(F.bitwise_not("own"))).otherwise(F.col("found"))
    removed = (
        places.join(decisions, ["anchor", "digest"])
        .select("doc", "place", bits.alias("bits")).filter("bits != 0")
        .groupBy("doc").agg(F.collect_list(F.struct("place", "bits")).alias("removed"))
    )
    names = ["id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * kept_text
    out = rows.join(removed, "doc", "left").select(F.col("doc").alias("id"), "text", "removed").mapInArrow(
        _rewrite(kept_text, n, names),
        "id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * kept_text,
    )
    return out.withColumn("id", F.nullif("id", least)).withColumnRenamed("id", id_col)


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, kept_text=False)
