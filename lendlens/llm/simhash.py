"""SimHash near-dedup by an inverted index of byte positions with count filtering.

A fingerprint has 64 bits in BYTES bytes. Two fingerprints with at most RADIUS
differing bits differ in at most RADIUS bytes, so they share at least LEAST
bytes in place. The index lists the distinct fingerprints under the bytes they
hold at certain positions. Positions come in three groups, so that any LEAST
positions have two in one group (pigeonhole): the lists of two positions of one
group are enough to bring every such pair together. Inside a list the shared
bytes of a pair are tallied, pairs that reach LEAST are retained, and these are
verified on all bits.

A list longer than LONG is split under two further positions of each, since its
pairs must share two more; any two are tried, so no pair is lost. What is still
longer shares LEAST bytes or more throughout, as a large family of near copies
does: it is cut into tiles, and each pair of tiles is a list of its own. No pair
is sent anywhere: a list only gives links that span its components, fewer than
it has members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import bounds, components, over_slices, prepare, whole_groups, word_blocks
from lendlens.operators.cache import written

SHINGLE = 4
SEED = 42
BYTES = 8
RADIUS = 4
LEAST = BYTES - RADIUS
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
PAIRS = tuple(p for group in GROUPS for p in combinations(group, 2))
LONG = 4096  # members of a list that one comparison step takes
FEW = 48  # members of a list up to which lists are compared together

_NO_SPACE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def _digests(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of each n consecutive words, joined by blanks."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())]
    return np.array(found, dtype=np.uint64)


def _tally(digests: np.ndarray, ones: np.ndarray) -> int:
    for begin in range(0, len(digests), 1 << 15):
        part = digests[begin : begin + (1 << 15)].view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return len(digests)


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """The 64 bits of a text, each set if it is set in over half of its shingles' hashes."""
    ones, total, rest = np.zeros(64, dtype=np.int64), 0, []
    for words in word_blocks(text.translate(_NO_SPACE)):
        words = rest + words
        if len(words) >= n:
            total += _tally(_digests(words, n), ones)
            rest = words[len(words) - n + 1 :]
        else:
            rest = words
    if not total and rest:
        total = _tally(_digests(rest, len(rest)), ones)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(id_col: str, text_col: str):
    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = piece.column(text_col).cast(pa.large_binary())
        found = np.array([fingerprint(t.as_py() or b"") for t in texts], dtype=np.uint64)
        return pa.RecordBatch.from_arrays(
            [piece.column(id_col), pa.array(found.view(np.int64))], ["id", "fingerprint"]
        )

    return over_slices(text_col, step)


def _near_in_few(members: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of near pairs of the same list, for short lists one after another."""
    split = members.view(np.uint8).reshape(-1, BYTES)
    one, two = [], []
    for step in range(1, FEW):
        first = np.flatnonzero(lists[step:] == lists[:-step])
        if not len(first):
            break
        second = first + step
        shared = (split[first] == split[second]).sum(axis=1) >= LEAST
        first, second = first[shared], second[shared]
        near = np.bitwise_count(members[first] ^ members[second]) <= RADIUS
        one.append(first[near])
        two.append(second[near])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(one or [none]), np.concatenate(two or [none])


def _spanning(one: np.ndarray, two: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that join what earlier ones have not joined."""
    parent, kept = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(one.tolist(), two.tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _spanning_in_long(members: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of one list: whoever is reached leaves the members still to be compared."""
    split = members.view(np.uint8).reshape(-1, BYTES)
    left, kept = np.arange(len(members)), []
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            a = reached.pop()
            shared = np.flatnonzero((split[left] == split[a]).sum(axis=1) >= LEAST)
            near = shared[np.bitwise_count(members[left[shared]] ^ members[a]) <= RADIUS]
            if len(near):
                found = left[near].tolist()
                kept += [(a, b) for b in found]
                reached += found
                left = np.delete(left, near)
    return kept


def _links(batches):
    """Spanning links (a, b) of the components of each list."""
    for piece in whole_groups(batches, "key"):
        members = piece.column("fingerprint").to_numpy().view(np.uint64)
        edge = bounds(piece.column("key").to_numpy())
        sizes = np.diff(edge)
        of_list = np.repeat(np.arange(len(sizes)), sizes)
        places = np.flatnonzero((sizes <= FEW)[of_list])
        one, two = _near_in_few(members[places], of_list[places])
        kept = [(places[a], places[b]) for a, b in _spanning(one, two, len(places))]
        for k in np.flatnonzero(sizes > FEW):
            kept += [(edge[k] + a, edge[k] + b) for a, b in _spanning_in_long(members[edge[k] : edge[k + 1]])]
        if kept:
            ends = members[np.array(kept, dtype=np.int64)].view(np.int64)
            low, high = ends.min(axis=1), ends.max(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fingerprint", 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _key(positions: tuple[int, ...]) -> Column:
    """The positions, as a bit map, and the bytes that stand there."""
    out = F.lit(sum(1 << p for p in positions)).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(p))
    return out


def _under(rows: DataFrame, keys: list[Column]) -> DataFrame:
    return rows.select("fingerprint", F.explode(F.array(*keys)).alias("key"))


def _over(members: DataFrame, long: int) -> DataFrame:
    """(key, n) of the lists with more than ``long`` members."""
    return written(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > long))


def _tiled(members: DataFrame, over: DataFrame, long: int) -> DataFrame:
    """Members with lists that are too long cut into tiles, and a list for each two tiles."""
    tiles = F.coalesce(F.ceil(F.col("n") / long), F.lit(1)).cast("int")
    placed = members.join(over, "key", "left").withColumn("g", tiles).withColumn(
        "tile", F.pmod(F.xxhash64(F.lit(3), "fingerprint"), F.col("g").cast("long")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")
    of_two = F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))
    return placed.select("key", "fingerprint", "g", "tile", other).select(
        "fingerprint", F.when(F.col("g") == 1, F.col("key")).otherwise(of_two).alias("key")
    )


def links(fingerprints: DataFrame, long: int = LONG) -> DataFrame:
    """Links (a, b) between distinct fingerprints (a column of that name) that span the components."""
    members = written(_under(fingerprints, [_key(p) for p in PAIRS]))
    over, lists = _over(members, long), members
    if over.limit(1).count():
        # two more shared bytes: the map of the first two positions says which are left
        chosen = F.array().cast("array<bigint>")
        for p in PAIRS:
            further = combinations([x for x in range(BYTES) if x not in p], 2)
            keys = F.array(*[_key(tuple(sorted((*p, *q)))) for q in further])
            held = F.shiftrightunsigned("key", 16) == F.lit(sum(1 << x for x in p)).cast("long")
            chosen = F.when(held, keys).otherwise(chosen)
        finer = written(members.join(over, "key").select("fingerprint", F.explode(chosen).alias("key")).distinct())
        lists = members.join(over, "key", "left_anti").unionByName(_tiled(finer, _over(finer, long), long))
    return lists.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row.

    Words are runs without white space, A-Z lower-cased; with fewer words than a
    shingle the whole sequence is one. Null, empty and blank texts have the
    fingerprint zero, which links like any other. A row with a null id links
    others and has the component of its fingerprint, the smallest id in it; that
    is null if no row in it has an id. Rows that repeat an id are rows of their
    own. Other columns are not read, and an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    made = written(docs.select(id_col, text_col).mapInArrow(
        _fingerprints(id_col, text_col), f"id {kind}, fingerprint bigint"
    ))
    classes = written(made.groupBy("fingerprint").agg(F.min("id").alias("least")))
    labels = components(links(classes.select("fingerprint")))
    labelled = classes.join(labels, classes["fingerprint"] == labels["id"], "left").select(
        F.col("fingerprint").alias("f"), F.coalesce("component", "fingerprint").alias("component"), "least"
    )
    smallest = labelled.groupBy("component").agg(F.min("least").alias("smallest"))
    of_class = written(labelled.join(smallest, "component").select("f", "smallest"))
    return made.join(of_class, F.col("fingerprint") == F.col("f")).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("smallest").alias("component_id"),
    )
