"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's signature has POSITIONS symbols of b = 16 bits, each the low bits
of one minwise hash of its word shingles. The distance of two signatures is the
number of positions that differ. Cut into CHUNKS chunks, two signatures within
RADIUS differ by at most ERRORS positions in one chunk (pigeonhole), so
enumerating each chunk with every choice of ERRORS positions left out gives two
such signatures an equal key: no pair within the radius is missed. Similarity
0.75 differs in 20 of 80 positions on average. Pairs beyond the radius are
mostly found too, as some chunk is usually better than the average: one with
similarity 0.75 stays unseen once in ten million.

Equal keys only propose. Shared keys link each document to one leader of the key
(never all pairs), links are confirmed on the full shingle sets, and their
components are merged: first with the smallest id as the leader, then in a few
rounds, for keys that still hold several components, with a member of the
largest one. What is then still apart under one key is compared pair by pair,
each pair once: by a longer sketch of SKETCH positions of 2 bits, which is a few
bit operations inside the join, and by the full sets. So a document that
differs from all leaders but not from another document is not lost. Documents
with equal shingle sets are one class with one representative.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import components, lists, over_slices, prepare
from lendlens.llm.words import HASH2, NOT_SPACE, mix, rolling, words
from lendlens.operators.cache import written

SHINGLE = 5
SIMILARITY = 75  # per cent of the union
CHUNKS, CHUNK = 16, 5
POSITIONS = CHUNKS * CHUNK
ERRORS = 1
RADIUS = CHUNKS * (ERRORS + 1) - 1  # within it, no pair is missed
LEADERS = 4  # of the keys of an id that it is compared with in a round
FEW = 20  # a round that confirms less than one pair in so many is the last one
ROUNDS = 3  # further leaders of a key before its pairs are compared one by one
# sketches of similarity 0.75 differ in 96 positions on average, with a deviation of 8.8
SKETCH, SKETCH_RADIUS = 512, 142
PLANES = 2 * SKETCH // 64
# and so do the longer ones in 384, with a deviation of 17.7
LONG_SKETCH, LONG_RADIUS = 2048, 476
FINE = (LONG_SKETCH - SKETCH) // 64  # words of a bit of the positions that only the longer sketch has

_RNG = np.random.default_rng(29)
_FACTOR = _RNG.integers(0, 2**31, LONG_SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, LONG_SKETCH, dtype=np.uint32)
_KEY_SALT = _RNG.integers(0, 2**63, (CHUNKS, CHUNK), dtype=np.uint64)


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat with offsets.

    Words are runs without white space, A-Z lower-cased. With fewer than n
    words the whole sequence is one shingle; without words the set is empty.
    """
    w = words(column, NOT_SPACE, lower=True)
    hashes = w.hashes(HASH2)
    rolled = rolling(hashes, n)
    sets, sizes = [], np.zeros(len(column), dtype=np.int64)
    for r in range(len(column)):
        begin, end = int(w.first[r]), int(w.first[r + 1])
        if end - begin >= n:
            own = np.unique(rolled[begin : end - n + 1])
        elif end > begin:
            own = rolling(np.concatenate([hashes[begin:end], np.full(n - end + begin, end - begin, np.uint64)]), n)
        else:
            continue
        sets.append(own)
        sizes[r] = len(own)
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def signatures(flat: np.ndarray, offsets: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """A row of 16-bit symbols for each non-empty set."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(full), positions), dtype=np.uint16)
    if len(full):
        x = (flat >> np.uint64(32)).astype(np.uint32)
        begin = offsets[full]
        for k in range(positions):
            least = np.minimum.reduceat(x * _FACTOR[k] + _ADD[k], begin)
            out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def sketches(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of 64-bit words for each non-empty set: the low bits of the sketch's symbols, then the next ones.

    The second array holds the same of the symbols that only the longer sketch has.
    """
    symbols = signatures(flat, offsets, LONG_SKETCH)

    def planes(part: np.ndarray) -> np.ndarray:
        both = [np.packbits((part >> bit & 1).astype(np.uint8), axis=1) for bit in (np.uint16(0), np.uint16(1))]
        return np.concatenate(both, axis=1).view(np.int64)

    return planes(symbols[:, :SKETCH]), planes(symbols[:, SKETCH:])


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """Keys of each signature: each chunk with each choice of one position left out.

    The low 7 bits of a key say which choice it is.
    """
    s = signature.reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
    keys = np.empty((len(s), CHUNKS, CHUNK), dtype=np.uint64)
    for out in range(CHUNK):
        packed = np.zeros(s.shape[:2], dtype=np.uint64)
        for j in range(CHUNK):
            if j != out:
                packed = (packed << np.uint64(16)) | s[:, :, j]
        keys[:, :, out] = mix(packed ^ _KEY_SALT[:, out])
    keys = keys.reshape(len(s), -1)
    return (keys & ~np.uint64(127)) | np.arange(keys.shape[1], dtype=np.uint64)


def _digests(flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A digest of each set: equal sets are one class."""
    return [
        hashlib.blake2b(flat[offsets[r] : offsets[r + 1]].tobytes(), digest_size=16).digest()
        for r in range(len(offsets) - 1)
    ]


def _sketch(piece: pa.RecordBatch) -> pa.RecordBatch:
    flat, offsets = shingle_sets(piece.column("text"))
    sizes = np.diff(offsets)
    found = signatures(flat, offsets)
    per_row = np.where(sizes > 0, POSITIONS, 0)
    return pa.RecordBatch.from_arrays(
        [
            piece.column("id"), piece.column("exact"), pa.array(sizes, pa.int64()),
            pa.array(_digests(flat, offsets), pa.binary()),
            lists(found.reshape(-1).view(np.int16), np.concatenate([[0], np.cumsum(per_row)]), pa.int16()),
        ],
        ["id", "exact", "n", "digest", "signature"],
    )


def _keys(batches):
    for b in batches:
        if b.num_rows:
            flat = b.column("signature").flatten().to_numpy(zero_copy_only=False).view(np.uint16)
            keys = chunk_keys(flat.reshape(b.num_rows, POSITIONS))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.reshape(-1).view(np.int64), pa.int64()),
                    b.column("id").take(pa.array(np.repeat(np.arange(b.num_rows), keys.shape[1]))),
                ],
                ["key", "id"],
            )


def _confirm(percent: int):
    """Keeps the pairs whose full shingle sets are similar enough."""

    def run(batches):
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, dtype=np.uint64))
        for b in batches:
            a_text, b_text = b.column("a_text").to_pylist(), b.column("b_text").to_pylist()
            keep = np.zeros(b.num_rows, dtype=bool)
            for r in range(b.num_rows):
                if a_text[r] != last[0]:  # pairs come sorted by a
                    last = (a_text[r], shingle_sets(pa.array([a_text[r]], pa.string()))[0])
                other = shingle_sets(pa.array([b_text[r]], pa.string()))[0]
                common = len(np.intersect1d(last[1], other, assume_unique=True))
                keep[r] = 100 * common >= percent * (len(last[1]) + len(other) - common)
            out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"])
            yield out.filter(pa.array(keep))

    return run


SKETCHED = [f"plane{k}" for k in range(PLANES)]


def _involved(batches):
    """Texts of classes, with their sketch as columns; other texts of a class's document are left out."""
    for b in batches:
        for begin in range(0, b.num_rows, 256):
            piece = b.slice(begin, 256)
            flat, offsets = shingle_sets(piece.column("text"))
            own = [d == e for d, e in zip(_digests(flat, offsets), piece.column("digest").to_pylist())]
            kept = np.array(own, dtype=bool)[np.diff(offsets) > 0]
            made, fine = (words[kept] for words in sketches(flat, offsets))
            piece = piece.filter(pa.array(own))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id"), piece.column("text"), *(pa.array(made[:, k].copy()) for k in range(made.shape[1])),
                    lists(fine.reshape(-1), np.arange(len(fine) + 1) * 2 * FINE, pa.int64()),
                ],
                ["id", "text", *SKETCHED, "fine"],
            )


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose texts are similar."""
    one = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
    two = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    both = pairs.join(one, "b").join(two, "a").select("a", "a_text", "b", "b_text")
    return written(both.mapInArrow(_confirm(percent), pairs.schema))


def _nearest(led: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b): to each id (b) the leaders (a) that it shares most keys with."""
    # an id has a leader a key, so a list has at most as many as there are keys of one signature
    shared = led.groupBy("id", "leader").agg((-F.count(F.lit(1))).alias("n"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("n", "leader"))), 1, most)
    return shared.groupBy("id").agg(first.alias("first")).select(F.explode("first.leader").alias("a"), F.col("id").alias("b"))


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, id, component) of the keys that hold several components."""
    labelled = members.join(labels.hint("merge"), "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component")
    )
    keys = (
        labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low != high").select("key")
    )
    return written(labelled.join(keys.hint("merge"), "key"))


def _outside(apart: DataFrame, number: int) -> DataFrame:
    """Members (key, id, component) with a leader drawn from their key's largest component, and whether they are inside it."""
    drawn = F.min(F.struct(F.xxhash64(F.lit(number), F.col("id")), F.col("id")))["id"]
    parts = apart.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), drawn.alias("leader"))
    leaders = parts.groupBy("key").agg(F.max(F.struct("n", "leader", "component")).alias("top")).select(
        "key", "top.leader", F.col("top.component").alias("own")
    )
    return apart.join(leaders.hint("merge"), "key").withColumn("inside", F.col("component") == F.col("own")).drop("own")


def _across(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids that share a key across components and have near sketches, each once.

    One of the two is outside the key's largest component, so its members are not
    compared with each other. A pair that shares several keys is met in each, and
    comes out of the least of them.
    """
    # at most the keys of one signature; a pair of two components meets under each of them that it shares
    held = apart.groupBy("id").agg(F.collect_list("key").alias("keys"))
    sketched = texts.select("id", *SKETCHED, "fine").join(held.hint("merge"), "id")

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(sketched, "id").select(
            F.col("key") if name == "a" else F.col("key").alias("key_b"),
            *(F.col(c).alias(f"{c}_{name}") for c in ["id", "component", "inside", "keys", *SKETCHED, "fine"]),
        )

    parted = _outside(apart, 0)
    one, two = side(parted.filter(~F.col("inside")), "a"), side(parted, "b")

    def differs(k: int) -> Column:
        low = F.col(f"plane{k}_a").bitwiseXOR(F.col(f"plane{k}_b"))
        high = F.col(f"plane{k + PLANES // 2}_a").bitwiseXOR(F.col(f"plane{k + PLANES // 2}_b"))
        return F.bit_count(low.bitwiseOR(high))

    distance = sum((differs(k) for k in range(1, PLANES // 2)), differs(0))
    least = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")
    unlike = F.zip_with("fine_a", "fine_b", lambda a, b: a.bitwiseXOR(b))
    longer = F.aggregate(F.sequence(F.lit(0), F.lit(FINE - 1)), distance, lambda n, k: n + F.bit_count(
        F.get(unlike, k).bitwiseOR(F.get(unlike, k + FINE))
    ))
    # one condition, so that the cheap tests come first
    once = F.col("inside_b") | (F.col("id_a") < F.col("id_b"))
    near = F.when(once & (F.col("component_a") != F.col("component_b")), F.when(distance <= SKETCH_RADIUS, F.when(least, longer <= LONG_RADIUS)))
    return one.join(two, (F.col("key") == F.col("key_b")) & F.coalesce(near, F.lit(False))).select(
        F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")
    )


def _judged(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(id, exact, n, component) for each row; exact is a digest of the row's whole text."""
    if percent < SIMILARITY:
        raise ValueError(f"percent is {percent}, but keys and sketches find pairs from {SIMILARITY} per cent on")
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = written(rows.withColumn("exact", F.sha2(F.col("text"), 256)).mapInArrow(
        over_slices("text", _sketch),
        f"id {kind}, exact string, n bigint, digest binary, signature array<smallint>",
    ))
    # a class of equal sets goes by its smallest id, or by its digest if an id may have several texts
    repeated = sketched.groupBy("id").count().filter("count > 1 and id is not null").limit(1).count() > 0
    name, kind = ("digest", "binary") if repeated else ("rep", kind)
    classes = written(
        sketched.filter("n > 0 and id is not null").groupBy("digest")
        .agg(F.min("id").alias("rep"), F.first("signature").alias("signature"))
        .select(F.col(name).alias("id"), "digest", "rep", "signature")
    )
    keyed = classes.select("id", "signature").mapInArrow(_keys, f"key bigint, id {kind}")
    leaders = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(keyed.join(leaders.hint("merge"), "key").select("key", "id", "leader"))

    involved = classes.select("id", "digest", "rep").join(shared.select("id").distinct().hint("merge"), "id")
    texts = (
        rows.withColumnRenamed("id", "rep").join(involved, "rep").select("id", "text", "digest")
        .mapInArrow(_involved, f"id {kind}, text string, " + ", ".join(f"{c} bigint" for c in SKETCHED) + ", fine array<bigint>")
    )
    texts = written(texts.dropDuplicates(["id"]) if repeated else texts)
    links = _confirmed(_nearest(shared.filter("id != leader"), LEADERS), texts, percent)
    labels = components(links)
    apart = _apart(shared.select("key", "id"), labels)
    for number in range(ROUNDS):
        led = written(_nearest(_outside(apart, number).filter(~F.col("inside")), LEADERS))
        found = _confirmed(led, texts, percent)
        links = links.unionByName(found)
        behind = found.count()
        if FEW * behind < led.count():
            break  # older labels only leave a few more pairs to compare
        labels, behind = components(links), 0
        apart = _apart(apart.select("key", "id"), labels)
    found = _confirmed(_across(apart, texts), texts, percent)
    if behind or found.limit(1).count():
        labels = components(links.unionByName(found))

    of_class = classes.select("id", F.col("digest").alias("d"), "rep").join(labels, "id", "left").select(
        "d", "rep", F.coalesce("component", "id").alias("component")
    )
    if repeated:  # components go by digests
        least = of_class.groupBy("component").agg(F.min("rep").alias("least"))
        of_class = of_class.join(least, "component").withColumn("component", F.col("least"))
    of_class = of_class.select("d", "component")
    out = sketched.join(of_class, (F.col("digest") == F.col("d")) & (F.col("n") > 0), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", "exact", "n", component.alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILARITY) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row.

    Null and empty texts have no shingles and link with nothing: their
    component is their own id. Rows with equal sets are linked. Repeated rows
    have one component; an id with several texts is judged text by text, and all
    of them take part. A row with a null id takes part in nothing and gets a null
    component; it is kept. Other columns are not read. An empty table gives an
    empty result. Chunks and sketches are sized for SIMILARITY; a lower percent
    would miss pairs and is an error.
    """
    return _judged(docs, id_col, text_col, percent).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without those whose text is near that of a document with a smaller id."""
    gone = _judged(docs, id_col, text_col, SIMILARITY).filter("id != component").select(
        F.col("id").alias("__gone"), F.col("exact").alias("__text")
    )
    same = (F.col(id_col) == F.col("__gone")) & (F.sha2(F.col(text_col), 256) == F.col("__text"))
    return docs.join(gone, same, "left_anti")
