"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A word (a match of the split pattern) is an array of single bytes, held as
characters U+0000 to U+00FF. A fold merges the leftmost adjacent pair of least
rank, one pair per step, until no pair has a rank; only the two ranks beside
the merged pair change. While more than SHORT pieces are left, a step merges all
pairs of least rank from the left that do not overlap. That gives the same as
one by one if no pair that these merges make on the way has a lower rank; the
step looks at all of them, and merges one pair if there is one. Ranks come from a literal map of the vocabulary, dealt
into buckets by a hash so that a lookup looks at a dozen entries. Decoding maps
ids to their bytes and concatenates them.

The fold runs once for each distinct word of the corpus, in the job that counts
the words. The ids of the FREQUENT most frequent count classes become a second
literal map of bounded size. Each place of any other word is joined to the word's
ids, and the places of a text come back to it in one array, under a digest of
the text. So the documents and the rare words' places are shuffled once each.

A long word costs its bytes times the different ranks merged in it.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.llm.common import fresh, prepare
from lendlens.operators.cache import written

FREQUENT = 1 << 16  # words that are looked up where they stand
FREQUENT_BYTES = 48  # longer words are not kept in the literal map
SHORT = 32  # pieces up to which one pair is merged per step
BUCKETS = 1 << 14
KEY_BITS = 48  # of a text's key, which each place of a rare word carries through two shuffles
NONE = 2**31 - 1  # rank of a pair that is no token


def ranks_of(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal_map(entries: dict[str, object], kind: str) -> Column:
    """A literal of maps by hash bucket; the optimizer folds it to one constant."""
    buckets: list[dict[str, object]] = [{} for _ in range(BUCKETS)]
    for key, value in entries.items():
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = value
    return F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,{kind}>>")


def _looked_up(literal: Column, key: Column) -> Column:
    bucket = F.pmod(F.crc32(key.cast("binary")), F.lit(BUCKETS)).cast("int")
    return F.try_element_at(F.get(literal, bucket), key)


def _fold(word: Column, ranks: Column) -> Column:
    """Ids of a word of byte characters, merged in the order of ranks."""

    def rank(one: Column, two: Column) -> Column:
        return bind(F.concat(one, two), lambda pair: F.coalesce(_looked_up(ranks, pair), F.lit(NONE)))

    # a state is an array of pieces, each with the rank of itself and its successor
    def piece(text: Column, pair: Column) -> Column:
        return F.struct(text.alias("piece"), pair.alias("rank"))

    def merge(state: Column, i: Column) -> Column:
        # i is the place (from 1) of the first piece of the pair
        def merged(text: Column) -> Column:
            before = F.get(state, i - 2)["piece"]
            return F.concat(
                F.slice(state, F.lit(1), F.greatest(i - 2, F.lit(0))),
                F.when(i > 1, F.array(piece(before, rank(before, text)), piece(text, rank(text, F.get(state, i + 1)["piece"]))))
                .otherwise(F.array(piece(text, rank(text, F.get(state, i + 1)["piece"])))),
                F.slice(state, i + 2, F.size(state)),
            )

        return bind(F.concat(F.get(state, i - 1)["piece"], F.get(state, i)["piece"]), merged)

    def looked_at(state: Column) -> Column:
        # the least rank and its leftmost place as one number
        def least(ranks: Column) -> Column:
            return bind(F.array_min(ranks), lambda value: F.struct(state.alias("state"), F.shiftleft(value.cast("long"), 31).bitwiseOR(
                F.array_position(ranks, value) - 1
            ).alias("least")))

        return bind(state.getField("rank"), least)

    def merge_all(state: Column, least: Column) -> Column:
        # the state after all merges, or null for a single one or if they make a pair of a lower rank on the way;
        # a pair is marked at its first piece, and of adjacent marks each other one counts, as their pairs overlap
        marks = F.array_join(F.transform(state, lambda p: F.when(p["rank"] == least, "1").otherwise("0")), "")

        def merged(mark: Column) -> Column:
            def marked(k: Column) -> Column:
                return F.coalesce(F.get(mark, k) == "1", F.lit(False))

            def made(p: Column, k: Column) -> Column:
                both = F.concat(p["piece"], F.get(state, k + 1)["piece"])
                # the rank beside the next pair's first piece, until that is merged
                early = F.when(marked(k + 2), bind(both, lambda text: rank(text, F.get(state, k + 2)["piece"])))
                return F.when(marked(k - 1), F.lit(None)).otherwise(F.struct(
                    F.when(marked(k), both).otherwise(p["piece"]).alias("piece"), p["rank"].alias("rank"),
                    marked(k).alias("new"), F.when(marked(k), early).alias("early"),
                ))

            return F.filter(F.transform(state, made), lambda p: p.isNotNull())

        def ranked(after: Column) -> Column:
            new = F.transform(after, lambda p, k: bind(F.get(after, k + 1), lambda following: piece(
                p["piece"], F.when(p["new"] | F.coalesce(following["new"], F.lit(False)), rank(p["piece"], following["piece"]))
                .otherwise(p["rank"])
            )))
            early = F.array_min(F.transform(after, lambda p: p["early"]))
            return F.when(F.coalesce(early, F.lit(NONE)) > least, bind(new, looked_at))

        def several(marks: Column) -> Column:
            mark = F.split(F.replace(marks, F.lit("11"), F.lit("10")), "")
            return F.when(
                F.length(F.replace(marks, F.lit("1"), F.lit(""))) < F.length(marks) - 1, bind(bind(mark, merged), ranked)
            )

        return bind(marks, several)

    def done(before: Column) -> Column:
        return before["least"] >= F.lit(NONE << 31)

    def single(before: Column) -> Column:
        place = before["least"].bitwiseAND(F.lit((1 << 31) - 1)).cast("int") + 1
        return bind(bind(place, lambda i: merge(before["state"], i)), looked_at)

    def short_step(before: Column, _: Column) -> Column:
        return F.when(done(before), before).otherwise(single(before))

    def step(before: Column, _: Column) -> Column:
        def tried(value: Column) -> Column:
            return bind(merge_all(before["state"], value), lambda after: F.when(
                F.shiftright(after["least"], 31) > value, after
            ).otherwise(single(before)))

        several = bind(F.shiftright(before["least"], 31).cast("int"), tried)
        return F.when(done(before), before).when(F.size(before["state"]) <= SHORT, single(before)).otherwise(several)

    def nested(start: Column, side: Column, depth: int) -> Column:
        # side ** depth steps; a state is copied by each, so that what is done should pass few
        def inner(before: Column, _: Column) -> Column:
            return F.when(done(before), before).otherwise(nested(before, side, depth - 1))

        return F.aggregate(F.sequence(F.lit(1), side), start, inner if depth > 1 else step)

    def run(characters: Column) -> Column:
        start = F.transform(characters, lambda p, k: piece(p, rank(p, F.get(characters, k + 1))))
        steps = F.sequence(F.lit(1), F.greatest(F.size(characters) - 1, F.lit(1)))
        side = F.ceil(F.cbrt(F.size(characters))).cast("int")
        last = bind(bind(start, looked_at), lambda first: F.when(
            F.size(characters) <= SHORT, F.aggregate(steps, first, short_step)
        ).otherwise(nested(first, side, 3)))["state"]
        return F.transform(last, lambda p: _looked_up(ranks, p["piece"]))

    def folded(text: Column) -> Column:
        characters = F.split(text, "")
        # a word that is a token as a whole is that token, whichever merges lead there
        return bind(_looked_up(ranks, text), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(bind(characters, run)))

    return bind(word, folded)


def _bytes(word: Column) -> Column:
    """The UTF-8 bytes of a word as characters U+0000 to U+00FF."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


class Tokenizer:
    """A vocabulary and its split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        # white space and letters as Unicode has them
        self.pattern = f"(?U){pattern}"

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def rank_map(self) -> Column:
        return _literal_map(self.ranks, "int")

    def vocabulary(self, docs: DataFrame, text_col: str) -> DataFrame:
        """Each distinct word with its ids, and the class of its count if it is short enough for a literal."""
        spoken = docs.select(F.explode(self.words(F.col(text_col))).alias("word"))
        ids = bind(self.rank_map(), lambda ranks: _fold(_bytes(F.col("word")), ranks))
        short = F.octet_length("word") <= FREQUENT_BYTES
        return written(spoken.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select(
            "word", F.when(short, F.floor(F.log2("n") * 8).cast("int")).alias("class"), ids.alias("ids")
        ))

    def encode(self, docs: DataFrame, text_col: str = "text", ids: str = "ids", most: int = FREQUENT) -> DataFrame:
        """The documents with an array of the token ids of each whole text.

        A null or empty text has no ids. No special token is recognised.
        Repeated rows stay and get equal ids; other columns pass through, but
        one named `ids` is replaced. `most` bounds the words that are looked up
        where they stand, which are those of the highest classes of counts.
        """
        _quiet(docs.sparkSession)
        vocabulary = self.vocabulary(docs, text_col)
        lowest = _lowest_class(vocabulary, most)
        frequent = F.coalesce(F.col("class") >= lowest, F.lit(False))
        common = vocabulary.filter(frequent).select("word", "ids").toArrow()
        known = _literal_map({w.as_py(): i.as_py() for w, i in zip(*common.columns)}, "array<int>")
        del common

        key, rare = fresh(docs, "key"), fresh(docs, "rare")
        text = F.col(text_col)
        digest = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << KEY_BITS) - 1))
        # what is looked up anyway has the same ids in the vocabulary
        keyed = docs.withColumn(key, digest)  # before the words are dealt out, once a text
        places = keyed.select(key, F.posexplode(self.words(text)).alias("place", "word")).filter(
            _looked_up(known, F.col("word")).isNull()
        )
        # merge joins, as a broadcast would pass through the driver
        joined = places.join(vocabulary.filter(~frequent).select("word", "ids").hint("merge"), "word")
        # equal texts have equal places; of different texts under one key each gets more than its own, and is folded below
        of_text = written(joined.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("place", "ids"))).alias(rare)))

        encoded = keyed.join(of_text.hint("merge"), key, "left")
        other = F.coalesce(F.col(rare), F.array().cast(of_text.schema[rare].dataType))

        def ordered(words: Column) -> Column:
            found = F.transform(words, lambda w, k: F.struct(k.alias("place"), _looked_up(known, w).alias("ids")))
            return F.sort_array(F.concat(F.filter(found, lambda word: word["ids"].isNotNull()), other))  # two sorted runs

        def folded(words: Column) -> Column:
            return bind(self.rank_map(), lambda ranks: F.transform(words, lambda w: _fold(_bytes(w), ranks)))

        # a text that the first pass did not see, as of an unordered limit, is folded where it stands;
        # with as many places as words a text has just its own, as those are always among them
        all_ids = bind(self.words(text), lambda words: bind(ordered(words), lambda found: F.when(
            F.size(found) == F.size(words), F.flatten(found.getField("ids"))
        ).otherwise(F.flatten(folded(words)))))
        return encoded.withColumn(ids, all_ids).select(*dict.fromkeys([*docs.columns, ids]))

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids, as binary."""
        size = max(self.ranks.values(), default=-1) + 1
        pieces = [""] * size
        for token, rank in self.ranks.items():
            pieces[rank] = token
        literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
        joined = bind(literal, lambda tokens: F.array_join(F.transform(ids, lambda i: F.get(tokens, i)), ""))
        return F.encode(joined, "ISO-8859-1")


def _lowest_class(vocabulary: DataFrame, most: int) -> int:
    """The lowest class so that it and the higher ones hold at most so many words."""
    classes = vocabulary.filter(F.col("class").isNotNull()).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    total, lowest = 0, NONE
    for r in classes.orderBy(F.desc("class")).collect():  # a few hundred at most, as counts are below 2^63
        total += r["n"]
        if total > most:
            break
        lowest = r["class"]
    return lowest


def _quiet(spark: SparkSession) -> None:
    """Plans hold the vocabulary; their printed form need not."""
    prepare(spark)
    spark.conf.set("spark.sql.maxPlanStringLength", "20000")


def report(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes for each row of documents."""
    encoded = tokenizer.encode(docs.select("doc_id", "text"))
    return digests(encoded.select("doc_id", "ids"), tokenizer)


def digests(encoded: DataFrame, tokenizer: Tokenizer, keep_ids: bool = False) -> DataFrame:
    return encoded.select(
        "doc_id", *["ids"] * keep_ids, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(tokenizer.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )
