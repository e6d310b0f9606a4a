"""Secret scans: fixed patterns, and novelty under a primed compressor.

Strings of known shapes are found by pattern. Beside them, each string of 16
characters or more in a sensitive context is a candidate: a word such as `auth`
or `password` ends at most REACH characters before it. Line breaks and shorter
strings count towards REACH, other long strings do not, so all arguments of a
call and all lines of a key block are candidates. Where a long string holds `=`
inside, its parts of 16 characters or more are measured, and it may hold the
word itself; if no part is novel, the whole string is measured.

The novelty of a candidate is the number of bytes it adds when the surrounding
text and it are compressed together, by zstandard primed with a dictionary of
identifiers and of the text around, without copies of the candidate. A string
that stays nearly as long as it is cannot be a word, a name or made of its
context, and is reported.

Each text is scanned whole by itself, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import extended, over_slices, prepare

CONTEXT = 256  # characters on either side that a candidate is compressed with
REACH = 128  # characters between a sensitive word and a candidate, without long strings
NOVEL = 0.6  # marginal compressed bytes for each byte of a reported string
KINDS = ["assign", "access", "hex", "novel"]

# fixed patterns, with the least length of the string that counts
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

# words that make a context sensitive, and names that often stand in code
SENSITIVE = (
    "auth", "bearer", "credential", "private", "passphrase", "pwd", "cookie", "session", "signature", "key", "password",
    "passwd", "secret", "token",
)
WORD = re.compile(f"(?=({'|'.join(SENSITIVE)}))", re.ASCII | re.IGNORECASE)  # words may overlap
STRING = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:=*\Z)?")
IDENTIFIERS = (
    "authorization authenticate credential private_key public_key signature session_id cookie bearer passphrase "
    "password username client_id client_secret access_token refresh_token api_key secret_key endpoint connection "
    "configuration environment parameter function return import export default string integer boolean undefined "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 https://www.example.com/index.html "
)


def novelty(candidate: str, before: str, after: str) -> float:
    """Compressed bytes that the candidate adds to its surroundings, for each of its bytes.

    Of the text around, CONTEXT characters on either side count. What is given
    beyond them tells a copy of the candidate that begins or ends there.
    """
    blank = " " * len(candidate)
    before, after = before.replace(candidate, blank)[-CONTEXT:], after.replace(candidate, blank)[:CONTEXT]
    around = (IDENTIFIERS + before + after).encode()
    primed = zstandard.ZstdCompressionDict(around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False)
    plain = (before[-32:] + after[:32]).encode()
    with_it = (before[-32:] + candidate + after[:32]).encode()
    return (len(pack.compress(with_it)) - len(pack.compress(plain))) / len(candidate.encode())


def _candidates(text: str) -> Iterator[list[tuple[int, int]]]:
    """The parts to measure of each long string in a sensitive context, and the whole string last."""
    words = ((m.start(), m.end(1)) for m in WORD.finditer(text))
    word = next(words, None)
    long = 0  # characters of long strings so far
    last = None  # where the last word ended, without long strings
    for m in STRING.finditer(text):
        begin, end = m.span()
        while word and word[1] <= begin:
            last, word = word[1] - long, next(words, None)
        near = last is not None and begin - long - last <= REACH
        inside = end
        while word and word[0] < end:  # words are of the string's characters, so they end in it
            inside, last, word = min(inside, word[1]), begin - long, next(words, None)
        parts = [(begin + p.start(), begin + p.end()) for p in PART.finditer(m[0])] if "=" in m[0] else []
        parts = [p for p in parts if p != (begin, end) and (near or inside <= p[0])]
        if near or parts:
            yield [*parts, (begin, end)] if near else parts
        long += end - begin


def _novel(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the novel candidates that meet no span of another kind; taken are those by begin."""
    begins = [a for a, _, _ in taken]
    ends = list(accumulate((b for _, b, _ in taken), max))

    def counts(begin: int, end: int) -> bool:
        k = bisect_left(begins, end)  # of those that begin before the end, one may end after the begin
        if k and ends[k - 1] > begin:
            return False
        reach = CONTEXT + end - begin
        return novelty(text[begin:end], text[max(0, begin - reach) : begin], text[end : end + reach]) >= NOVEL

    found = []
    for *parts, whole in _candidates(text):
        novel = [p for p in parts if counts(*p)]
        found += novel or [whole] * counts(*whole)
    return [(a, b, "novel") for a, b in found]


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the secrets of a whole text, in code points, by begin and kind."""
    if not text:
        return []
    low = text.lower()
    found = []
    if any(word in low for word in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if any(word in low for word in SENSITIVE):
        found += _novel(text, sorted(found))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scanned(docs: DataFrame, text_col: str = "text", column: str = "secrets") -> DataFrame:
    """The documents with an array of their secrets: begin, end (exclusive) and kind.

    Code points of the whole text count. A null or empty text has none. Rows are
    scanned one by one, so repeated rows get equal results; other columns pass
    through, but one named `column` is replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(column)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = [
            [{"begin": a, "end": b, "kind": k} for a, b, k in spans(text)] for text in piece.column(text_col).to_pylist()
        ]
        return pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, kind)], [*piece.schema.names, column])

    return docs.mapInArrow(
        over_slices(text_col, step), extended(docs, (column, "array<struct<begin:int,end:int,kind:string>>"))
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts and a digest of the base spans, and all spans, for each row of documents."""
    out = scanned(docs.select("doc_id", "text"))

    def of(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def told(spans_):
        return F.array_join(F.transform(spans_, lambda s: F.concat_ws(
            ":", s["kind"], s["begin"].cast("string"), s["end"].cast("string")
        )), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return out.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("secrets")).alias("spans"),
    )


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each secret's characters replaced by a digest of eight hex digits."""
    out, at = [], 0
    for begin, end, kind in found:
        if begin >= at:
            out += [text[at:begin], f"<{kind}:{hashlib.sha256(text[begin:end].encode()).hexdigest()[:8]}>"]
            at = end
    return "".join([*out, text[at:]])
