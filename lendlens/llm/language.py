"""Language identification with string kernels.

The kernel of two texts is the number of blended n-grams (1 to 4 bytes of the
lower-cased text) present in both, over the root of the product of their own
numbers; n-grams are told apart by BUCKETS hash values. A text of more than
BLOCK bytes is cut into blocks of nearly equal size, so that no text fills the
buckets, and its kernel values are the mean of those of all its blocks; an
n-gram belongs to the block it begins in. Nystrom landmarks are a sample of
training texts: a text is its kernel values with the landmarks.
One ridge regression per language against the rest is solved on them, and
documents are scored by matrix products of batches: presence x landmarks, then
kernel values x coefficients.

Landmarks and training rows are bounded samples (LANDMARKS and PER_LANGUAGE);
scoring streams all whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import extended, over_slices, prepare
from lendlens.llm.sampling import counts, held_out, stratified
from lendlens.llm.words import _LOWER, mix, text_bytes

PER_LANGUAGE = 400
LANDMARKS = 40  # of each language
BUCKETS = 1 << 13
LONGEST = 4
BLOCK = 2048  # bytes of a text that share one row of buckets
RIDGE = 1e-2
SHARPNESS = 6.0  # of the softmax that turns decision values into a score
ROWS = 128  # blocks of one matrix product
UNKNOWN = "und"


def presence(column: pa.Array) -> np.ndarray:
    """A row of 0 and 1 over n-gram buckets for each text."""
    data, offsets = text_bytes(column)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    return _marked(data, row, row, len(column))


def _marked(data: np.ndarray, text: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """A row of 0 and 1 for each of n rows; text and row tell those of each byte, and an n-gram's row is its first byte's."""
    low = _LOWER[data].astype(np.uint64)
    out = np.zeros((n, BUCKETS), dtype=np.float32)
    gram = np.zeros(len(low), dtype=np.uint64)
    for size in range(1, LONGEST + 1):
        if len(low) < size:
            break
        gram = (gram[: len(low) - size + 1] << np.uint64(8)) | low[size - 1 :]
        bucket = (mix(gram + (np.uint64(size) << np.uint64(40))) >> np.uint64(51)).astype(np.int64)
        first = row[: len(row) - size + 1]
        inside = (text[: len(text) - size + 1] == text[size - 1 :]) & (first < n)
        out[first[inside], bucket[inside]] = 1.0
    return out


def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each block, its normed presence over the number of its text's blocks), ROWS blocks at a time."""
    data, offsets = text_bytes(column)
    sizes = np.diff(offsets)
    parts = np.maximum(1, -(-sizes // BLOCK))
    text = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    edge = np.append(offsets[text] + nth * sizes[text] // parts[text], offsets[-1])
    for begin in range(0, len(text), ROWS):
        end = min(begin + ROWS, len(text))
        # the last n-grams of a block reach into the next one
        reach = min(int(edge[end]) + LONGEST - 1, len(data))
        at = np.arange(edge[begin], reach)
        row = np.searchsorted(edge[begin : end + 1], at, side="right") - 1
        x = _marked(data[edge[begin] : reach], np.searchsorted(offsets, at, side="right"), row, end - begin)
        yield text[begin:end], normed(x) / parts[text[begin:end], None].astype(np.float32)


def features(column: pa.Array) -> np.ndarray:
    """The mean of the normed presence of each text's blocks."""
    out = np.zeros((len(column), BUCKETS), dtype=np.float32)
    for text, x in blocks(column):
        np.add.at(out, text, x)
    return out


def kernel(column: pa.Array, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of each text with the landmarks."""
    out = np.zeros((len(column), len(landmarks)), dtype=np.float32)
    for text, x in blocks(column):
        np.add.at(out, text, x @ landmarks.T)
    return out


def normed(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(1.0, x.sum(axis=1, keepdims=True)))


class Kernel:
    """Landmarks and one column of coefficients per language."""

    def __init__(self, landmarks: np.ndarray, coefficients: np.ndarray, languages: list[str]):
        self.landmarks, self.coefficients, self.languages = landmarks, coefficients, languages

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The best language of each text, and its softmax value."""
        names, values = [], []
        for begin in range(0, len(column), ROWS):
            decision = kernel(column.slice(begin, ROWS), self.landmarks) @ self.coefficients
            best = decision.argmax(axis=1)
            top = decision[np.arange(len(best)), best][:, None]
            names += [self.languages[k] for k in best]
            values.append(1 / np.exp(SHARPNESS * (decision - top)).sum(axis=1))
        return names, np.concatenate(values) if values else np.zeros(0)


def fit(texts: list[str], langs: list[str]) -> Kernel | None:
    """Kernel ridge regression of each language against the rest on Nystrom features."""
    languages = sorted(set(langs))
    if not languages:
        return None
    label = np.array([languages.index(v) for v in langs])
    chosen = np.concatenate([np.flatnonzero(label == k)[:LANDMARKS] for k in range(len(languages))])
    landmarks = features(pa.array([texts[i] for i in chosen], pa.string()))
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # to features whose products are the kernel
    x = np.concatenate([kernel(pa.array(texts[i : i + ROWS], pa.string()), landmarks) for i in range(0, len(texts), ROWS)])
    z = x.astype(np.float64) @ root
    share = np.bincount(label, minlength=len(languages))
    weight = 1 / share[label]  # each language counts the same
    target = np.where(label[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    gram = z.T @ (z * weight[:, None]) + RIDGE * np.eye(z.shape[1])
    solved = np.linalg.solve(gram, z.T @ (target * weight[:, None]))
    return Kernel(landmarks, (root @ solved).astype(np.float32), languages)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Kernel | None:
    """A kernel model of the languages of rows that are not held out; None without any."""
    prepare(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("doc_id"))
    sizes = counts(known.select("lang"), "lang")
    rows = stratified(known.select("doc_id", "text", "lang"), "doc_id", "lang", per_language, sizes)
    # bounded by per_language and the number of languages
    got = sorted((r["doc_id"], r["lang"], r["text"]) for r in rows.collect())
    return fit([t for _, _, t in got], [v for _, v, _ in got])


def predicted(docs: DataFrame, model: Kernel | None, text_col: str = "text") -> DataFrame:
    """The documents with lang_pred and score; `und` and 0 for a text that is null or has no letter.

    Without a learned language all texts are `und`. Rows that repeat get equal results.
    Other columns pass through, but those named lang_pred and score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        column = piece.column(text_col)
        names, values = shared.value.predict(column) if shared.value else ([UNKNOWN] * len(column), np.zeros(len(column)))
        return pa.RecordBatch.from_arrays(
            [*piece.columns, pa.array(names, pa.string()), pa.array(values, pa.float64())],
            [*piece.schema.names, "lang_pred", "score"],
        )

    out = docs.mapInArrow(
        over_slices(text_col, step), extended(docs, ("lang_pred", "string"), ("score", "double"))
    )
    written_words = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return out.withColumns({
        "lang_pred": F.when(written_words, F.col("lang_pred")).otherwise(UNKNOWN),
        "score": F.when(written_words, F.col("score")).otherwise(0.0),
    })


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of documents."""
    out = predicted(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
