"""Quality scores by Bradley-Terry pairwise ranking.

A document has a score w.x of its features. Pairs of a document labelled good
and one labelled bad are preferences; w minimises the logistic loss on their
feature differences. The threshold is the score quantile at the share of bad
labels. Features are counts over the whole text: shares of byte classes,
repeated words and lines, lengths; each enters as a step at its exact
deciles, so a score need not be linear in it.

The fit uses all labelled rows that are not held out and all their pairs,
without listing them: what a row meets in the loss depends on its own score and
on the distribution of the other label's scores. A Newton step is two passes.
The first files the scores on a grid of FINE, where a score between two points
counts for both in proportion, so the gradient is exact up to FINE squared; the
second sums gradient and curvature, for which a grid of COARSE will do, as it
does not move the minimum. Scoring streams all documents without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import extended, lists, over_slices, prepare
from lendlens.llm.sampling import held_out
from lendlens.llm.words import HASH, NOT_SPACE, byte_class, text_bytes, words
from lendlens.operators.cache import written
from lendlens.operators.quantile import exact_quantiles

PENALTY = 1e-3
STEPS = 9  # deciles at which a feature steps
FINE, COARSE = 2.0**-9, 2.0**-2  # grids of scores; the penalty bounds the scores, so also the points
MASS, EXACT = 2.0**16, 2.0**30  # parts of a score's mass, and of a weight
PASSES, TOL = 25, 1e-6
HELD = 2000  # values a quantile may bring to the driver
GROUPS = 16  # tasks' sums are added in so many groups before the driver adds these

# byte classes: lower, upper, digit, space, line end, full stop and comma, ! and ?, bars and brackets, other ASCII, non-ASCII
_CLASS = np.full(256, 8, dtype=np.int64)
_CLASS[128:] = 9
for _k, _bytes in enumerate([
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,", b"!?", b"|<>[]{}",
]):
    _CLASS[list(_bytes)] = _k
CLASSES = 10
LINE = byte_class((0x0A, 0x0A))
FEATURES = CLASSES + 12


def features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text; a null is an empty text."""
    data, offsets = text_bytes(column)
    n = len(column)
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    shares = np.bincount(row * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    out = np.zeros((n, FEATURES))
    out[:, :CLASSES] = shares / np.maximum(1, size)[:, None]
    w = words(column, NOT_SPACE, lower=True)
    hashes = w.hashes(HASH)
    length = w.end - w.start
    lines = words(column, LINE)
    line_hashes = lines.hashes(HASH)
    line_size = lines.end - lines.start
    last = w.data[w.end - 1] if len(w.end) else np.zeros(0, dtype=np.uint8)
    marked = (_CLASS[last] >= 5) & (_CLASS[last] <= 8)
    for r in range(n):
        a, b = int(w.first[r]), int(w.first[r + 1])
        c, d = int(lines.first[r]), int(lines.first[r + 1])
        x = out[r, CLASSES:]
        x[0], x[1] = np.log1p(size[r]), np.log1p(b - a)
        if b > a:
            own = np.sort(hashes[a:b])
            edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            often = np.diff(edges)
            x[2] = length[a:b].mean()
            x[3] = np.log1p(length[a:b].max())
            x[4] = len(often) / (b - a)
            x[5] = often.max() / (b - a)
            x[6] = (hashes[a + 1 : b] == hashes[a : b - 1]).mean() if b - a > 1 else 0
            x[7] = marked[a:b].mean()
            x[8] = (length[a:b] == 1).mean()
        if d > c:
            _, at = np.unique(line_hashes[c:d], return_index=True)
            x[9] = len(at) / (d - c)
            x[10] = 1 - line_size[c + at].sum() / max(1, line_size[c:d].sum())
            x[11] = (d - c) / max(1, b - a)
    return out


class Ranking:
    """Scores of feature rows: steps, weights, threshold and scale."""

    def __init__(self, steps: np.ndarray, weights: np.ndarray, threshold: float, scale: float):
        self.steps, self.weights, self.threshold, self.scale = steps, weights, threshold, scale

    def design(self, x: np.ndarray) -> np.ndarray:
        over = x[:, :, None] > self.steps[None, :, :]
        return over.reshape(len(x), -1).astype(np.float64)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.design(x) @ self.weights - self.threshold) * self.scale
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of a batch of the labelled table."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, FEATURES)
    return x, batch.column("good").to_numpy(zero_copy_only=False).astype(bool)


def _spread(scores: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """The grid point below each score, and its share of the score's mass; the next point has the rest."""
    low = np.floor(scores / unit).astype(np.int64)
    return low, np.rint((1 - (scores / unit - low)) * MASS) / MASS


def _masses(model: Ranking):
    """Per label, the mass of the scores at each point of the fine grid."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, good = _batch(b)
            low, share = _spread(model.design(x) @ model.weights, FINE)
            for label in (False, True):
                at = np.concatenate([low[good == label], low[good == label] + 1])
                if len(at):
                    mass = np.rint(np.concatenate([share[good == label], 1 - share[good == label]]) * MASS)
                    points, place = np.unique(at, return_inverse=True)
                    mass = np.bincount(place, weights=mass).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(points), label)), pa.array(points), pa.array(mass)], ["good", "point", "mass"]
                    )

    return run


def _against(mass: np.ndarray, kernel) -> np.ndarray:
    """The sum over j of mass[j] * kernel(j - i) for each grid point i."""
    n = len(mass)
    size = 1 << (3 * n).bit_length()
    k = kernel(np.arange(1 - n, n)[::-1])  # k[m] is kernel(n - 1 - m)
    return np.fft.irfft(np.fft.rfft(mass, size) * np.fft.rfft(k, size), size)[n - 1 : 2 * n - 1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _bell(z: np.ndarray) -> np.ndarray:
    p = _sigmoid(z)
    return p * (1 - p)


def _sums(model: Ranking, first: int, pulls: dict, coarse_first: int, curves: dict):
    """Per label, of all rows of a task: gradient, Gram matrix and the features' sums at each coarse point.

    Each summand is a multiple of a small power of two, so that sums do not depend on the order of rows.
    """

    def run(batches):
        width = len(model.weights)
        points = len(curves[True])
        out = {label: [np.zeros(width), np.zeros((width, width)), np.zeros((points, width))] for label in (False, True)}
        for b in batches:
            if not b.num_rows:
                continue
            x, good = _batch(b)
            design = model.design(x)
            scores = design @ model.weights
            low, share = _spread(scores, FINE)
            coarse, coarse_share = _spread(scores, COARSE)
            for label in (False, True):
                at = np.flatnonzero(good == label)
                if not len(at):
                    continue
                d, k, s = design[at], low[at] - first, share[at]
                j, t = coarse[at] - coarse_first, coarse_share[at]
                pull = pulls[label][k] * s + pulls[label][k + 1] * (1 - s)
                curve = curves[label][j] * t + curves[label][j + 1] * (1 - t)
                out[label][0] += (np.rint(pull * EXACT) / EXACT) @ d
                out[label][1] += d.T @ (d * (np.rint(curve * EXACT) / EXACT)[:, None])
                cells = np.zeros((len(at), points))
                cells[np.arange(len(at)), j] = t
                cells[np.arange(len(at)), j + 1] += 1 - t
                out[label][2] += cells.T @ d
        group = TaskContext.get().partitionId() % GROUPS
        flat = [np.concatenate([v.reshape(-1) for v in out[label]]) for label in (False, True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([False, True]), pa.array([group] * 2, pa.int32()), pa.array(flat, pa.list_(pa.float64()))],
            ["good", "part", "v"],
        )

    return run


def _added(table: pa.Table) -> pa.Table:
    v = np.sum(np.stack(table.column("v").to_numpy()), axis=0)
    return pa.table({"good": table.column("good")[:1], "v": pa.array([v], pa.list_(pa.float64()))})


def _newton(rows: DataFrame, model: Ranking, sizes: dict) -> np.ndarray:
    """The step that lowers the mean loss over all pairs, from two passes over the labelled rows."""
    found = rows.mapInArrow(_masses(model), "good boolean, point bigint, mass bigint")
    found = found.groupBy("good", "point").agg(F.sum("mass").alias("mass")).toArrow()
    points = np.asarray(found.column("point"))
    ratio = round(COARSE / FINE)
    first, last = int(points.min()) // ratio * ratio, (int(points.max()) // ratio + 2) * ratio
    coarse_first, n_coarse = first // ratio, (last - first) // ratio + 1
    pulls, curves, hat = {}, {}, 1 - np.abs(np.arange(1 - ratio, ratio)) / ratio
    labels, mass = np.asarray(found.column("good")), np.asarray(found.column("mass"))
    for label in (False, True):
        own = np.zeros(last - first + 1)
        own[points[labels == label] - first] = mass[labels == label] / (MASS * sizes[label])
        coarse = np.convolve(own, hat, "same")[::ratio]  # a coarse hat is made of fine ones
        # a bad row is pulled down by each good one and a good row up by each bad one, by the share of the pair's loss
        sign = -1 if label else 1
        pulls[not label] = -sign * _against(own, lambda z: _sigmoid(sign * z * FINE))
        curves[not label] = _against(coarse, lambda z: _bell(z * COARSE))
    parts = rows.mapInArrow(_sums(model, first, pulls, coarse_first, curves), "good boolean, part int, v array<double>")
    added = parts.groupBy("good", "part").applyInArrow(_added, "good boolean, v array<double>").toArrow()
    width = len(model.weights)
    total = {label: np.zeros(width + width * width + n_coarse * width) for label in (False, True)}
    for label, v in zip(added.column("good").to_pylist(), added.column("v")):
        total[label] += np.asarray(v.values)
    gradient, hessian, cells = PENALTY * model.weights, PENALTY * np.eye(width), {}
    for label in (False, True):
        mean = total[label] / sizes[label]
        gradient = gradient + mean[:width]
        hessian = hessian + mean[width : width + width * width].reshape(width, width)
        cells[label] = mean[width + width * width :].reshape(n_coarse, width)
    at = np.arange(n_coarse) * COARSE
    cross = cells[True].T @ _bell(at[:, None] - at[None, :]) @ cells[False]
    return np.linalg.solve(hessian - cross - cross.T, gradient)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """good and the features x of each labelled row that is not held out.

    Null ids and labels are left out; a document labelled more than once has
    its largest label.
    """
    prepare(docs.sparkSession)
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    )

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        x = features(piece.column("text"))
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), lists(x.reshape(-1), np.arange(len(x) + 1) * FEATURES, pa.float64())], ["doc_id", "x"]
        )

    # features are made before the join, which then shuffles no texts
    rows = docs.select("doc_id", "text").filter(~held_out("doc_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(over_slices("text", step), f"doc_id {kind}, x array<double>")
    return written(made.join(known.hint("merge"), "doc_id").select("good", "x"))


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    """A ranking from all pairs of labelled rows that are not held out; without both labels every score is 0.5."""
    rows = labelled(docs, labels)
    sizes = {False: 0, True: 0} | {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    model = Ranking(np.zeros((FEATURES, STEPS)), np.zeros(FEATURES * STEPS), 0.0, 1.0)
    if not sizes[False] or not sizes[True]:
        return model
    columns = rows.select(*[F.get("x", F.lit(k)).alias(f"x{k}") for k in range(FEATURES)])
    deciles = [(k + 1) / (STEPS + 1) for k in range(STEPS)]
    found = exact_quantiles(columns, {c: deciles for c in columns.columns}, held=HELD)
    model.steps = np.array([found[c] for c in columns.columns])
    for _ in range(PASSES):
        step = _newton(rows, model, sizes)
        # multiples of a power of two, so that scores do not depend on the order of their sum
        model.weights = np.rint((model.weights - step) * EXACT) / EXACT
        if np.abs(step).max() < TOL:
            break
    # the score quantile at the share of bad labels
    n = sizes[False] + sizes[True]
    at = min(sizes[False] - 1, n - 2)

    def raw(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.design(_batch(b)[0]) @ model.weights)], ["z"])

    scores = rows.mapInArrow(raw, "z double")
    threshold = exact_quantiles(scores, {"z": [(at + 0.5) / (n - 1)]}, held=HELD)["z"][0]
    off = exact_quantiles(scores.select(F.abs(F.col("z") - threshold).alias("z")), {"z": [0.5]}, held=HELD)["z"][0]
    model.threshold, model.scale = threshold, 2 / max(1e-6, off)
    return model


def scored(docs: DataFrame, model: Ranking, text_col: str = "text", score: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1 for each whole text.

    Null and empty texts are scored alike, as are rows that repeat. Other columns
    pass through, but one named `score` is replaced.
    """
    docs = docs.drop(score)
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.score(features(piece.column(text_col)))
        return pa.RecordBatch.from_arrays([*piece.columns, pa.array(scores)], [*piece.schema.names, score])

    return docs.mapInArrow(over_slices(text_col, step), extended(docs, (score, "double")))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents."""
    out = scored(docs.select("doc_id", "text"), learn(docs, labels))
    return out.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
