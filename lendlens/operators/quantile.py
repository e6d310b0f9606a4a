"""Exact interpolated quantiles of many columns without sorting the table."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD = 20_000  # values between two ends that are brought together
K = 4096  # size of a sketch
ERROR = 0.001  # of a rank in a sketch of this size, as a share of all
MARGIN = 2 * ERROR


@dataclass
class _Search:
    """The one or two neighbouring ranks of a quantile, and the open interval they are known to lie in."""

    column: int
    ranks: list[int]  # still unknown, 0-based among the column's values
    margin: float
    count: int  # values inside the interval
    below: int = 0  # values before it
    low: float = -math.inf
    high: float = math.inf
    ends: tuple[float, float] = (-math.inf, math.inf)  # proposed around the ranks
    found: dict[int, float] = field(default_factory=dict)

    @property
    def positions(self) -> list[float]:
        last = max(self.count - 1, 1)
        at = [(self.ranks[0] - self.below) / last - self.margin, (self.ranks[-1] - self.below) / last + self.margin]
        return [min(max(p, 0.0), 1.0) for p in at]

    @property
    def few(self) -> float:
        """About how many values can lie between the ends."""
        return self.count * min(1.0, 2 * (self.margin + ERROR))

    def learn(self, below: int, at_low: int, inside: int, at_high: int, values: list[float] | None) -> None:
        """Take the counts around the ends: settle ranks, or narrow the interval, or widen the proposal."""
        low, high = self.ends
        first, last = below + at_low, below + at_low + inside
        if self.ranks[0] < below or self.ranks[-1] >= last + at_high:
            self.margin = min(1.0, 4 * self.margin)  # with 1 the ends are the least and the greatest value
            return
        for r in list(self.ranks):
            if r < first:
                self.found[r] = low
            elif r >= last:
                self.found[r] = high
            elif values is not None:
                self.found[r] = values[r - first]
            else:
                continue
            self.ranks.remove(r)
        self.below, self.count, self.low, self.high = first, inside, low, high
        self.margin = MARGIN


def exact_quantiles(
    df: DataFrame, wanted: dict[str, list[float]], held: int = HELD, margin: float = MARGIN
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, NULL and NaN left out.

    One pass sketches all columns. The sketches propose two ends around each
    quantile, and a second pass counts the values before, at and between them and
    brings those between together. Where more than about ``held`` would be
    brought, it only counts, and the values between are sketched in turn: they
    are a few hundredths of the ones before, so the number of passes grows with
    the logarithm of the table and not with the number of columns. A proposal
    that misses is made again with a wider margin.
    """
    names = list(wanted)
    if not names:
        return {}
    values = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"v{i}")
                         for i, c in enumerate(names)])
    spots = [(i, j, q) for i, c in enumerate(names) for j, q in enumerate(wanted[c])]
    shares = {q: [max(q - margin, 0.0), min(q + margin, 1.0)] for _, _, q in spots}
    first = values.agg(
        *[F.count(f"v{i}") for i in range(len(names))],
        *[F.when(F.count(f"v{i}") > 0, _at(F.col(f"v{i}"), shares[q])) for i, _, q in spots],
    ).first()
    sizes = first[: len(names)]
    searches: dict[tuple[int, int], _Search] = {}
    for (i, j, q), ends in zip(spots, first[len(names) :]):
        if sizes[i]:
            rank = q * (sizes[i] - 1)
            ranks = sorted({math.floor(rank), math.ceil(rank)})
            searches[i, j] = _Search(i, ranks, margin, sizes[i], ends=tuple(ends))
    current = list(searches.values())
    while current:
        _inspect(values, current, held)
        current = [s for s in current if s.ranks]
        if current:
            _propose(values, current)

    def answer(i: int, j: int, q: float) -> float | None:
        if (i, j) not in searches:
            return None
        rank, found = q * (sizes[i] - 1), searches[i, j].found
        low, high = found[math.floor(rank)], found[math.ceil(rank)]
        return low + (rank - math.floor(rank)) * (high - low)

    return {c: [answer(i, j, q) for j, q in enumerate(wanted[c])] for i, c in enumerate(names)}


def _at(values: Column, shares: list[float]) -> Column:
    """The values at shares of their order, from a sketch."""
    return F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(values, K), F.array(*map(F.lit, shares)))


def _propose(values: DataFrame, searches: list[_Search]) -> None:
    """Ends around the ranks of each search, from a sketch of its interval."""

    def inside(s: _Search) -> Column:
        v = F.col(f"v{s.column}")
        return F.when((v > s.low) & (v < s.high), v)

    row = values.agg(*[_at(inside(s), s.positions) for s in searches]).first()
    for s, ends in zip(searches, row):
        s.ends = ends[0], ends[1]


def _inspect(values: DataFrame, searches: list[_Search], held: int) -> None:
    """One pass: counts around the ends of all searches, and the few values between them."""
    brought = [s.few <= held for s in searches]
    places = [(s.column, *s.ends) for s in searches]
    columns = sorted({c for c, _, _ in places})
    schema = "n int, below bigint, at_low bigint, inside bigint, at_high bigint, found array<double>"
    parts = values.select(*[f"v{c}" for c in columns]).mapInArrow(_around(places, brought), schema)
    rows = parts.groupBy("n").agg(
        *[F.sum(c).alias(c) for c in ("below", "at_low", "inside", "at_high")],
        F.array_sort(F.flatten(F.collect_list("found"))).alias("found"),
    ).collect()
    for r in rows:
        s = searches[r["n"]]
        s.learn(r["below"], r["at_low"], r["inside"], r["at_high"], r["found"] if brought[r["n"]] else None)


def _around(places: list[tuple[int, float, float]], brought: list[bool]):
    def run(batches: Iterable[pa.RecordBatch]):
        counts = np.zeros((len(places), 4), dtype=np.int64)
        found: list[list[np.ndarray]] = [[] for _ in places]
        for batch in batches:
            columns: dict[int, np.ndarray] = {}
            for n, (c, low, high) in enumerate(places):
                if c not in columns:
                    columns[c] = batch.column(f"v{c}").to_numpy(zero_copy_only=False)
                v = columns[c]  # a null is NaN, which compares with nothing
                inside = (v > low) & (v < high)
                at_high = np.count_nonzero(v == high) if high != low else 0
                counts[n] += np.count_nonzero(v < low), np.count_nonzero(v == low), np.count_nonzero(inside), at_high
                if brought[n]:
                    found[n].append(v[inside])
        held = [np.concatenate(f) if f else np.zeros(0) for f in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(places), dtype=np.int32)), *map(pa.array, counts.T.copy()),
             pa.array(held, pa.list_(pa.float64()))],
            ["n", "below", "at_low", "inside", "at_high", "found"],
        )

    return run
