"""Linear and logistic regression from distributed sums.

Spark reduces the rows to sums whose size depends on the design only; the driver
solves systems as large as the number of terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.functions.expressions import normal_two_sided_p
from lendlens.operators.cache import column_levels, persisted

CELLS = 1_000_000  # combinations of categories whose moments may reach the driver
Z95 = 1.959963984540054  # 97.5 % point of the normal distribution


@dataclass(frozen=True)
class Design:
    """Dummy-coded categoricals, one numeric covariate, an intercept.

    ``levels`` maps a column to its levels, the baseline first.
    """

    levels: dict[str, list]
    numeric: str

    @property
    def terms(self) -> list[tuple[str, object]]:
        out: list[tuple[str, object]] = [("intercept", None)]
        out += [(c, v) for c, vs in self.levels.items() for v in vs[1:]]
        return [*out, (self.numeric, None)]

    def coded(self, df: DataFrame) -> DataFrame:
        """Every categorical column as the position of its level, 0 for the baseline."""
        return df.withColumns({
            c: F.array_position(F.array(*[F.lit(v) for v in vs]), F.col(c)).cast("int") - 1
            for c, vs in self.levels.items()
        })

    def matrix(self, frame: pd.DataFrame) -> np.ndarray:
        """Model matrix of coded rows."""
        out = np.ones((len(frame), len(self.terms)))
        j = 1
        for c, vs in self.levels.items():
            codes = frame[c].to_numpy()
            for position in range(1, len(vs)):
                out[:, j] = codes == position
                j += 1
        out[:, j] = frame[self.numeric].to_numpy(float)
        return out


def design_of(df: DataFrame, baselines: dict[str, object], numeric: str) -> Design:
    """Levels of the categorical columns; a None baseline means the first level."""
    levels = {}
    for column, values in column_levels(df, list(baselines)).items():
        first = values[0] if baselines[column] is None else baselines[column]
        if first not in values:
            raise ValueError(f"{column}: baseline {first!r} does not occur")
        levels[column] = [first, *[v for v in values if v != first]]
    return Design(levels, numeric)


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def ols_hc1(df: DataFrame, outcome: str, design: Design) -> list[dict]:
    """Least squares with HC1 standard errors, from one grouped aggregation.

    Every regressor but the numeric one is constant within a cell of categories,
    so the moments of outcome and covariate per cell determine the coefficients
    and the robust covariance. One row per occurring cell reaches the driver.
    """
    cats = list(design.levels)
    cells = math.prod(len(v) for v in design.levels.values())
    if cells > CELLS:
        raise ValueError(f"{cells} cells of categories; at most {CELLS} are brought together")
    rows = design.coded(_complete(df, [*cats, design.numeric, outcome]))
    # centring keeps the fourth-order moments well scaled
    mid, spread = rows.agg(
        F.avg(design.numeric), F.coalesce(F.nullif(F.stddev_pop(design.numeric), F.lit(0.0)),
                                          F.lit(1.0))
    ).first()
    if mid is None:
        return []
    a = (F.col(design.numeric) - F.lit(mid)) / F.lit(spread)
    y = F.col(outcome).cast("double")

    def power(k: int):
        out = F.lit(1.0)
        for _ in range(k):
            out = out * a
        return out

    moments = {f"a{k}": power(k) for k in range(5)}
    moments |= {f"y{k}": y * power(k) for k in range(4)}
    moments |= {f"q{k}": y * y * power(k) for k in range(3)}
    cells = rows.groupBy(*cats).agg(*[F.sum(v).alias(n) for n, v in moments.items()]).toPandas()
    m = {n: cells[n].to_numpy(float) for n in moments}
    cells[design.numeric] = 0.0
    c = design.matrix(cells)[:, :-1]
    p = c.shape[1] + 1
    gram, xy = np.zeros((p, p)), np.zeros(p)
    gram[:-1, :-1] = c.T @ (c * m["a0"][:, None])
    gram[:-1, -1] = gram[-1, :-1] = c.T @ m["a1"]
    gram[-1, -1] = m["a2"].sum()
    xy[:-1], xy[-1] = c.T @ m["y0"], m["y1"].sum()
    inverse = np.linalg.pinv(gram, hermitian=True)
    beta = inverse @ xy
    g, k = beta[-1], c @ beta[:-1]

    def squared_error(i: int) -> np.ndarray:
        """Sum of e^2 * a^i per cell, with e = y - k - g * a."""
        return (m[f"q{i}"] - 2 * (k * m[f"y{i}"] + g * m[f"y{i + 1}"]) + k * k * m[f"a{i}"]
                + 2 * k * g * m[f"a{i + 1}"] + g * g * m[f"a{i + 2}"])

    meat = np.zeros((p, p))
    meat[:-1, :-1] = c.T @ (c * squared_error(0)[:, None])
    meat[:-1, -1] = meat[-1, :-1] = c.T @ squared_error(1)
    meat[-1, -1] = squared_error(2).sum()
    n = m["a0"].sum()
    freedom = n - np.linalg.matrix_rank(gram, hermitian=True)
    cov = inverse @ meat @ inverse * (n / freedom)
    # back to the covariate's own scale
    scale = np.ones(p)
    scale[-1] = 1.0 / spread
    to_raw = np.diag(scale)
    to_raw[0, -1] = -mid / spread
    beta, cov = to_raw @ beta, to_raw @ cov @ to_raw.T
    return [_effect(t, b, v) for t, b, v in zip(design.terms, beta, np.diag(cov))]


def _effect(term: tuple[str, object], effect: float, variance: float) -> dict:
    se = math.sqrt(max(variance, 0.0))
    return {
        "term": term[0], "level": None if term[1] is None else str(term[1]),
        "effect": float(effect), "std_err": se,
        "ci_low": float(effect - Z95 * se), "ci_high": float(effect + Z95 * se),
        "p_value": normal_two_sided_p(effect / se) if se > 0 else float("nan"),
    }


def _partials(design: Design, stratum: str, betas: dict) -> callable:
    """Per batch and stratum: gradient, information and the sums the effects need."""
    p = len(design.terms)
    upper = np.triu_indices(p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, np.ndarray] = {}
        for frame in batches:
            for s, part in frame.groupby(stratum):
                if s not in betas:
                    continue
                x = design.matrix(part)
                y = part["__y"].to_numpy(float)
                mu = 1.0 / (1.0 + np.exp(-(x @ betas[s])))
                v = mu * (1.0 - mu)
                flat = np.concatenate([
                    x.T @ (y - mu),
                    (x.T @ (x * v[:, None]))[upper],
                    x.T @ (v * (1.0 - 2.0 * mu)),
                    [v.sum(), len(y)],
                ])
                sums[s] = sums[s] + flat if s in sums else flat
        out = [(s, i, float(v)) for s, flat in sums.items() for i, v in enumerate(flat)]
        yield pd.DataFrame(out, columns=["s", "i", "v"])

    return run


@dataclass
class LogitFit:
    beta: np.ndarray
    covariance: np.ndarray
    slope: float          # mean of mu (1 - mu)
    curvature: np.ndarray  # mean of mu (1 - mu) (1 - 2 mu) x
    n: float
    converged: bool
    determined: bool = True  # the terms that occur are independent, and not all rows are told apart

    def marginal_effects(self, design: Design) -> list[dict]:
        """Average marginal effects with delta-method errors, intercept left out.

        Dummies are treated like continuous covariates: the effect of term j is
        beta_j times the mean of mu (1 - mu).
        """
        jacobian = (np.eye(len(self.beta)) * self.slope
                    + np.outer(self.beta, self.curvature))
        cov = jacobian @ self.covariance @ jacobian.T
        return [
            _effect(t, b * self.slope, v)
            for t, b, v in zip(design.terms, self.beta, np.diag(cov))
        ][1:]


def _determined(information: np.ndarray, n: float) -> bool:
    """Whether the coefficients of the terms that occur have one optimum, from the information at the end."""
    diagonal = np.diag(information)
    if diagonal[0] < 1e-6 * n:  # all outcomes are certain
        return False
    used = diagonal > 0
    scale = np.sqrt(diagonal[used])
    return bool(np.linalg.eigvalsh(information[np.ix_(used, used)] / np.outer(scale, scale))[0] > 1e-9)


def logit_by_stratum(
    df: DataFrame, outcome: str, design: Design, stratum: str, max_iter: int = 100,
    tol: float = 1e-9,
) -> dict[object, LogitFit]:
    """One logit per stratum, all strata iterating together (Newton steps).

    A step is one pass over the cached narrow rows, without a shuffle of them; per
    stratum a few hundred sums come back. Terms that do not occur in a stratum
    get coefficient 0 through the pseudo-inverse. A fit that has not settled after
    ``max_iter`` steps says so in ``converged``.
    """
    cats = list(design.levels)
    rows = design.coded(_complete(df, [*cats, design.numeric, outcome, stratum])).select(
        *dict.fromkeys([stratum, *cats, design.numeric]), F.col(outcome).cast("double").alias("__y")
    )
    p = len(design.terms)
    upper = np.triu_indices(p)
    with persisted(rows):
        strata = [r[0] for r in rows.select(stratum).distinct().collect()]
        key_type = rows.schema[stratum].dataType.simpleString()
        open_betas = {s: np.zeros(p) for s in strata}
        done: dict[object, LogitFit] = {}
        for step in range(max_iter):
            sums = rows.mapInPandas(
                _partials(design, stratum, open_betas), f"s {key_type}, i int, v double"
            ).groupBy("s", "i").agg(F.sum("v").alias("v")).collect()
            flat = {s: np.zeros(2 * p + len(upper[0]) + 2) for s in open_betas}
            for row in sums:
                flat[row["s"]][row["i"]] = row["v"]
            for s, f in flat.items():
                information = np.zeros((p, p))
                information[upper] = f[p:p + len(upper[0])]
                information = information + np.triu(information, 1).T
                inverse = np.linalg.pinv(information, rcond=1e-12, hermitian=True)
                move = inverse @ f[:p]
                settled = np.max(np.abs(move)) < tol
                if settled or step == max_iter - 1:
                    n = f[-1]
                    done[s] = LogitFit(open_betas[s], inverse, f[-2] / n,
                                       f[p + len(upper[0]):-2] / n, n, bool(settled),
                                       _determined(information, n))
                else:
                    open_betas[s] = open_betas[s] + move
            for s in done:
                open_betas.pop(s, None)
            if not open_betas:
                break
        return done
