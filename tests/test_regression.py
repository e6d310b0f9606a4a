"""Distributed regressions against dense numpy on the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lendlens.operators.regression import Design, design_of, logit_by_stratum, ols_hc1


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 2000
    df = pd.DataFrame({
        "arm": rng.choice(["control", "x", "y"], n),
        "place": rng.choice(["p", "q"], n),
        "g": rng.integers(0, 3, n),
        "amount": np.round(rng.uniform(40, 300, n), 2),
    })
    lin = -0.5 + 0.4 * (df.arm == "x") - 0.3 * (df.place == "q") + 0.004 * df.amount
    df["hit"] = (rng.uniform(size=n) < 1 / (1 + np.exp(-lin))).astype(int)
    df["money"] = 2 + 0.7 * (df.arm == "y") + 0.01 * df.amount + rng.normal(0, df.amount / 100)
    return df


DESIGN = Design({"arm": ["control", "x", "y"], "place": ["p", "q"]}, "amount")


def coded(frame):
    return frame.assign(**{c: frame[c].map(vs.index) for c, vs in DESIGN.levels.items()})


def test_levels_come_from_the_data(spark, frame):
    df = spark.createDataFrame(frame)
    assert design_of(df, {"arm": "control", "place": None}, "amount") == DESIGN
    with pytest.raises(ValueError):
        design_of(df, {"arm": "absent"}, "amount")


def test_ols_hc1(spark, frame):
    got = ols_hc1(spark.createDataFrame(frame), "money", DESIGN)
    x, y = DESIGN.matrix(coded(frame)), frame.money.to_numpy()
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    cov = inv @ (x.T @ (x * (e ** 2)[:, None])) @ inv * len(y) / (len(y) - x.shape[1])
    assert np.allclose([g["effect"] for g in got], beta, rtol=1e-8)
    assert np.allclose([g["std_err"] for g in got], np.sqrt(np.diag(cov)), rtol=1e-8)


def _dense_logit(x, y):
    b = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ b))
        info = x.T @ (x * (mu * (1 - mu))[:, None])
        b = b + np.linalg.solve(info, x.T @ (y - mu))
    mu = 1 / (1 + np.exp(-x @ b))
    return b, np.linalg.inv(x.T @ (x * (mu * (1 - mu))[:, None])), mu


def test_logit_per_stratum_matches_dense_fits(spark, frame):
    fits = logit_by_stratum(spark.createDataFrame(frame), "hit", DESIGN, "g")
    assert sorted(fits) == [0, 1, 2]
    for g, fit in fits.items():
        sub = frame[frame.g == g]
        x = DESIGN.matrix(coded(sub))
        b, cov, mu = _dense_logit(x, sub.hit.to_numpy(float))
        assert fit.converged and fit.n == len(sub)
        assert np.allclose(fit.beta, b, atol=1e-7)
        assert np.allclose(fit.covariance, cov, rtol=1e-5)
        # the error of the average effect, by moving every coefficient a little
        effect = lambda c: c * np.mean((m := 1 / (1 + np.exp(-x @ c))) * (1 - m))
        step, k = 1e-6, len(b)
        jac = np.column_stack([
            (effect(b + step * np.eye(k)[j]) - effect(b - step * np.eye(k)[j])) / (2 * step)
            for j in range(k)
        ])
        want = np.sqrt(np.diag(jac @ cov @ jac.T))
        got = fit.marginal_effects(DESIGN)
        assert np.allclose([e["effect"] for e in got], effect(b)[1:], atol=1e-8)
        assert np.allclose([e["std_err"] for e in got], want[1:], rtol=1e-4)


def test_term_missing_in_a_stratum_gets_zero(spark, frame):
    df = spark.createDataFrame(frame).where((F.col("g") != 1) | (F.col("arm") != "y"))
    fits = logit_by_stratum(df, "hit", DESIGN, "g")
    position = DESIGN.terms.index(("arm", "y"))
    assert abs(fits[1].beta[position]) < 1e-12
    assert abs(fits[0].beta[position]) > 1e-3


def test_strata_without_a_finite_optimum(spark):
    """Separated and dependent strata are told from a sound one; a term that is absent does no harm."""
    rng = np.random.default_rng(2)
    rows = []
    for g in range(4):
        for k in range(120):
            arm, hit = "xy"[k % 2], int(rng.random() < 0.4)
            cat = "pq"[k % 3 == 0]
            if g == 1:
                hit = int(arm == "y")  # told apart altogether
            if g == 2 and arm == "y":
                hit = 1  # in one arm only
            if g == 3:
                cat = "pq"["xy".index(arm)]  # the same as the arm
            rows.append((g, arm, cat, float(rng.normal()), hit))
    df = spark.createDataFrame(rows, "g int, arm string, cat string, v double, hit int")
    design = design_of(df, {"arm": "x", "cat": "p"}, "v")
    fits = logit_by_stratum(df, "hit", design, "g", max_iter=12)
    assert {g: f.converged and f.determined for g, f in fits.items()} == {0: True, 1: False, 2: False, 3: False}
    without = logit_by_stratum(df.where("g <> 0 or cat = 'p'"), "hit", design, "g", max_iter=12)
    assert without[0].converged and without[0].determined
