"""The risk model end to end on made features with a known signal."""

import numpy as np
import pytest

from lendlens.operators import lasso, score
from lendlens.plans import risk_model


@pytest.fixture(scope="module")
def base(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(3000):
        x, z, place = rng.normal(), rng.normal(), "abc"[rng.integers(0, 3)]
        p = 1 / (1 + np.exp(-(1.5 * x - 0.5 + (place == "c"))))
        rows.append((f"L{i}", i, 100.0, int(rng.uniform() < p), float(x),
                     None if i % 7 == 0 else float(z), place, float("inf") if i % 50 == 0 else 1.0,
                     None))
    return spark.createDataFrame(
        rows, "loan_id string, user_id bigint, amount double, is_default int, x double, z double,"
              " place string, w double, never double").cache()


def test_matrix(base):
    frame = risk_model.imputed_features(base).toPandas().set_index("loan_id")
    assert sorted(frame.columns) == sorted(["is_default", "x", "z", "w", "place_b", "place_c"])
    assert not frame.isna().any().any() and np.isfinite(frame.to_numpy(float)).all()
    z = base.toPandas().set_index("loan_id")["z"]
    assert frame.loc["L0", "z"] == pytest.approx(z.median())
    assert frame.loc["L50", "w"] == 1.0


def test_split_is_stratified_and_repeats(base):
    once = {(r["is_test"], r["is_default"]): r["loans"]
            for r in risk_model.split_summary(base).collect()}
    again = {(r["is_test"], r["is_default"]): r["loans"]
             for r in risk_model.split_summary(base.repartition(5)).collect()}
    assert once == again
    for y in (0, 1):
        share = once[1, y] / (once[0, y] + once[1, y])
        assert share == pytest.approx(0.3, abs=0.04)


def _dense(base, model):
    """Features of the training rows as the model scales them, labels and folds, from a plain frame."""
    frame = risk_model.split(risk_model.imputed_features(base)).withColumn(
        "fold", risk_model._draw("fold", 3).cast("int")
    ).where("is_test = 0").toPandas()
    x = frame[model.features].to_numpy(float)
    x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    return np.column_stack([np.ones(len(x)), x]), frame["is_default"].to_numpy(float), frame["fold"].to_numpy()


def _proximal(x, y, penalty, steps=20_000):
    """The penalised optimum by accelerated proximal gradient steps."""
    n = len(y)
    rate = 4 * n / np.linalg.norm(x, 2) ** 2
    b = z = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(steps):
        g = x.T @ (1 / (1 + np.exp(-x @ z)) - y) / n
        new = z - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / after * (new - b)
        b, t = new, after
    return b


def test_search_and_fit(base):
    values = [0.0001, 0.003, 0.1]
    model = risk_model.fit(base, c_values=values, folds=3)
    assert model.best_c == 0.1 and model.cv_auc[0.1] > 0.75
    weights = dict(model.coefficients())
    assert weights["x"] == max(weights.values()) and weights["place_c"] > 0
    assert risk_model.cv_table(model).where("is_best").count() == 1
    row = score.evaluation(model.test, "pd", "is_default").first()
    assert row["auc"] > 0.75
    top = risk_model.coefficient_table(model, 1).first()
    assert top["feature"] == "x"

    # every fit against its optimality conditions and a plain solver, and every area against its definition
    assert model.passes <= 20
    x, y, fold = _dense(base, model)
    table = {(r["fold"], r["c"]): r for r in risk_model.optimality_table(model).collect()}
    assert len(table) == 3 * len(values) + 1
    for (k, c), fitted in [*model.fold_fits.items(), ((None, model.best_c), model.final)]:
        own = np.ones(len(y), bool) if k is None else fold != k
        penalty = 1 / (c * own.sum())
        g = x[own].T @ (1 / (1 + np.exp(-x[own] @ fitted.beta)) - y[own]) / own.sum()
        assert lasso.residual(fitted.beta, g, penalty) < 1e-7
        assert table[k, c]["residual"] <= lasso.TOL and table[k, c]["loans"] == own.sum()
        assert np.allclose(fitted.beta, _proximal(x[own], y[own], penalty), atol=1e-6)
        if k is not None:
            s, label = x[~own] @ fitted.beta, y[~own]
            pairs = s[label == 1][:, None] - s[label == 0][None, :]
            area = ((pairs > 0) + 0.5 * (pairs == 0)).mean()
            assert model.fold_auc[k, c] == pytest.approx(area, abs=1e-9)
    assert model.cv_auc[0.003] == pytest.approx(np.mean([model.fold_auc[k, 0.003] for k in range(3)]))
    held = model.test.toPandas().set_index("loan_id")["pd"]
    assert held.between(0, 1).all() and held.nunique() > 100


def test_strong_penalty_keeps_nothing(base):
    model = risk_model.fit(base, c_values=[1e-6])
    assert model.coefficients() == [] and model.fold_fits == {}
    share = model.final.rows and 1 / (1 + np.exp(-model.final.intercept))
    assert model.test.where(f"abs(pd - {share}) > 1e-9").count() == 0


def test_quadratic_with_dependent_columns():
    """Sums and copies among the columns, from any start."""
    rng = np.random.default_rng(0)
    for _ in range(60):
        p, n = int(rng.integers(7, 40)), int(rng.integers(5, 100))
        x = rng.normal(size=(n, p))
        x[:, 0], x[:, 3], x[:, 2] = 1.0, x[:, 4] + x[:, 5], x[:, 1]
        y = rng.normal(size=n) + x @ rng.normal(size=p)
        gram, target, penalty = x.T @ x / n, x.T @ y / n, 10 ** rng.uniform(-4, 0.5)
        b = lasso._quadratic(gram, target, penalty, rng.normal(size=p) * (rng.random(p) < 0.3))
        assert lasso.residual(b, gram @ b - target, penalty) < 1e-8


def test_a_step_that_overshoots_is_halved(spark):
    """A start far off makes the first step useless; the fit still settles."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    rows = spark.createDataFrame(
        [([float(a), float(b)], float(c), k % 4) for k, ((a, b), c) in enumerate(zip(x, y))],
        "x array<double>, y double, fold int",
    )
    tasks = {"a": lasso.Task(None, 0.01), "b": lasso.Task(2, 0.01)}
    far = {"a": np.array([3.0, -6.0, 5.0])}
    fits, passes = lasso.fit_all(rows, tasks, 2, start=far)
    full = np.column_stack([np.ones(400), x])
    assert np.allclose(fits["a"].beta, _proximal(full, y, 0.01), atol=1e-6)
    own = np.arange(400) % 4 != 2
    assert np.allclose(fits["b"].beta, _proximal(full[own], y[own], 0.01), atol=1e-6)
    with pytest.raises(ArithmeticError):
        lasso.fit_all(rows, tasks, 2, start=far, passes=1)
    with pytest.raises(ValueError):
        lasso.fit_all(rows.where("fold = 2"), tasks, 2)
    with pytest.raises(ValueError):
        lasso.fit_all(rows, tasks, lasso.FEATURES + 1)
