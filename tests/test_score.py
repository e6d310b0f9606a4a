"""Score evaluation against direct formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlens.operators import score as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.beta(2, 5, 1500), 2)  # many ties
    y = (rng.uniform(size=1500) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b), "ab"[i % 2]) for i, (a, b) in
                                enumerate(zip(p, y))], "p double, y int, g string").cache()
    return df, p, y


def _auc(p, y):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > neg).mean() + 0.5 * (a == neg).mean() for a in pos])


def _ap(p, y):
    total, before = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = (p >= t)
        recall = y[hit].sum() / y.sum()
        total += (recall - before) * y[hit].mean()
        before = recall
    return total


def test_evaluation(data):
    df, p, y = data
    row = S.evaluation(df, "p", "y").first()
    assert row["auc"] == pytest.approx(_auc(p, y))
    assert row["ap"] == pytest.approx(_ap(p, y))
    assert row["brier"] == pytest.approx(np.mean((p - y) ** 2))
    q = np.clip(p, 1e-15, 1 - 1e-15)
    assert row["log_loss"] == pytest.approx(-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)))


def test_segments(data):
    df, p, y = data
    index = np.arange(len(p)) % 2
    got = {r["g"]: r for r in S.auc_ap(df, "p", "y", ["g"]).collect()}
    for k, g in enumerate("ab"):
        assert got[g]["auc"] == pytest.approx(_auc(p[index == k], y[index == k]))
        assert got[g]["ap"] == pytest.approx(_ap(p[index == k], y[index == k]))


def test_curves_are_whole(data):
    df, p, y = data
    roc = S.roc_points(df, "p", "y").orderBy(F.asc_nulls_last("threshold")).collect()
    assert len(roc) == len(set(p)) + 1
    assert (roc[0]["fpr"], roc[0]["tpr"]) == (1.0, 1.0)
    assert (roc[-1]["fpr"], roc[-1]["tpr"]) == (0.0, 0.0)
    pr = S.pr_points(df, "p", "y").orderBy(F.asc_nulls_last("threshold")).collect()
    assert pr[0]["recall"] == 1.0 and pr[0]["precision"] == pytest.approx(y.mean())
    assert (pr[-1]["precision"], pr[-1]["recall"]) == (1.0, 0.0)


def test_calibration_bins(data):
    df, p, y = data
    edges = np.quantile(p, np.linspace(0, 1, 11))[1:-1]
    bins = np.searchsorted(edges, p)
    got = {r["bin"]: r for r in S.calibration(df, "p", "y").collect()}
    assert sorted(got) == sorted(set(bins))
    for b, r in got.items():
        assert r["prob_pred"] == pytest.approx(p[bins == b].mean())
        assert r["prob_true"] == pytest.approx(y[bins == b].mean())


def test_operating_points(data):
    df, p, y = data
    rows = {r["name"]: r for r in S.operating_points(df, "p", "y").collect()}
    t = np.quantile(p, 0.35)
    row = rows["Fixed Approval 35%"]
    assert row["threshold"] == pytest.approx(t)
    assert row["approval_rate"] == pytest.approx((p < t).mean())
    assert row["sensitivity"] == pytest.approx(((p >= t) & (y == 1)).sum() / y.sum())
    assert row["specificity"] == pytest.approx(((p < t) & (y == 0)).sum() / (1 - y).sum())
    for target in (0.19, 0.25, 0.30):
        best = max(
            ((p < c).mean(), c) for c in [*sorted(set(p)), 1.0]
            if (p < c).any() and y[p < c].mean() <= target
        )
        got = rows[f"Fixed Default ≤ {int(target * 100)}%"]
        assert (got["approval_rate"], got["threshold"]) == pytest.approx(best)


def test_unreachable_target_is_left_out(data):
    df, _, _ = data
    always = df.withColumn("y", F.lit(1))
    assert S.default_target_thresholds(always, "p", "y", [0.19]) == {}


def test_no_drift_between_equal_halves(data):
    df, _, _ = data
    row = S.population_stability(df, df, "p").first()
    assert row["psi"] == pytest.approx(0.0) and row["status"] == "ok"
    moved = df.withColumn("p", F.least(F.col("p") + 0.3, F.lit(1.0)))
    assert S.population_stability(df, moved, "p").first()["status"] == "critical"
