"""Evaluation of a probability score against a 0/1 label."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendlens.operators.cache import persisted
from lendlens.operators.quantile import exact_quantiles
from lendlens.operators.skew import join_back

BUCKETS = 1024  # parts of about equally many scores


def _known(df: DataFrame, score: str, label: str) -> DataFrame:
    """The rows that every measure is about: those with a score and a label."""
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull())


def _bucketed(merged: DataFrame) -> DataFrame:
    """Adds ``__b``, the number of the part of the scores that a score falls into."""
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = merged.agg(F.percentile_approx("score", shares, 10 * BUCKETS)).first()[0] or []
    splits = [-float("inf"), *sorted({float(c) for c in cuts}), float("inf")]
    if len(splits) < 3:
        return merged.withColumn("__b", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol="score", outputCol="__b", handleInvalid="keep").transform(
        merged.withColumn("score", F.col("score").cast("double"))
    )


def _cumulated(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Per segment and distinct score: positives and negatives at or above it.

    Equal scores are merged first. The merged scores are cut at their approximate
    quantiles, so that running totals need one small window over the bucket totals
    and one window per bucket; no task sees all scores, however they crowd.
    """
    known = _known(df, score, label)
    merged = known.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum(F.lit(1) - F.col(label).cast("long")).alias("neg"),
    )
    merged = _bucketed(merged)
    higher = (
        Window.partitionBy(*by).orderBy(F.desc("__b"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*by)
    totals = merged.groupBy(*by, "__b").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    totals = totals.select(
        *by, "__b",
        F.coalesce(F.sum("p").over(higher), F.lit(0)).alias("__tp"),
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("__fp"),
        F.sum("p").over(whole).alias("P"), F.sum("n").over(whole).alias("N"),
    )
    inside = Window.partitionBy(*by, "__b").orderBy(F.desc("score")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = merged.withColumns({
        "tp": F.sum("pos").over(inside), "fp": F.sum("neg").over(inside)
    })
    return join_back(local, totals, [*by, "__b"]).select(
        *by, "score", "pos", "neg",
        (F.col("tp") + F.col("__tp")).alias("tp"), (F.col("fp") + F.col("__fp")).alias("fp"),
        "P", "N",
    )


def _over(n, d):
    return n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0))


def auc_ap(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """ROC area (ties count half) and average precision (step sum), per segment."""
    by = by or []
    curve = _cumulated(df, score, label, by)
    pairs = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    precision = F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))
    return curve.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n_samples"),
        _over(F.sum(pairs), F.max("P") * F.max("N")).alias("auc"),
        _over(F.sum(F.col("pos") * precision), F.max("P")).alias("ap"),
    )


def evaluation(df: DataFrame, score: str, label: str) -> DataFrame:
    """AUC, average precision, Brier score and log-loss, one row."""
    df = _known(df, score, label)
    p = F.greatest(F.least(F.col(score), F.lit(1 - 1e-15)), F.lit(1e-15))
    y = F.col(label)
    direct = df.agg(
        F.avg(F.pow(F.col(score) - y, F.lit(2.0))).alias("brier"),
        F.avg(-F.when(y == 1, F.log(p)).otherwise(F.log(F.lit(1.0) - p))).alias("log_loss"),
    )
    ranked = auc_ap(df, score, label).drop("n_samples")
    # two one-row frames side by side
    both = ranked.unionByName(direct, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("auc", "ap", "brier", "log_loss")])


def _with_point(curve: DataFrame, **values: float) -> DataFrame:
    """Append the one end point of a curve that no threshold reaches."""
    point = curve.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        *[F.lit(v).alias(n) for n, v in values.items()],
    )
    return curve.unionByName(point)


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, and the start at (0, 0)."""
    curve = _cumulated(df, score, label, []).select(
        F.col("score").alias("threshold"),
        _over(F.col("fp"), F.col("N")).alias("fpr"),
        _over(F.col("tp"), F.col("P")).alias("tpr"),
    )
    return _with_point(curve, fpr=0.0, tpr=0.0)


def pr_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, precision, recall) at every distinct score, and the end at (1, 0)."""
    curve = _cumulated(df, score, label, []).select(
        F.col("score").alias("threshold"),
        _over(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _over(F.col("tp"), F.col("P")).alias("recall"),
    )
    return _with_point(curve, precision=1.0, recall=0.0)


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean prediction and observed rate per quantile bin (right-closed bins)."""
    df = _known(df, score, label)
    inner = [i / bins for i in range(1, bins)]
    edges = [e for e in exact_quantiles(df, {score: inner})[score] if e is not None]
    bin_of = F.lit(0)
    for e in edges:
        bin_of = bin_of + F.when(F.col(score) > F.lit(e), 1).otherwise(0)
    return df.groupBy(bin_of.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("prob_pred"),
        F.avg(label).alias("prob_true"),
    )


def threshold_metrics(
    df: DataFrame, score: str, label: str, thresholds: dict[str, float]
) -> DataFrame:
    """Confusion metrics per named threshold; scores below it are approved.

    All thresholds are counted in one pass.
    """
    df = _known(df, score, label)
    p, y = F.col(score), F.col(label)
    counts, names = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("bad")], list(thresholds)
    for i, name in enumerate(names):
        approved = p < F.lit(thresholds[name])
        counts += [F.count_if(approved).alias(f"a{i}"), F.sum(F.when(approved, y)).alias(f"b{i}")]
    facts = df.agg(*counts)

    def row(i: int):
        n, bad = F.col("n"), F.col("bad")
        ok, missed = F.col(f"a{i}"), F.coalesce(F.col(f"b{i}"), F.lit(0))
        declined, caught = n - ok, bad - missed
        return F.struct(
            F.lit(names[i]).alias("name"), F.lit(float(thresholds[names[i]])).alias("threshold"),
            _over(ok, n).alias("approval_rate"),
            _over(missed, ok).alias("def_rate_approved"),
            _over(caught, declined).alias("def_rate_declined"),
            _over(caught, bad).alias("sensitivity"),
            _over(ok - missed, n - bad).alias("specificity"),
            _over(caught, declined).alias("precision"),
        )

    return facts.select(
        F.explode(F.array(*[row(i) for i in range(len(names))])).alias("r")
    ).select("r.*")


def default_target_thresholds(
    df: DataFrame, score: str, label: str, targets: list[float]
) -> dict[float, float]:
    """Per target the threshold approving the most at a default rate within it.

    Candidates are all scores and 1.0; of equal approval the larger one wins. A
    target nothing reaches is absent. One row comes back.
    """
    curve = _cumulated(df, score, label, [])
    at_score = curve.select(
        F.col("score").alias("t"),
        (F.col("P") + F.col("N") - F.col("tp") - F.col("fp")).alias("ok"),
        (F.col("P") - F.col("tp")).alias("bad"),
    )
    below_one = F.col(score) < 1.0
    at_one = df.agg(
        F.lit(1.0).alias("t"), F.count_if(below_one).alias("ok"),
        F.sum(F.when(below_one, F.col(label))).alias("bad"),
    )
    candidates = at_score.unionByName(at_one).where(F.col("ok") > 0)
    rate = F.col("bad") / F.col("ok")
    best = candidates.agg(*[
        F.max(F.when(rate <= F.lit(q), F.struct("ok", "t"))).alias(f"t{i}")
        for i, q in enumerate(targets)
    ]).first()
    return {q: best[f"t{i}"]["t"] for i, q in enumerate(targets) if best[f"t{i}"] is not None}


def operating_points(
    df: DataFrame, score: str, label: str,
    approvals: tuple[float, ...] = (0.30, 0.35, 0.40),
    defaults: tuple[float, ...] = (0.19, 0.25, 0.30),
) -> DataFrame:
    """Metrics at fixed approval rates and at fixed default targets."""
    # the passes read two narrow columns, not the joins behind them
    with persisted(_known(df, score, label).select(score, label)) as narrow:
        cuts = exact_quantiles(narrow, {score: list(approvals)})[score]
        named = {f"Fixed Approval {int(a * 100)}%": t for a, t in zip(approvals, cuts) if t is not None}
        found = default_target_thresholds(narrow, score, label, list(defaults))
        named |= {f"Fixed Default ≤ {int(d * 100)}%": t for d, t in found.items()}
        counted = threshold_metrics(narrow, score, label, named)
        # a handful of rows
        return df.sparkSession.createDataFrame(counted.collect(), counted.schema)


def population_stability(
    before: DataFrame, after: DataFrame, column: str, buckets: int = 10, floor: float = 1e-4
) -> DataFrame:
    """PSI of a column between two populations over the first one's quantile bins."""
    inner = [i / buckets for i in range(1, buckets)]
    edges = [e for e in exact_quantiles(before, {column: inner})[column] if e is not None]
    bin_of = F.lit(0)
    for e in edges:
        bin_of = bin_of + F.when(F.col(column) > F.lit(e), 1).otherwise(0)

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(column).isNotNull()).groupBy(bin_of.alias("bucket")).agg(
            F.count(F.lit(1)).alias(name)
        )

    # one row per bucket from here on
    every = Window.partitionBy()
    both = counts(before, "a").join(counts(after, "b"), "bucket", "full")

    def share(c: str):
        n = F.coalesce(F.col(c), F.lit(0))
        return F.greatest(n / F.sum(n).over(every), F.lit(floor))

    parts = both.select("bucket", share("a").alias("share_before"), share("b").alias("share_after"))
    part = (F.col("share_after") - F.col("share_before")) * F.log(
        F.col("share_after") / F.col("share_before")
    )
    psi = F.sum("psi_part").over(every)
    return parts.withColumn("psi_part", part).withColumn("psi", psi).withColumn(
        "status",
        F.when(F.col("psi") > 0.25, "critical").when(F.col("psi") > 0.1, "warning").otherwise("ok"),
    )
