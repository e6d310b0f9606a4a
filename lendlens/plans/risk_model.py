"""Default-risk model: features, imputation, split, L1 logistic regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.functions import round_half_away
from lendlens.operators import score as scoring
from lendlens.operators.cache import column_levels, persisted, written
from lendlens.operators.lasso import Fit, Task, fit_all
from lendlens.operators.quantile import exact_quantiles

LABEL = "is_default"
# identifiers, timestamps, label and the amount take no part in the model
NOT_FEATURES = [LABEL, "loan_id", "user_id", "approved_at_utc", "disbursed_at_utc",
                "due_date_clean", "amount"]
C_VALUES = [10.0 ** (-3 + 0.5 * i) for i in range(9)]
TEST_SHARE = 30  # percent
FOLDS = 5


def feature_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns: everything not excluded."""
    kept = [f for f in df.schema.fields if f.name not in NOT_FEATURES]
    text = [f.name for f in kept if f.dataType.typeName() == "string"]
    return [f.name for f in kept if f.name not in text], text


def feature_summary(df: DataFrame) -> DataFrame:
    """Features with their kind and the number of filled rows."""
    numeric, text = feature_columns(df)
    names = [*numeric, *text]
    facts = df.agg(*[F.count(c).alias(c) for c in names])
    return facts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 F.lit("numeric" if c in numeric else "categorical").alias("kind"),
                 F.col(c).alias("filled_rows"))
        for c in names
    ])).alias("r")).select("r.*")


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def one_hot(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Numeric matrix columns: finite numerics, and a dummy per level but the first."""
    numeric, text = feature_columns(df)
    columns = {c: _finite(c) for c in numeric}
    for c, levels in column_levels(df, text).items():
        for v in levels[1:]:
            columns[f"{c}_{v}"] = F.when(F.col(c) == v, 1.0).otherwise(0.0)
    return df.select("loan_id", LABEL, *[e.alias(n) for n, e in columns.items()]), list(columns)


def impute(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """NULL becomes the column median, taken over all rows unless ``fit_on`` says otherwise.

    A column without any value is left out, as there is no median.
    """
    nullable = [c for c in columns if df.schema[c].nullable]
    medians = exact_quantiles(fit_on or df, {c: [0.5] for c in nullable})
    keep = {c: m[0] for c, m in medians.items() if m[0] is not None}
    return df.select("loan_id", LABEL, *[
        F.coalesce(F.col(f"`{c}`"), F.lit(keep[c])).alias(c) if c in keep else F.col(f"`{c}`")
        for c in columns if c in keep or c not in nullable
    ])


def imputed_features(base: DataFrame) -> DataFrame:
    """The model matrix; levels and medians are fitted here, the rest stays lazy.

    The base table takes several joins and is read by every step, so it is written once.
    """
    matrix, columns = one_hot(written(base))
    return impute(matrix, columns)


def _draw(salt: str, modulus: int) -> Column:
    """A repeatable number in [0, modulus) from the loan id."""
    digest = F.md5(F.concat_ws(":", F.lit(salt), F.col("loan_id")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % modulus


def split(df: DataFrame) -> DataFrame:
    """Adds ``is_test``: about 30 % of either label class, by a hash of label and loan id.

    The draw is a function of the row, so it needs no shuffle and repeats.
    """
    digest = F.md5(F.concat_ws(":", F.col(LABEL).cast("string"), F.col("loan_id")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("is_test", F.when(draw < TEST_SHARE, 1).otherwise(0))


def split_summary(df: DataFrame) -> DataFrame:
    return split(df).groupBy("is_test", LABEL).agg(F.count(F.lit(1)).alias("loans"))


@dataclass
class RiskModel:
    features: list[str]
    deviation: np.ndarray  # population deviation of each feature over the training rows
    final: Fit  # of the centred and scaled features, at best_c
    best_c: float
    cv_auc: dict[float, float]
    fold_auc: dict[tuple[int, float], float]
    fold_fits: dict[tuple[int, float], Fit]
    passes: int  # over the training rows, for all fits
    test: DataFrame  # loan_id, label, pd of the held-out loans

    def coefficients(self) -> list[tuple[str, float]]:
        """Non-zero coefficients of the scaled features."""
        return [(n, float(w)) for n, w in zip(self.features, self.final.weights) if w != 0.0]


def _scale(train: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each feature, in one pass; a constant feature keeps its scale."""
    row = train.agg(*[f(F.col(f"`{c}`")) for f in (F.avg, F.stddev_pop) for c in features]).first()
    mean, deviation = np.array(row, dtype=float).reshape(2, -1)
    return mean, np.where(deviation > 0, deviation, 1.0)


def _held_out_scores(fits: dict[tuple[int, float], Fit], values: list[float]):
    """Each row's scores by the fits that leave out its fold, one row a penalty."""
    folds = sorted({k for k, _ in fits})
    betas = {k: np.stack([fits[k, c].beta for c in values], axis=1) for k in folds}

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            scores = np.zeros((n, len(values)))
            for k in folds:
                own = fold == k
                scores[own] = x[own] @ betas[k][1:] + betas[k][0]
            row = np.repeat(np.arange(n), len(values))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(fold[row]), pa.array(np.tile(np.arange(len(values), dtype=np.int32), n)),
                    batch.column("y").take(pa.array(row)), pa.array(scores.reshape(-1)),
                ],
                ["fold", "c", "y", "score"],
            )

    return run


def _searched(rows: DataFrame, sizes: dict[int, int], values: list[float], p: int):
    """(AUC by fold and C, fits by fold and C, passes): every fit leaves one fold out."""
    n = sum(sizes.values())
    tasks = {(k, c): Task(k, 1.0 / (c * (n - size))) for k, size in sizes.items() for c in values}
    fits, passes = fit_all(rows, tasks, p)
    scored = rows.mapInArrow(_held_out_scores(fits, values), "fold int, c int, y double, score double")
    areas = scoring.auc_ap(scored, "score", "y", ["fold", "c"]).select("fold", "c", "auc").collect()
    # one row a fold and penalty; a fold with one class has no area
    return {(r["fold"], values[r["c"]]): r["auc"] for r in areas if r["auc"] is not None}, fits, passes


def fit(base: DataFrame, c_values: list[float] | None = None, folds: int = FOLDS) -> RiskModel:
    """Scaled L1 logistic regression, penalty chosen by the mean AUC of the folds left out.

    Features are divided by their population deviation; centring them changes the
    intercept only, which bears no penalty. A penalty C on the summed loss is
    1 / (C n) on the mean loss. Of equal areas the smaller C is taken; a single
    C needs no search. All fits of the search take their steps together, and the
    last one starts from the mean of the folds' coefficients.
    """
    values = c_values or C_VALUES
    prepared = split(imputed_features(base))
    features = [c for c in prepared.columns if c not in ("loan_id", LABEL, "is_test")]
    train = prepared.where("is_test = 0").withColumn("fold", _draw("fold", folds).cast("int"))
    mean, deviation = _scale(train, features)
    x = F.array(*[(F.col(f"`{c}`") - float(m)) / float(d) for c, m, d in zip(features, mean, deviation)])
    with persisted(train.select(x.alias("x"), F.col(LABEL).cast("double").alias("y"), "fold")) as rows:
        sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
        fold_auc, fits, passes, best_c, start = {}, {}, 0, values[0], None
        cv_auc: dict[float, float] = {}
        if len(values) > 1:
            fold_auc, fits, passes = _searched(rows, sizes, values, len(features))
            for c in values:
                found = [a for (_, at), a in fold_auc.items() if at == c]
                cv_auc[c] = float(np.mean(found)) if found else float("nan")
            best_c = max(values, key=lambda c: (np.nan_to_num(cv_auc[c], nan=-1.0), -c))
            start = {"final": np.mean([fits[k, best_c].beta for k in sizes], axis=0)}
        n = sum(sizes.values())
        final, more = fit_all(rows, {"final": Task(None, 1.0 / (best_c * n))}, len(features), start=start)
    last = final["final"]
    eta = F.lit(float(last.intercept - np.sum(last.weights * mean / deviation)))
    for c, w, d in zip(features, last.weights, deviation):
        if w != 0.0:
            eta = eta + F.col(f"`{c}`") * float(w / d)
    held_out = prepared.where("is_test = 1").select(
        "loan_id", LABEL, (F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))).alias("pd")
    )
    return RiskModel(features, deviation, last, best_c, cv_auc, fold_auc, fits, passes + more, held_out)


def cv_table(model: RiskModel) -> DataFrame:
    rows = [(c, a, c == model.best_c) for c, a in model.cv_auc.items()]
    return model.test.sparkSession.createDataFrame(
        rows, "c double, cv_auc double, is_best boolean"
    )


def optimality_table(model: RiskModel) -> DataFrame:
    """Each fit's fold left out (null for the last), C, rows, penalised features kept, loss and residual."""
    fits = [(k, c, f) for (k, c), f in model.fold_fits.items()] + [(None, model.best_c, model.final)]
    rows = [(k, c, int(f.rows), int((f.weights != 0).sum()), f.loss, f.residual) for k, c, f in fits]
    return model.test.sparkSession.createDataFrame(
        rows, "fold int, c double, loans bigint, kept int, mean_loss double, residual double"
    )


def coefficient_table(model: RiskModel, k: int = 20) -> DataFrame:
    """The k largest non-zero coefficients (a top-k report)."""
    return model.test.sparkSession.createDataFrame(
        model.coefficients(), "feature string, coefficient double"
    ).orderBy(F.desc("coefficient"), "feature").limit(k)


def stability(scored: DataFrame, score: str, segments: list[str], min_n: int = 50) -> DataFrame:
    """AUC and AP per value of each segment column with enough rows."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("segment"), F.col(c).alias("value")) for c in segments
    ]))
    long = scored.select(F.col(score).alias("s"), F.col(LABEL).alias("y"), pairs.alias("p"))
    long = long.select("s", "y", "p.segment", "p.value").where(F.col("value").isNotNull())
    table = scoring.auc_ap(long, "s", "y", ["segment", "value"])
    return table.where(F.col("n_samples") >= min_n).select(
        "segment", "value", "n_samples",
        round_half_away(F.col("auc"), 3).alias("auc"), round_half_away(F.col("ap"), 3).alias("ap"),
    ).orderBy("segment", F.desc("n_samples"))
