"""Regression-adjusted effects of the tip experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.functions import flag, round_half_away
from lendlens.operators.cache import persisted
from lendlens.operators.regression import design_of, logit_by_stratum, ols_hc1
from lendlens.plans.experiments import collapse_rare, tip_loans

BASELINES = {
    "tip_test_group": "control", "price_test_group": "A", "risk_score_decile": None,
    "province": None,
}
OLS_METRICS = {"Mean tip ($)": "tip_amount", "RPDL ($)": "revenue"}
LOGIT_METRICS = {"Take-rate (AME)": "tip_taken", "Default (AME)": "is_default"}
STEPS = 12  # Newton steps of a stratum; a finite optimum takes about half as many
_EFFECT = ("metric string, tip_variant string, effect double, ci_low double, ci_high double,"
           " p_value double, unit string")


def analysis_frame(loans: DataFrame) -> DataFrame:
    """Disbursed loans of the tip arms with outcomes and covariates."""
    return tip_loans(loans).select(
        *BASELINES, "amount", "tip_amount", "revenue", "is_default",
        flag(F.col("tip_amount") > 0).alias("tip_taken"),
    )


def _rows(metric: str, unit: str, effects: list[dict], scale: float) -> list[tuple]:
    return [
        (metric, e["level"], scale * e["effect"], scale * e["ci_low"], scale * e["ci_high"],
         e["p_value"], unit)
        for e in effects if e["term"] == "tip_test_group"
    ]


def _ols_rows(frame: DataFrame) -> list[tuple]:
    design = design_of(frame, BASELINES, "amount")
    return [
        r for metric, y in OLS_METRICS.items()
        for r in _rows(metric, "$", ols_hc1(frame, y, design), 1.0)
    ]


def _logit_rows(frame: DataFrame) -> list[tuple]:
    design = design_of(frame, BASELINES, "amount")
    frame = frame.withColumn("all_rows", F.lit(0))
    rows = []
    for metric, y in LOGIT_METRICS.items():
        fit = logit_by_stratum(frame, y, design, "all_rows").get(0)
        if fit is not None:
            if not fit.converged:
                raise ArithmeticError(f"the logit of {metric} does not converge")
            rows += _rows(metric, "pp", fit.marginal_effects(design), 100.0)
    return rows


def ols_effects(loans: DataFrame) -> DataFrame:
    """Adjusted effect on mean tip and revenue per loan, HC1 errors."""
    with persisted(analysis_frame(loans)) as frame:
        return loans.sparkSession.createDataFrame(_ols_rows(frame), _EFFECT)


def logit_effects(loans: DataFrame) -> DataFrame:
    """Adjusted average marginal effect on take-rate and default, in points."""
    with persisted(analysis_frame(loans)) as frame:
        return loans.sparkSession.createDataFrame(_logit_rows(frame), _EFFECT)


def effects_table(loans: DataFrame) -> DataFrame:
    """All effects, rounded by unit (1 digit for points, 2 for dollars)."""
    with persisted(analysis_frame(loans)) as frame:
        both = loans.sparkSession.createDataFrame(
            _ols_rows(frame) + _logit_rows(frame), _EFFECT
        )

    def shown(c: str):
        v = round_half_away(F.col(c), 3)
        return F.when(F.col("unit") == "pp", round_half_away(v, 1)).otherwise(
            round_half_away(v, 2)
        ).alias(c)

    return both.select(
        "metric", "tip_variant", shown("effect"), shown("ci_low"), shown("ci_high"),
        round_half_away(F.col("p_value"), 3).alias("p_value"), "unit",
    ).orderBy("metric", "p_value", "tip_variant")


def heterogeneity(loans: DataFrame, min_stratum: int = 50, min_province: int = 20) -> DataFrame:
    """Take-rate effect within each risk decile.

    Every disbursed loan takes part, those outside the tip test as an arm of
    their own. Small strata are left out, rare provinces pooled. Where the outcome
    is separated by the terms the coefficients grow without end, and where terms
    depend on each other they are not determined: such a stratum, known by steps that
    have not become small after STEPS of them, has no effects, but the reason.
    """
    disbursed = loans.where(F.col("is_disbursed") == 1).select(
        "tip_test_group", "price_test_group", "risk_score_decile", "province",
        (F.col("amount") / 1000.0).alias("amount_k"),
        flag(F.col("tip_amount") > 0).alias("tip_taken"),
    )
    frame = collapse_rare(disbursed, "province", min_province)
    large = frame.groupBy("risk_score_decile").agg(F.count(F.lit(1)).alias("__n")).where(
        F.col("__n") >= min_stratum
    )
    frame = frame.join(large.select("risk_score_decile"), "risk_score_decile", "left_semi")
    baselines = {"tip_test_group": "control", "price_test_group": "A", "province": None}
    rows = []
    with persisted(frame):
        strata = {}
        if not frame.isEmpty():
            design = design_of(frame, baselines, "amount_k")
            strata = logit_by_stratum(frame, "tip_taken", design, "risk_score_decile", max_iter=STEPS)
        for decile, fit in sorted(strata.items()):
            for e in fit.marginal_effects(design):
                if e["term"] == "tip_test_group" and e["level"] in ("persuasive", "social_proof"):
                    fits = fit.converged and fit.determined
                    shown = [100 * e["effect"], 100 * e["ci_low"], 100 * e["ci_high"], e["p_value"]]
                    rows.append((
                        decile, e["level"], *(shown if fits else [None] * 4), int(fit.n), fits,
                        None if fits else "no finite optimum",
                    ))
    raw = loans.sparkSession.createDataFrame(
        rows, "risk_decile int, tip_variant string, effect_pp double, ci_low_pp double,"
              " ci_high_pp double, p_value double, n bigint, converged boolean, reason string",
    )
    return raw.withColumns({
        **{c: round_half_away(F.col(c), 2) for c in ("effect_pp", "ci_low_pp", "ci_high_pp")},
        "p_value": round_half_away(F.col("p_value"), 3),
    }).orderBy("risk_decile", "tip_variant")


def effect_flags(table: DataFrame) -> DataFrame:
    """Significance, direction and size flags of the per-decile effects."""
    return table.select(
        "risk_decile", "tip_variant", "effect_pp", "ci_low_pp", "ci_high_pp", "p_value",
        (F.col("p_value") < 0.05).alias("is_sig"),
        F.when(F.col("effect_pp") > 0, "positive")
        .when(F.col("effect_pp").isNotNull(), "negative").alias("direction"),
        (F.abs("effect_pp") > 5).alias("large_effect"),
        "n", "converged", "reason",
    )


def interaction_model(loans: DataFrame) -> DataFrame:
    """Price and tip arms with their interaction, on revenue per loan, HC1 errors."""
    frame = analysis_frame(loans).where(F.col("price_test_group").isin("A", "B")).withColumn(
        "arm", F.concat_ws("_", "price_test_group", "tip_test_group")
    )
    with persisted(frame):
        design = design_of(
            frame, {"arm": "A_control", "risk_score_decile": None, "province": None}, "amount"
        )
        rows = [
            (e["level"], e["effect"], e["std_err"], e["p_value"])
            for e in ols_hc1(frame, "revenue", design) if e["term"] == "arm"
        ]
    return loans.sparkSession.createDataFrame(
        rows, "combination string, effect double, std_err double, p_value double"
    )
