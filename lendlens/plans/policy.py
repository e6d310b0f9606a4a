"""Lending policy on top of a default probability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.operators.ntile import fit_ntile, ntile_bucket

# fixed values
LOSS_GIVEN_DEFAULT = 0.85
PROCESSING_FIXED = 0.3
PROCESSING_RATE = 0.012
CAPITAL_APR = 0.12
LIMITS = [200.0, 150.0, 100.0, 75.0]  # lowest to highest risk quartile


def loan_limits(scored: DataFrame, score: str) -> DataFrame:
    """Loan limit by risk quartile of the score."""
    cuts = fit_ntile(scored, score, "loan_id", len(LIMITS))
    quartile = ntile_bucket(F.col(score), F.col("loan_id"), cuts)
    return scored.withColumn("risk_quartile", quartile).withColumn(
        "loan_limit",
        F.element_at(F.array(*[F.lit(v) for v in LIMITS]), F.col("risk_quartile")),
    )


def expected_pnl(loans: DataFrame, score: str, days_outstanding: str) -> DataFrame:
    """Per loan: revenue, expected loss, processing and capital cost, expected PnL."""
    amount, days = F.col("amount"), F.col(days_outstanding)
    return loans.withColumns({
        "expected_loss": F.col(score) * amount * LOSS_GIVEN_DEFAULT,
        "processing_cost": F.lit(PROCESSING_FIXED) + amount * PROCESSING_RATE,
        "capital_cost": amount * CAPITAL_APR * days / 365.0,
    }).withColumn(
        "expected_pnl",
        F.col("revenue") - F.col("expected_loss") - F.col("processing_cost")
        - F.col("capital_cost"),
    )


def policy_pnl(loans: DataFrame, score: str, days_outstanding: str,
               thresholds: dict[str, float]) -> DataFrame:
    """Approved loans and their summed economics under each named threshold, in one pass."""
    priced = expected_pnl(loans, score, days_outstanding)
    parts = ["revenue", "expected_loss", "processing_cost", "capital_cost", "expected_pnl"]
    names = list(thresholds)
    facts = priced.agg(*[
        c for i, name in enumerate(names) for c in (
            F.count_if(F.col(score) < F.lit(thresholds[name])).alias(f"n{i}"),
            *[F.sum(F.when(F.col(score) < F.lit(thresholds[name]), F.col(p))).alias(f"{p}{i}")
              for p in parts],
        )
    ])
    return facts.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("policy"), F.lit(float(thresholds[name])).alias("threshold"),
                 F.col(f"n{i}").alias("approved_loans"),
                 *[F.col(f"{p}{i}").alias(p) for p in parts])
        for i, name in enumerate(names)
    ])).alias("r")).select("r.*")
