"""The canonical views over one set of base tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from lendlens.plans import clean, experiments, funnel, history, risk_base
from lendlens.session import configure
from lendlens.sources import binding


class LendingCatalog:
    """Lazy canonical views; each is built on first use and shared afterwards."""

    def __init__(self, base: Mapping[str, DataFrame], spark: SparkSession | None = None,
                 sf_dir: str | None = None):
        self.base = base
        self.spark = spark
        self.sf_dir = sf_dir

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> LendingCatalog:
        return cls(binding.bind(configure(spark), sf_dir), spark, sf_dir)

    @cached_property
    def users_enriched(self) -> DataFrame:
        """Clean users without the fitted decile, for consumers that do not read it."""
        return clean.enrich_users(self.base["dim_users"])

    @cached_property
    def users(self) -> DataFrame:
        return clean.clean_users(self.base["dim_users"])

    @cached_property
    def transactions(self) -> DataFrame:
        return clean.clean_transactions(self.base["fct_transactions"])

    @cached_property
    def loans_enriched(self) -> DataFrame:
        """Clean loans without the first-loan flag, which takes a join."""
        return clean.enrich_loans(self.base["fct_loans"])

    @cached_property
    def loans(self) -> DataFrame:
        return clean.clean_loans(self.base["fct_loans"])

    @cached_property
    def assignments_enriched(self) -> DataFrame:
        return clean.enrich_assignments(self.base["ab_assignments"])

    @cached_property
    def assignments(self) -> DataFrame:
        return clean.clean_assignments(self.base["ab_assignments"])

    @cached_property
    def sessions_enriched(self) -> DataFrame:
        return clean.enrich_sessions(self.base["fct_sessions"])

    @cached_property
    def sessions(self) -> DataFrame:
        return clean.clean_sessions(self.base["fct_sessions"])

    @cached_property
    def funnel_base(self) -> DataFrame:
        return funnel.user_funnel_base(
            self.users_enriched, self.sessions_enriched, self.loans_enriched
        )

    @cached_property
    def segments(self) -> DataFrame:
        return funnel.funnel_by_segment(self.funnel_base)

    @cached_property
    def user_assignments(self) -> DataFrame:
        return experiments.user_assignments(self.base["ab_assignments"])

    @cached_property
    def loans_with_experiments(self) -> DataFrame:
        return experiments.loans_with_experiments(
            self.loans_enriched, self.user_assignments, self.users
        )

    @cached_property
    def loans_with_arms(self) -> DataFrame:
        """The same without the fitted decile, for consumers that do not read it."""
        return experiments.loans_with_experiments(
            self.loans_enriched, self.user_assignments, self.users_enriched
        )

    @cached_property
    def transactions_for_risk(self) -> DataFrame:
        return risk_base.transactions_for_risk(self.transactions)

    @cached_property
    def prior_performance(self) -> DataFrame:
        return history.prior_loan_performance(self.loans_enriched)

    @cached_property
    def risk_model_base(self) -> DataFrame:
        return risk_base.risk_model_base(
            self.users_enriched, self.loans_enriched, self.transactions
        )

    def clean_views(self) -> dict[str, DataFrame]:
        """The five cleaned tables with all their joins, without the order of rows and the fitted decile."""
        return {
            "v_dim_users_clean": self.users_enriched,
            "v_fct_transactions_clean": self.transactions,
            "v_fct_loans_clean": self.loans,
            "v_ab_assignments_clean": clean.grouped_assignments(self.base["ab_assignments"]),
            "v_fct_sessions_clean": clean.grouped_sessions(self.base["fct_sessions"]),
        }

    def row_views(self) -> dict[str, DataFrame]:
        """The cleaned tables with row-level columns only: plain projections."""
        return {
            "v_dim_users_clean": self.users_enriched,
            "v_fct_transactions_clean": self.transactions,
            "v_fct_loans_clean": self.loans_enriched,
            "v_ab_assignments_clean": self.assignments_enriched,
            "v_fct_sessions_clean": self.sessions_enriched,
        }

    def check_views(self) -> dict[str, DataFrame]:
        """The views the quality checks read."""
        return {
            **self.clean_views(),
            "v_user_funnel_base": self.funnel_base,
            "v_risk_model_base": self.risk_model_base,
        }

    def counted_views(self) -> dict[str, DataFrame]:
        """All views for counting, which reads no fitted decile."""
        return {
            **self.clean_views(),
            "v_user_funnel_base": self.funnel_base,
            "v_funnel_by_segment": self.segments,
            "v_user_experiment_assignments": self.user_assignments,
            "v_loans_with_experiments": self.loans_with_arms,
            "v_fct_transactions_for_risk": self.transactions_for_risk,
            "v_user_prior_loan_perf": self.prior_performance,
            "v_risk_model_base": self.risk_model_base,
        }

    def views(self) -> dict[str, DataFrame]:
        return {
            "v_dim_users_clean": self.users,
            "v_fct_transactions_clean": self.transactions,
            "v_fct_loans_clean": self.loans,
            "v_ab_assignments_clean": self.assignments,
            "v_fct_sessions_clean": self.sessions,
            "v_user_funnel_base": self.funnel_base,
            "v_funnel_by_segment": self.segments,
            "v_user_experiment_assignments": self.user_assignments,
            "v_loans_with_experiments": self.loans_with_experiments,
            "v_fct_transactions_for_risk": self.transactions_for_risk,
            "v_user_prior_loan_perf": self.prior_performance,
            "v_risk_model_base": self.risk_model_base,
        }

    def register(self) -> None:
        """Make base tables and views available to ``spark.sql``."""
        for name, df in {**self.base, **self.views()}.items():
            df.createOrReplaceTempView(name)
