"""The two batch jobs: load the tables, run the quality suite."""

from __future__ import annotations

import logging
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.operators.cache import persisted
from lendlens.plans import quality
from lendlens.plans.catalog import LendingCatalog
from lendlens.session import configure
from lendlens.sources import ingest, snapshots

log = logging.getLogger(__name__)


def load(spark: SparkSession, csv_folder: str, target: str) -> dict[str, int]:
    """Full refresh of the typed tables from CSV; rows per table, -1 where loading failed.

    The tables and their views are registered for ``spark.sql`` anew.
    """
    configure(spark)
    text, failed = ingest.load_csv_files(spark, csv_folder)
    if not text:
        raise ValueError(f"no dataset could be read from {csv_folder}")
    rows = ingest.write_tables(text, target) | {t: -1 for t in failed}
    LendingCatalog(ingest.read_tables(spark, target), spark).register()
    return rows


def checks_of_version(spark: SparkSession, target: str, as_of: str) -> DataFrame:
    """The check rows of the current version of the tables, computed once a version and time.

    They are kept in the version's folder, so a new load has none of the old ones.
    """
    found = snapshots.current(spark, target)
    if found is None:
        raise FileNotFoundError(f"nothing has been loaded into {target}")
    path = f"{found[0]}/checks-{as_of.replace(' ', 'T').replace(':', '')}"
    if not ingest.path_exists(spark, f"{path}/_SUCCESS"):
        catalog = LendingCatalog(ingest.read_tables(spark, target), spark)
        checks = quality.all_checks(catalog.base, catalog.check_views(), catalog.row_views(), as_of)
        checks.coalesce(1).write.mode("overwrite").parquet(path)  # a few dozen rows
    return spark.read.parquet(path)


def run_quality_suite(catalog: LendingCatalog, folder: str | None = None, as_of=None) -> dict:
    """Run every check once; write the report and the failed checks if a folder is given.

    The check rows (a few dozen and one per province) are kept while the status and
    both files are made from them. ``exit_code`` is 0 if all passed, 1 if some failed
    and 2 if the suite could not run, with the reason as ``error``.
    """
    try:
        checks = quality.all_checks(catalog.base, catalog.check_views(), catalog.row_views(), as_of)
        with persisted(checks):
            return _reported(checks, folder)
    except Exception as error:
        log.exception("the quality suite could not run")
        return {"overall_status": "ERROR", "error": str(error), "files": {}, "exit_code": 2}


def _reported(checks: DataFrame, folder: str | None) -> dict:
    now = datetime.now(timezone.utc)
    status = quality.overall_status(checks).first().asDict()
    files = {}
    if folder:
        stamp = now.strftime("%Y%m%d_%H%M%S")
        files["report"] = f"{folder}/data_quality_report_{stamp}"
        ingest.write_report_json(report_document(checks, status, now), files["report"])
        failed = f"{folder}/failed_checks_{stamp}"
        if ingest.write_failed_csv(checks, failed):
            files["failed_checks"] = failed
    return {**status, "files": files, "exit_code": quality.exit_code(status["overall_status"])}


def report_document(checks: DataFrame, status: dict, now: datetime) -> DataFrame:
    """The whole report as one row: time, status, totals per category and their check rows."""
    columns = [c for c in checks.columns if c != "category"]
    category = checks.groupBy("category").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.sort_array(F.collect_list(F.struct(*columns))).alias("details"),
    )
    return category.agg(
        F.lit(now.isoformat()).alias("timestamp"),
        *[F.lit(v).alias(k) for k, v in status.items()],
        F.sum("checks").alias("total_checks"), F.sum("passed").alias("total_passed"),
        F.sum("failed").alias("total_failed"),
        F.sort_array(F.collect_list(F.struct("category", "checks", "passed", "failed", "details"))).alias("categories"),
    )
