"""Rendered copies: the contract of a render result, the outcome of an attempt, and the follow-up of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result_rules(version: str, operation: str) -> dict[str, Column]:
    """What holds of a render result (schema_version, operation, status, failure_code, page_count, output_bytes)."""
    failed, code = F.col("status") == "FAILED", F.col("failure_code")
    return {
        "contract": (F.col("schema_version") == version) & (F.col("operation") == operation),
        "failure_code": ~failed | code.isNotNull(),
        "success": failed | (code.isNull() & (F.col("page_count") >= 1) & (F.col("output_bytes") >= 1)),
    }


def outcome(violations: Column, renderer: str) -> Column:
    """Why an attempt gave no copy, the first reason that fits; null if it did."""
    return (
        F.when(F.col("unavailable"), "renderer_unavailable")
        .when(F.col("timed_out"), "render_timeout")
        .when(F.col("output_over") | (F.col("exit_code") != 0), "render_failed")
        .when((F.size(violations) > 0) | ~F.col("renderer").eqNullSafe(F.lit(renderer)), "output_invalid")
        .when(F.col("status") == "FAILED", F.coalesce("failure_code", F.lit("render_failed")))
    )


def follow_up(attempts: DataFrame) -> DataFrame:
    """Attempts (approved, failure, derived_scan_id) with eligible, derived and misplaced.

    A scan was eligible if its copy was approved or failed for another reason than `ineligible`; only then its
    derived scan counts. `misplaced` marks a derived scan of one that was not.
    """
    eligible = F.coalesce("approved", F.lit(False)) | F.coalesce(F.col("failure") != "ineligible", F.lit(False))
    rows = attempts.withColumn("eligible", eligible)
    return rows.withColumns({"derived": F.when(F.col("eligible"), F.col("derived_scan_id")), "misplaced": ~F.col("eligible") & F.col("derived_scan_id").isNotNull()})
