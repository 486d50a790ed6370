"""Cleaned copies of documents: whether a source may be cleaned, a re-scan approved, an artifact handed out.

Records are catalog rows of scans, sources and re-scans alike: scan_id, origin, parent_scan_id, detected_type,
worker_status, state, decision, release_eligible, sha, size_bytes, policy_version, policy_fingerprint,
evaluation (JSON as stored), codes (of findings). Conditions that can't be told are broken: what is missing
speaks against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
DECISIONS = ("ALLOW", "REVIEW", "QUARANTINE", "BLOCK")
BANDS = ("LOW", "MODERATE", "HIGH", "CRITICAL")
DERIVED_TYPE, ARTIFACT_TYPE, DERIVED_ORIGIN = "PDF", "PDF_CDR", "CDR_DERIVED"
UNREADABLE = ("PDF_PARTIAL_ANALYSIS", "PDF_MALFORMED", "PDF_ENCRYPTED")
MOST_PAGES = 100

_EVALUATION = """policy_version string, policy_fingerprint string, risk_score int, risk_band string, decision string, release_eligible boolean,
    analysis_complete boolean, hard_block_reasons array<string>, mandatory_quarantine_reasons array<string>"""


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def resolved(records: DataFrame) -> DataFrame:
    """Records with their stored evaluation read once: stored (null unless it is a JSON object) and valid."""
    own = F.when(F.json_object_keys("evaluation").isNotNull(), F.from_json("evaluation", _EVALUATION))
    rows = records.withColumn("stored", own)
    e = F.col("stored")
    hard, held = F.coalesce(e["hard_block_reasons"], F.array().cast("array<string>")), F.coalesce(e["mandatory_quarantine_reasons"], F.array().cast("array<string>"))
    ordered = lambda xs, most: (xs == F.array_sort(F.array_distinct(xs))) & (F.size(xs) <= most)
    valid = (
        F.length(e["policy_version"]).between(1, 32) & F.regexp_like(e["policy_fingerprint"], F.lit("^[0-9a-f]{64}$")) & e["risk_score"].between(0, 100) & e["risk_band"].isin(*BANDS) & e["decision"].isin(*DECISIONS)
        & (e["release_eligible"] == (e["decision"] == "ALLOW")) & e["analysis_complete"].isNotNull() & ordered(hard, 16) & ordered(held, 32)
        & ((F.size(hard) == 0) | (e["decision"] == "BLOCK")) & ((e["decision"] != "ALLOW") | e["analysis_complete"])
    )
    return rows.withColumns({"valid": _sure(valid), "hard_blocks": hard, "mandatory": held})


def _faults(conditions: dict[str, Column]) -> Column:
    """The names of the conditions that don't hold, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(~_sure(ok), F.lit(name)) for name, ok in conditions.items()])))


def _side(records: DataFrame, prefix: str) -> DataFrame:
    return records.select(*[F.col(c).alias(f"{prefix}_{c}") for c in records.columns])


def _released(p: str) -> dict[str, Column]:
    """What a re-scan must show by itself."""
    of = lambda c: F.col(f"{p}_{c}")
    return {
        "derived_origin": of("origin") == DERIVED_ORIGIN,
        "derived_type": of("detected_type") == DERIVED_TYPE,
        "derived_worker_status": of("worker_status") == "SUCCESS",
        "derived_state": of("state") == "COMPLETED",
        "derived_decision": of("decision") == "ALLOW",
        "derived_release": of("release_eligible"),
    }


def artifact_faults(artifacts: DataFrame, records: DataFrame) -> DataFrame:
    """Artifacts (artifact_id, artifact_type, scan_id, derived_scan_id, sha, size_bytes, policy_version, policy_fingerprint) with what their lineage breaks of 19 conditions.

    Records are resolved. An artifact without its source or derived scan breaks all that hangs on it.
    """
    rows = artifacts.join(_side(records.select("scan_id"), "source"), F.col("scan_id") == F.col("source_scan_id"), "left")
    rows = rows.withColumnRenamed("derived_scan_id", "derived_id").join(_side(records, "derived"), F.col("derived_id") == F.col("derived_scan_id"), "left")
    stored = F.col("derived_stored")
    conditions = {
        "artifact_type": F.col("artifact_type") == ARTIFACT_TYPE,
        "source": F.col("source_scan_id").isNotNull(),
        "derived": F.col("derived_scan_id").isNotNull(),
        **_released("derived"),
        "derived_parent": F.col("derived_parent_scan_id") == F.col("source_scan_id"),
        "sha": F.col("sha") == F.col("derived_sha"),
        "size_bytes": F.col("size_bytes") == F.col("derived_size_bytes"),
        "policy_version": F.col("policy_version") == F.col("derived_policy_version"),
        "policy_fingerprint": F.col("policy_fingerprint") == F.col("derived_policy_fingerprint"),
        "evaluation": stored.isNotNull(),
        "evaluation_decision": stored["decision"] == "ALLOW",
        "evaluation_release": stored["release_eligible"],
        "evaluation_version": stored["policy_version"] == F.col("policy_version"),
        "evaluation_fingerprint": stored["policy_fingerprint"] == F.col("policy_fingerprint"),
    }
    return rows.withColumn("faults", _faults(conditions))


def approval_faults(attempts: DataFrame, records: DataFrame) -> DataFrame:
    """Attempts (scan_id, derived_id, candidate_sha) with what their re-scan breaks of 13 conditions. Records are resolved."""
    rows = attempts.join(_side(records, "derived"), F.col("derived_id") == F.col("derived_scan_id"), "left")
    bad = F.exists("derived_codes", lambda c: c.endswith("_PARTIAL_ANALYSIS") | c.endswith("_MALFORMED"))
    conditions = {
        **_released("derived"),
        "derived_parent": F.col("derived_parent_scan_id") == F.col("scan_id"),
        "sha": F.col("derived_sha") == F.col("candidate_sha"),
        "evaluation": F.col("derived_valid"),
        "analysis_complete": F.col("derived_valid") & F.col("derived_stored")["analysis_complete"],
        "hard_blocks": F.col("derived_valid") & (F.size("derived_hard_blocks") == 0),
        "mandatory": F.col("derived_valid") & (F.size("derived_mandatory") == 0),
        "findings": ~F.coalesce(bad, F.lit(False)),
    }
    return rows.withColumn("approval_faults", _faults(conditions))


def eligibility(records: DataFrame, pages: DataFrame, stored: DataFrame, most_pages: int = MOST_PAGES) -> DataFrame:
    """Resolved records with the reasons against a cleaned copy, sorted, and whether there is none.

    Records have a storage_key; a key that isn't of letters, digits, `.`, `_`, `-` names no object. Pages are (scan_id,
    page_count); stored lists objects (object, object_sha, object_bytes, mode): one that is missing, differs
    or that others may read fails the integrity check.
    """
    rows = records.join(pages, "scan_id", "left").join(stored, F.col("storage_key") == F.col("object"), "left")
    named = F.regexp_like("storage_key", F.lit(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"))
    intact = (F.col("object_sha") == F.col("sha")) & (F.col("object_bytes") == F.col("size_bytes")) & (F.col("mode").bitwiseAND(F.lit(0o77)) == 0)
    conditions = {
        "NOT_PDF": F.col("detected_type") == "PDF",
        "ANALYSIS_NOT_SUCCESSFUL": (F.col("worker_status") == "SUCCESS") & F.col("state").isin("COMPLETED", "QUARANTINED"),
        "ANALYSIS_INCOMPLETE": F.col("valid") & F.col("stored")["analysis_complete"],
        "PDF_NOT_RENDERABLE": ~F.coalesce(F.arrays_overlap("codes", F.array(*map(F.lit, UNREADABLE))), F.lit(False)),
        "DECISION_NOT_REMEDIABLE": F.col("decision").isin("REVIEW", "QUARANTINE"),
        "SOURCE_BLOCKED": ~(_sure(F.col("decision") == "BLOCK") | (F.col("valid") & (F.size("hard_blocks") > 0))),
        "PAGE_COUNT_OUT_OF_RANGE": F.col("page_count").between(1, most_pages),
        "SOURCE_STORAGE_INVALID": named,
        "SOURCE_INTEGRITY_FAILED": ~_sure(named) | _sure(intact),
    }
    return rows.withColumn("reasons", _faults(conditions)).withColumn("eligible", F.size("reasons") == 0)


def eligibility_audit(asked: DataFrame, checked: DataFrame, version: str, fingerprint: str) -> DataFrame:
    """One audit row for each asked scan_id: outcome, the first reason, and details as JSON with sorted keys.

    A scan that the catalog doesn't know is denied under a null scan_id, with the id asked for in the details.
    """
    rows = asked.select(F.col("scan_id").alias("asked")).join(checked.withColumn("known", F.lit(True)), F.col("asked") == F.col("scan_id"), "left")
    reasons = F.when(F.col("known"), F.col("reasons")).otherwise(F.array(F.lit("SOURCE_NOT_FOUND")))
    details = F.to_json(F.struct(reasons.alias("reason_codes"), F.col("asked").cast("string").alias("requested_scan_id"), F.lit(fingerprint).alias("sanitizer_fingerprint"), F.lit(version).alias("sanitizer_version"), F.col("decision").alias("source_decision")), {"ignoreNullFields": "false"})
    return rows.select("asked", "scan_id", F.lit("CDR_ELIGIBILITY_CHECKED").alias("event_type"), F.when(F.size(reasons) == 0, "SUCCESS").otherwise("DENIED").alias("outcome"), F.get(reasons, F.lit(0)).alias("reason_code"), details.alias("details"))


def outcomes(attempts: DataFrame) -> DataFrame:
    """What became of each attempt, the first of these that fits, and whether it ended approved.

    Attempts are checked sources joined with approval_faults and: audited, existing (an artifact of the same
    source and sanitizer whose bytes verify), output_made, render_code (null: rendered), output_bytes and
    candidate_bytes, registered, promoted_sha and promoted_bytes (null: not promoted), saved ('saved', 'duplicate', 'invalid', 'failed'),
    existing_after (an artifact found after a duplicate).
    """
    of = F.col
    steps = [
        (~_sure(of("audited")), "audit_failure"),
        (~_sure(of("eligible")), "ineligible"),
        (of("existing").isNotNull(), "reused"),
        (~_sure(of("output_made")), "storage_failure"),
        (of("render_code").isNotNull(), of("render_code")),
        (~_sure(of("output_bytes") == of("candidate_bytes")), "hash_mismatch"),
        (~_sure(of("registered")), "database_failure"),
        (~_sure(F.size("approval_faults") == 0), "derived_analysis_rejected"),
        (of("promoted_sha").isNull(), "promotion_failure"),
        (~_sure((of("promoted_sha") == of("derived_sha")) & (of("promoted_bytes") == of("candidate_bytes"))), "hash_mismatch"),
        ((of("saved") == "duplicate") & of("existing_after").isNotNull(), "reused"),
        (of("saved") == "invalid", "audit_failure"),
        (~_sure(of("saved") == "saved"), "database_failure"),
    ]
    out = F.lit("approved")
    for condition, name in reversed(steps):
        out = F.when(condition, F.lit(name) if isinstance(name, str) else name).otherwise(out)
    return attempts.withColumn("outcome", out).withColumn("approved", F.col("outcome").isin("approved", "reused"))
