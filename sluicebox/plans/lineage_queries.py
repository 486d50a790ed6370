"""Registered queries on cleaned copies: eligibility, re-scans, outcomes, lineage of artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage
from .queries import joined, query
from .views import view

# The stored evaluation: j its JSON if that is an object, and whether all of it is as it should be.
_RECORD_SQL = r"""WITH r0 AS (SELECT *, CASE WHEN json_valid(evaluation) AND json_type(evaluation) = 'OBJECT' THEN evaluation END AS j FROM v_record),
    r1 AS (SELECT *, json_extract_string(j, '$.decision') AS e_decision, json_extract_string(j, '$.policy_version') AS e_version, json_extract_string(j, '$.policy_fingerprint') AS e_fingerprint, json_extract_string(j, '$.risk_band') AS e_band, CAST(json_extract_string(j, '$.risk_score') AS INTEGER) AS e_score,
        CASE CAST(json_extract(j, '$.release_eligible') AS VARCHAR) WHEN 'true' THEN true WHEN 'false' THEN false END AS e_release, CASE CAST(json_extract(j, '$.analysis_complete') AS VARCHAR) WHEN 'true' THEN true WHEN 'false' THEN false END AS e_complete,
        coalesce(CAST(json_extract(j, '$.hard_block_reasons') AS VARCHAR[]), []) AS hard, coalesce(CAST(json_extract(j, '$.mandatory_quarantine_reasons') AS VARCHAR[]), []) AS held FROM r0),
    rec AS (SELECT *, coalesce(length(e_version) BETWEEN 1 AND 32 AND regexp_matches(e_fingerprint, '^[0-9a-f]{64}$') AND e_score BETWEEN 0 AND 100 AND e_band IN ('LOW', 'MODERATE', 'HIGH', 'CRITICAL') AND e_decision IN ('ALLOW', 'REVIEW', 'QUARANTINE', 'BLOCK') AND e_release = (e_decision = 'ALLOW')
        AND e_complete IS NOT NULL AND hard = list_sort(list_distinct(hard)) AND held = list_sort(list_distinct(held)) AND (len(hard) = 0 OR e_decision = 'BLOCK') AND (e_decision <> 'ALLOW' OR e_complete), false) AS valid, list_filter(string_split(codes, ','), x -> x <> '') AS code_list FROM r1) """


def _faults_sql(conditions: dict[str, str]) -> str:
    return "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in conditions.items()) + "], x -> x IS NOT NULL)), ',')"


_RELEASED = {"derived_origin": "d.origin = 'CDR_DERIVED'", "derived_type": "d.detected_type = 'PDF'", "derived_worker_status": "d.worker_status = 'SUCCESS'", "derived_state": "d.state = 'COMPLETED'", "derived_decision": "d.decision = 'ALLOW'", "derived_release": "d.release_eligible"}


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = view(spark, sf_dir, "v_record").withColumn("codes", F.filter(F.split("codes", ","), lambda c: c != ""))
    return lineage.resolved(records)


@query(_RECORD_SQL + "SELECT a.artifact_id, " + _faults_sql({
    "artifact_type": "a.artifact_type = 'PDF_CDR'", "source": "s.scan_id IS NOT NULL", "derived": "d.scan_id IS NOT NULL", **_RELEASED, "derived_parent": "d.parent_scan_id = s.scan_id", "sha": "a.sha = d.sha", "size_bytes": "a.size_bytes = d.size_bytes",
    "policy_version": "a.policy_version = d.policy_version", "policy_fingerprint": "a.policy_fingerprint = d.policy_fingerprint", "evaluation": "d.j IS NOT NULL", "evaluation_decision": "d.e_decision = 'ALLOW'", "evaluation_release": "d.e_release",
    "evaluation_version": "d.e_version = a.policy_version", "evaluation_fingerprint": "d.e_fingerprint = a.policy_fingerprint",
}) + " AS faults FROM v_cleaned a LEFT JOIN rec s ON s.scan_id = a.scan_id LEFT JOIN rec d ON d.scan_id = a.derived_scan_id")
def l01_artifact_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.artifact_faults(view(spark, sf_dir, "v_cleaned"), _records(spark, sf_dir)).select("artifact_id", joined("faults").alias("faults"))


_APPROVAL_SQL = _faults_sql({
    **_RELEASED, "derived_parent": "d.parent_scan_id = a.scan_id", "sha": "d.sha = a.candidate_sha", "evaluation": "d.valid", "analysis_complete": "d.valid AND d.e_complete", "hard_blocks": "d.valid AND len(d.hard) = 0", "mandatory": "d.valid AND len(d.held) = 0",
    "findings": "len(list_filter(d.code_list, x -> ends_with(x, '_PARTIAL_ANALYSIS') OR ends_with(x, '_MALFORMED'))) = 0",
})


@query(_RECORD_SQL + f"SELECT a.scan_id, {_APPROVAL_SQL} AS faults FROM v_attempted a LEFT JOIN rec d ON d.scan_id = a.derived_id")
def l03_derived_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.approval_faults(view(spark, sf_dir, "v_attempted"), _records(spark, sf_dir)).select("scan_id", joined("approval_faults").alias("faults"))


_NAMED = "regexp_matches(s.storage_key, '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$')"
_ELIGIBLE_SQL = _RECORD_SQL + ", checked AS (SELECT s.scan_id, s.decision, " + _faults_sql({
    "NOT_PDF": "s.detected_type = 'PDF'", "ANALYSIS_NOT_SUCCESSFUL": "s.worker_status = 'SUCCESS' AND s.state IN ('COMPLETED', 'QUARANTINED')", "ANALYSIS_INCOMPLETE": "s.valid AND s.e_complete", "PDF_NOT_RENDERABLE": "NOT list_has_any(s.code_list, ['PDF_PARTIAL_ANALYSIS', 'PDF_MALFORMED', 'PDF_ENCRYPTED'])",
    "DECISION_NOT_REMEDIABLE": "s.decision IN ('REVIEW', 'QUARANTINE')", "SOURCE_BLOCKED": "NOT (coalesce(s.decision = 'BLOCK', false) OR s.valid AND len(s.hard) > 0)", "PAGE_COUNT_OUT_OF_RANGE": "(s.scan_id // 2) % 110 BETWEEN 1 AND 100", "SOURCE_STORAGE_INVALID": _NAMED,
    "SOURCE_INTEGRITY_FAILED": f"NOT {_NAMED} OR coalesce(o.sha = s.sha AND o.size_bytes = s.size_bytes AND o.mode & 63 = 0, false)",
}) + " AS reasons FROM rec s LEFT JOIN (SELECT * FROM v_listing WHERE area = 'documents') o ON o.name = s.storage_key WHERE s.origin = 'UPLOAD' AND s.scan_id % 2 = 0) "


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir).where("origin = 'UPLOAD' AND scan_id % 2 = 0")
    pages = view(spark, sf_dir, "v_scan").select((2 * F.col("scan_id")).alias("scan_id"), (F.col("scan_id") % 110).alias("page_count"))
    stored = view(spark, sf_dir, "v_listing").where("area = 'documents'").select(F.col("name").alias("object"), F.col("sha").alias("object_sha"), F.col("size_bytes").alias("object_bytes"), "mode")
    return lineage.eligibility(records, pages, stored)


@query(_ELIGIBLE_SQL + "SELECT scan_id, reasons, reasons = '' AS eligible FROM checked")
def l02_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("scan_id", joined("reasons").alias("reasons"), "eligible")


@query(_ELIGIBLE_SQL + """, asked AS (SELECT doc_id * 3 AS asked FROM documents)
    SELECT asked, scan_id, CASE WHEN why = '' THEN 'SUCCESS' ELSE 'DENIED' END AS outcome, CASE WHEN why <> '' THEN string_split(why, ',')[1] END AS reason_code,
           concat('{"reason_codes":[', CASE WHEN why = '' THEN '' ELSE '"' || replace(why, ',', '","') || '"' END, '],"requested_scan_id":"', asked, '","sanitizer_fingerprint":"f","sanitizer_version":"1","source_decision":', CASE WHEN decision IS NULL THEN 'null' ELSE '"' || decision || '"' END, '}') AS details
    FROM (SELECT asked, scan_id, decision, CASE WHEN scan_id IS NULL THEN 'SOURCE_NOT_FOUND' ELSE reasons END AS why FROM asked LEFT JOIN checked ON asked = scan_id)""")
def l07_eligibility_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf_dir}/documents.parquet").select((3 * F.col("doc_id")).alias("scan_id"))
    return lineage.eligibility_audit(asked, _checked(spark, sf_dir), "1", "f").drop("event_type")


@query(_ELIGIBLE_SQL + f""", tried AS (SELECT a.*, c.reasons, d.sha AS derived_sha, {_APPROVAL_SQL} AS faults FROM v_attempted a LEFT JOIN checked c USING (scan_id) LEFT JOIN rec d ON d.scan_id = a.derived_id),
    done AS (SELECT scan_id, CASE WHEN NOT audited THEN 'audit_failure' WHEN coalesce(reasons, 'x') <> '' THEN 'ineligible' WHEN existing IS NOT NULL THEN 'reused' WHEN NOT output_made THEN 'storage_failure' WHEN render_code IS NOT NULL THEN render_code WHEN output_bytes <> candidate_bytes THEN 'hash_mismatch' WHEN NOT registered THEN 'database_failure'
      WHEN faults <> '' THEN 'derived_analysis_rejected' WHEN promoted_sha IS NULL THEN 'promotion_failure' WHEN promoted_sha <> derived_sha OR promoted_bytes <> candidate_bytes THEN 'hash_mismatch' WHEN saved = 'duplicate' AND existing_after IS NOT NULL THEN 'reused' WHEN saved = 'invalid' THEN 'audit_failure' WHEN saved <> 'saved' THEN 'database_failure' ELSE 'approved' END AS outcome FROM tried)
    SELECT *, outcome IN ('approved', 'reused') AS approved FROM done""")
def l08_remediation_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _checked(spark, sf_dir).select("scan_id", "eligible")
    tried = lineage.approval_faults(view(spark, sf_dir, "v_attempted"), _records(spark, sf_dir)).join(checked, "scan_id", "left")
    return lineage.outcomes(tried).select("scan_id", "outcome", "approved")
