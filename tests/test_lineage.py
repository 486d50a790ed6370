"""Each condition of lineage and approval broken by itself."""

import hashlib
import json

from pyspark.sql import functions as F

from sluicebox.operators import lineage

RECORD = "scan_id long, origin string, parent_scan_id long, detected_type string, worker_status string, state string, decision string, release_eligible boolean, sha string, size_bytes long, policy_version string, policy_fingerprint string, evaluation string, codes array<string>"
ARTIFACT = "artifact_id long, artifact_type string, scan_id long, derived_scan_id long, sha string, size_bytes long, policy_version string, policy_fingerprint string"
PRINT = hashlib.sha256(b"p").hexdigest()
EVALUATION = {"policy_version": "1", "policy_fingerprint": PRINT, "risk_score": 0, "risk_band": "LOW", "decision": "ALLOW", "release_eligible": True, "analysis_complete": True, "hard_block_reasons": [], "mandatory_quarantine_reasons": []}
DERIVED = {"origin": "CDR_DERIVED", "parent_scan_id": None, "detected_type": "PDF", "worker_status": "SUCCESS", "state": "COMPLETED", "decision": "ALLOW", "release_eligible": True, "sha": "a", "size_bytes": 7, "policy_version": "1", "policy_fingerprint": PRINT, "evaluation": EVALUATION, "codes": []}

OF_BOTH = {"derived_origin": {"origin": "UPLOAD"}, "derived_parent": {"parent_scan_id": 9999}, "derived_type": {"detected_type": "ZIP"}, "derived_worker_status": {"worker_status": None}, "derived_state": {"state": "ANALYZING"}, "derived_decision": {"decision": "REVIEW"}, "derived_release": {"release_eligible": None}, "sha": {"sha": "b"}}
OF_LINEAGE = {"size_bytes": {"size_bytes": 8}, "policy_version": {"policy_version": "2"}, "policy_fingerprint": {"policy_fingerprint": "x"}, "evaluation_decision": {"decision": "BLOCK"}, "evaluation_release": {"release_eligible": "true"}, "evaluation_version": {"policy_version": "2"}, "evaluation_fingerprint": {"policy_fingerprint": "0" * 64}}
OF_APPROVAL = {"evaluation": {"risk_score": 101}, "analysis_complete": {"analysis_complete": False, "decision": "REVIEW", "release_eligible": False}, "hard_blocks": {"hard_block_reasons": ["A"], "decision": "BLOCK", "release_eligible": False}, "mandatory": {"mandatory_quarantine_reasons": ["A"]}}


def records(spark, changes):
    """A source and a derived scan for each change: ids 2k and 2k + 1."""
    rows = []
    for k, (columns, inside) in enumerate(changes):
        row = {**DERIVED, "parent_scan_id": 2 * k, **columns}
        row["evaluation"] = json.dumps({**EVALUATION, **inside}) if row["evaluation"] is EVALUATION else row["evaluation"]
        rows += [(2 * k, "UPLOAD", None, "PDF", "SUCCESS", "COMPLETED", "REVIEW", False, "s", 1, "1", PRINT, None, []), (2 * k + 1, *row.values())]
    return lineage.resolved(spark.createDataFrame(rows, RECORD))


def changes(of):
    return [({}, x) if n.startswith("evaluation_") else (x, {}) for n, x in of.items()]


def test_an_intact_artifact_has_no_faults_and_each_condition_is_seen(spark):
    of = OF_BOTH | OF_LINEAGE
    rows = [({}, {}), *changes(of), ({"evaluation": "[1]"}, {})]
    art = [(k, "PDF_CDR", 2 * k, 2 * k + 1, "a", 7, "1", PRINT) for k in range(len(rows))]
    art += [(100, "THUMBNAIL", 0, 1, "a", 7, "1", PRINT), (101, "PDF_CDR", 5000, 1, "a", 7, "1", PRINT), (102, "PDF_CDR", 0, 5001, "a", 7, "1", PRINT), (103, "PDF_CDR", 0, 1, "swapped", 7, "1", PRINT)]
    got = {r["artifact_id"]: r["faults"] for r in lineage.artifact_faults(spark.createDataFrame(art, ARTIFACT), records(spark, rows)).collect()}
    assert got[0] == [] and got[100] == ["artifact_type"] and got[103] == ["sha"]
    for k, name in enumerate(of, 1):
        assert got[k] == [name]
    assert got[len(of) + 1] == ["evaluation", "evaluation_decision", "evaluation_fingerprint", "evaluation_release", "evaluation_version"]
    assert got[101] == ["derived_parent", "source"] and len(got[102]) == 17


def test_each_condition_of_approval_is_seen(spark):
    own = {n: x for n, x in OF_APPROVAL.items()}
    rows = [({}, {}), *changes(OF_BOTH), *[({}, x) for x in own.values()], ({"codes": ["A", "OLE_MALFORMED"]}, {}), ({"codes": ["PDF_PARTIAL_ANALYSIS"]}, {}), ({"codes": ["PARTIAL"]}, {})]
    attempts = spark.range(len(rows)).select((2 * F.col("id")).alias("scan_id"), (2 * F.col("id") + 1).alias("derived_id"), F.lit("a").alias("candidate_sha"))
    got = {r["scan_id"] // 2: r["approval_faults"] for r in lineage.approval_faults(attempts, records(spark, rows)).collect()}
    assert got[0] == []
    for k, name in enumerate(OF_BOTH | own, 1):
        assert got[k] == (["analysis_complete", "evaluation", "hard_blocks", "mandatory"] if name == "evaluation" else [name])
    assert [got[k] for k in range(len(rows) - 3, len(rows))] == [["findings"], ["findings"], []]


def test_unchanged_sources_are_looked_for_among_all_scans(spark):
    """Every tenth scan has no stored result, and every tenth can't be read back; the policy's decision counts for all."""
    from sluicebox.plans import report_queries

    got = {r["scan_id"]: r for r in report_queries.l06_source_unchanged(spark, "/root/testdata/sf0.001").collect()}
    scans = {r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()}
    assert any(k % 10 == 3 for k in got) and {k for k in scans if k % 10 == 4} == {k for k, r in got.items() if r["lost"]}
