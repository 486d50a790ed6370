"""The policy on hand-made findings."""

import pytest

from sluicebox.operators import policy
from sluicebox.plans import dims

CASES = [
    ([], "SUCCESS", "PDF", (0, "LOW", "ALLOW")),
    (["PDF_ACROFORM", "PDF_ACROFORM"], "SUCCESS", "PDF", (8, "LOW", "ALLOW")),
    (["PDF_JAVASCRIPT"], "SUCCESS", "PDF", (20, "MODERATE", "REVIEW")),
    (["PDF_JAVASCRIPT", "PDF_OPEN_ACTION"], "SUCCESS", "PDF", (56, "HIGH", "QUARANTINE")),
    (["FILE_EXECUTABLE_MASQUERADE"], "SUCCESS", "PDF", (50, "HIGH", "BLOCK")),
    (["PDF_LAUNCH_ACTION"], "SUCCESS", "PDF", (45, "HIGH", "QUARANTINE")),
    (["PDF_EMBEDDED_FILE", "PDF_XFA", "FILE_DOUBLE_EXTENSION"], "SUCCESS", "PDF", (72, "CRITICAL", "QUARANTINE")),
    ([], "TIMEOUT", "PDF", (0, "LOW", "QUARANTINE")),
    ([], None, None, (0, "LOW", "QUARANTINE")),
    ([], "SUCCESS", None, (0, "LOW", "QUARANTINE")),
    (["PDF_MALFORMED"], "SUCCESS", "PDF", (45, "HIGH", "QUARANTINE")),
    (["NO_SUCH_CODE"], "SUCCESS", "PDF", (0, "LOW", "QUARANTINE")),
]


@pytest.fixture(scope="module")
def results(spark):
    scans = spark.createDataFrame([(k, s, t, None, "COMPLETED") for k, (_, s, t, _) in enumerate(CASES)], "scan_id long, status string, detected_type string, failure_code string, state string")
    findings = spark.createDataFrame([(k, c) for k, (codes, *_) in enumerate(CASES) for c in codes], "scan_id long, code string")
    return {r["scan_id"]: r for r in policy.evaluate(scans, findings, dims.finding_dim(spark), dims.compound_dim(spark)).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_decision(results, k):
    r = results[k]
    assert (r["score"], r["band"], r["decision"]) == CASES[k][3]
    assert r["release_eligible"] == (r["decision"] == "ALLOW")


def test_registry_is_sound(spark):
    from sluicebox.operators import contracts

    assert contracts.registry_faults(dims.finding_dim(spark), dims.compound_dim(spark), dims.registry_dim(spark)).count() == 0
    assert len(dims.finding_rows()) == 45 and len(dims.compound_rows()) == 5
