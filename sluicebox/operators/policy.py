"""The risk policy: findings of a scan to points, band, reasons and a decision.

One shuffle on the scan id for the findings; dimension tables are of fixed size and broadcast. What
is missing or unknown is contained: scans are joined from the left, never inner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import canonical
from ..plans.dims import SUPPORTED_TYPES


def none() -> Column:
    """An empty list of strings."""
    return F.array().cast("array<string>")


def risk_band(score: Column) -> Column:
    return F.when(score >= 70, "CRITICAL").when(score >= 40, "HIGH").when(score >= 20, "MODERATE").otherwise("LOW")


def compound_hits(codes: DataFrame, compounds: DataFrame) -> DataFrame:
    """Compound rules all of whose codes a scan has, from distinct (scan_id, code)."""
    need = compounds.select("name", "points", "floor", F.size("required").alias("need"), F.explode("required").alias("code"))
    hits = codes.join(F.broadcast(need), "code").groupBy("scan_id", "name", "points", "floor", "need").agg(F.count(F.lit(1)).alias("n"))
    return hits.where("n = need").select("scan_id", "name", "points", "floor")


def completeness(partial: Column) -> Column:
    """Reasons why an analysis isn't complete, from the columns status, detected_type, failure_code and state."""
    status = F.col("status")
    return F.array_sort(
        F.array_compact(
            F.array(
                F.when(status.isNull(), "POLICY_ANALYSIS_RESULT_MISSING"),
                F.when(status.isin("FAILED", "TIMEOUT", "UNSUPPORTED"), F.concat(F.lit("POLICY_ANALYSIS_STATUS_"), status)),
                F.when(status.isNotNull() & ~F.coalesce(F.col("detected_type"), F.lit("")).isin(*SUPPORTED_TYPES), "POLICY_UNSUPPORTED_DETECTED_TYPE"),
                F.when((status == "SUCCESS") & partial, "POLICY_ANALYSIS_CONTRADICTION"),
                F.when(F.col("failure_code").isNotNull(), "POLICY_ANALYSIS_FAILURE"),
                F.when(~F.col("state").isin("ANALYZING", "COMPLETED"), "POLICY_LIFECYCLE_INCONSISTENCY"),
            )
        )
    )


def evaluate(scans: DataFrame, findings: DataFrame, policy: DataFrame, compounds: DataFrame) -> DataFrame:
    """One evaluation for each scan (scan_id, status, detected_type, failure_code, state).

    A code counts once for a scan however often it was found. A code without a policy fails the scan
    closed: no points, QUARANTINE, incomplete.
    """
    codes = findings.select("scan_id", "code").distinct()
    known = codes.join(F.broadcast(policy), "code", "left")
    only = lambda cond, value: F.array_sort(F.collect_set(F.when(cond, value)))
    own = known.groupBy("scan_id").agg(
        F.bool_or(F.col("points").isNull()).alias("unknown"),
        F.sum("points").alias("code_points"),
        only(F.col("hard_block"), F.col("code")).alias("hard"),
        only(F.col("floor") == "QUARANTINE", F.col("code")).alias("floors"),
        only(F.lit(True), F.col("code")).alias("codes"),
        only(F.lit(True), F.concat_ws("=", "code", "points")).alias("code_contributions"),
        F.bool_or(F.endswith("code", F.lit("_PARTIAL_ANALYSIS")) | F.endswith("code", F.lit("_MALFORMED"))).alias("partial"),
    )
    together = compound_hits(codes, compounds).groupBy("scan_id").agg(F.sum("points").alias("compound_points"), only(F.lit(True), F.col("name")).alias("compounds"), only(F.col("floor") == "QUARANTINE", F.col("name")).alias("compound_floors"), only(F.lit(True), F.concat_ws("=", "name", "points")).alias("compound_contributions"))
    rows = scans.join(own, "scan_id", "left").join(together, "scan_id", "left")
    lists = ("hard", "floors", "codes", "code_contributions", "compounds", "compound_floors", "compound_contributions")
    rows = rows.withColumns({c: F.coalesce(c, none()) for c in lists} | {"unknown": F.coalesce("unknown", F.lit(False)), "partial": F.coalesce("partial", F.lit(False))})
    rows = rows.withColumn("incomplete", completeness(F.col("partial"))).withColumn("score", F.least(F.lit(100), F.coalesce("code_points", F.lit(0)) + F.coalesce("compound_points", F.lit(0))).cast("int"))
    rows = rows.withColumn("mandatory", F.array_sort(F.array_union(F.array_union("floors", "compound_floors"), "incomplete")))
    decision = F.when(F.size("hard") > 0, "BLOCK").when((F.size("mandatory") > 0) | (F.col("score") >= 40), "QUARANTINE").when(F.col("score") >= 20, "REVIEW").otherwise("ALLOW")
    closed = F.col("unknown")
    failed = F.array(F.lit("POLICY_EVALUATION_FAILURE"))
    return rows.select(
        "scan_id",
        F.when(closed, 0).otherwise(F.col("score")).alias("score"),
        F.when(closed, "LOW").otherwise(risk_band(F.col("score"))).alias("band"),
        F.when(closed, "QUARANTINE").otherwise(decision).alias("decision"),
        (~closed & (decision == "ALLOW")).alias("release_eligible"),
        (~closed & (F.size("incomplete") == 0)).alias("complete"),
        F.when(closed, none()).otherwise(F.col("hard")).alias("hard_block_reasons"),
        F.when(closed, failed).otherwise(F.col("mandatory")).alias("mandatory_reasons"),
        F.when(closed, none()).otherwise(F.col("compounds")).alias("compounds"),
        F.when(closed, failed).otherwise(F.array_sort(F.array_union(F.array_union("codes", "compounds"), "incomplete"))).alias("reasons"),
        F.when(closed, none()).otherwise(F.array_sort(F.array_union("code_contributions", "compound_contributions"))).alias("contributions"),
    )


def catalog_update(evaluations: DataFrame, results: DataFrame) -> DataFrame:
    """What an analysis sets in the catalog: scan_id, state, worker_status, detected_type, error_code, score, band, decision, release_eligible.

    Results are (scan_id, status, detected_type, failure); a null status is that of a run without a result. A scan is completed
    if its worker succeeded and it is neither quarantined nor blocked, so one to be reviewed is; its error is that of the run, else
    of the worker's status, else of an evaluation that failed.
    """
    status, done = F.col("status"), F.col("status") == "SUCCESS"
    broken = F.array_contains("mandatory_reasons", "POLICY_EVALUATION_FAILURE")
    contained = F.col("decision").isin("QUARANTINE", "BLOCK")
    error = F.when(broken, "policy_evaluation_failed").when(status.isNull(), F.coalesce("failure", F.lit("unknown"))).when(~done, F.coalesce("failure", F.lower(status)))
    return evaluations.join(results, "scan_id").select(
        "scan_id", F.when(F.coalesce(done, F.lit(False)) & ~contained, "COMPLETED").otherwise("QUARANTINED").alias("state"), F.coalesce(status, F.lit("FAILED")).alias("worker_status"), F.when(status.isNotNull(), F.col("detected_type")).alias("detected_type"),
        error.alias("error_code"), "score", "band", "decision", "release_eligible",
    )


def weigh_findings(findings: DataFrame, policy: DataFrame) -> DataFrame:
    """Each finding row with its code's points; repeated codes repeat them, unlike a scan's score."""
    return findings.join(F.broadcast(policy.select("code", F.col("points").alias("score_delta"), "severity")), "code", "left")


#: Why an analysis isn't complete, in words.
EXPLANATIONS = {
    "POLICY_ANALYSIS_CONTRADICTION": "The status is a success, but a finding tells of an incomplete analysis.",
    "POLICY_ANALYSIS_FAILURE": "The run of the analysis failed.",
    "POLICY_ANALYSIS_RESULT_MISSING": "There is no valid result.",
    "POLICY_ANALYSIS_STATUS_FAILED": "The worker failed.",
    "POLICY_ANALYSIS_STATUS_TIMEOUT": "The worker took too long.",
    "POLICY_ANALYSIS_STATUS_UNSUPPORTED": "The content is of no supported kind.",
    "POLICY_EVALUATION_FAILURE": "The policy could not be applied; nothing may be released.",
    "POLICY_LIFECYCLE_INCONSISTENCY": "The scan is in a state that isn't evaluated.",
    "POLICY_UNSUPPORTED_DETECTED_TYPE": "Content of this type isn't released.",
}


def with_explanations(evaluations: DataFrame, policy: DataFrame, compounds: DataFrame) -> DataFrame:
    """Evaluations with decision_reasons: (code, explanation) of each reason, by code. The tables are of fixed size."""
    words = {r["code"]: r["explanation"] for r in policy.select("code", "explanation").collect()} | {r["name"]: compound_explanation(r["name"]) for r in compounds.select("name").collect()} | EXPLANATIONS
    known = F.create_map(*[F.lit(x) for pair in sorted(words.items()) for x in pair])
    return evaluations.withColumn("decision_reasons", F.transform("reasons", lambda c: F.struct(c.alias("code"), F.coalesce(F.element_at(known, c), F.lit("")).alias("explanation"))))


def compound_explanation(name: str) -> str:
    return name.removeprefix("POLICY_COMPOUND_").replace("_", " ").lower() + " were found together"


def as_json(explained: DataFrame, version: str, fingerprint: str, evaluated_at: Column | None = None) -> Column:
    """An evaluation's canonical text: the same evaluation gives the same text, but for the time that it may carry."""
    contributions = F.transform("contributions", lambda c: F.struct(F.substring_index(c, "=", 1).alias("code"), F.substring_index(c, "=", -1).cast("int").alias("points")))
    fields = [
        F.col("complete").alias("analysis_complete"), F.col("compounds").alias("compound_rules_triggered"), contributions.alias("contributions"), "decision", "decision_reasons", "hard_block_reasons", F.col("mandatory_reasons").alias("mandatory_quarantine_reasons"),
        F.lit(fingerprint).alias("policy_fingerprint"), F.lit(version).alias("policy_version"), "release_eligible", F.col("band").alias("risk_band"), F.col("score").alias("risk_score"),
    ]
    if evaluated_at is not None:
        fields.append(evaluated_at.alias("evaluated_at"))
    return canonical(F.to_json(F.struct(*fields)))


def identity_agrees(stored: str) -> Column:
    """Whether the six persisted columns of a scan are those of its stored evaluation (JSON); not without a readable one."""
    e = F.from_json(stored, "policy_version string, policy_fingerprint string, risk_score int, risk_band string, decision string, release_eligible boolean")
    pairs = {"policy_version": "policy_version", "policy_fingerprint": "policy_fingerprint", "score": "risk_score", "band": "risk_band", "decision": "decision", "release_eligible": "release_eligible"}
    same = F.json_object_keys(stored).isNotNull()
    for own, inside in pairs.items():
        same = same & (F.col(own) == e[inside])
    return F.coalesce(same, F.lit(False))
