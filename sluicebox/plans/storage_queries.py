"""Registered queries on the catalog as a table and on the store: updates, reconciliation, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts, policy, reconcile
from ..sources import catalog_table, sinks
from .queries import _POLICY_SQL, evaluated, joined, query
from .views import view

_NOW, _STALE_AFTER = 60_000, 900


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    artifacts = view(spark, sf_dir, "v_cleaned").withColumn("storage_key", F.concat(F.lit("a"), F.col("artifact_id")))
    return view(spark, sf_dir, "v_catalog"), artifacts, view(spark, sf_dir, "v_store")


_HELD_SQL = """WITH q AS (SELECT c.scan_id, coalesce(s.kind = 'file' AND s.links = 1 AND s.mode = 256 AND s.size_bytes = c.size_bytes AND s.sha = c.sha, false) AS whole FROM v_catalog c LEFT JOIN (SELECT * FROM v_store WHERE area = 'quarantine') s ON s.name = c.storage_key),
    a AS (SELECT c.artifact_id, coalesce(s.kind = 'file' AND s.links = 1 AND s.mode = 256 AND s.size_bytes = c.size_bytes AND s.sha = c.sha, false) AS whole FROM v_cleaned c LEFT JOIN (SELECT * FROM v_store WHERE area = 'sanitized') s ON s.name = concat('a', c.artifact_id)) """
_ISSUES_SQL = _HELD_SQL + f""", issues AS (SELECT 'STALE_ANALYZING_SCAN' AS code, scan_id::VARCHAR AS subject FROM v_catalog WHERE state = 'ANALYZING' AND updated_at <= {_NOW - _STALE_AFTER} UNION ALL SELECT 'SCAN_OBJECT_MISSING_OR_INVALID', scan_id::VARCHAR FROM q WHERE NOT whole
    UNION ALL SELECT 'DERIVED_PARENT_LINEAGE_BROKEN', scan_id::VARCHAR FROM v_catalog c WHERE parent_scan_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_catalog p WHERE p.scan_id = c.parent_scan_id) UNION ALL SELECT 'ARTIFACT_INTEGRITY_FAILURE', artifact_id::VARCHAR FROM a WHERE NOT whole
    UNION ALL SELECT 'QUARANTINE_ORPHAN', name FROM v_store WHERE area = 'quarantine' AND NOT starts_with(name, '.') AND name NOT IN (SELECT storage_key FROM v_catalog) UNION ALL SELECT 'SANITIZED_ORPHAN', name FROM v_store WHERE area = 'sanitized' AND NOT starts_with(name, '.') AND name NOT IN (SELECT concat('a', artifact_id) FROM v_cleaned)
    UNION ALL SELECT 'STALE_TEMP_OBJECT', name FROM v_store WHERE area IN ('incoming', 'work') AND (regexp_full_match(name, '[.][0-9a-f]{{32}}[.][0-9a-f]{{16}}[.]part') OR regexp_full_match(name, '[.]cdr-[0-9a-f]{{32}}[.]part')) AND kind = 'file' AND links = 1 AND mode IN (256, 384) AND modified_at <= {_NOW - _STALE_AFTER}) """


@query(_ISSUES_SQL + "SELECT * FROM issues")
def r01_06_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.issues(*_tables(spark, sf_dir), _NOW, _STALE_AFTER)


@query(_ISSUES_SQL + """, n AS (SELECT code, count(*) AS n FROM issues GROUP BY code), f AS (SELECT area, count(*) AS n FROM v_store WHERE area IN ('quarantine', 'sanitized') AND NOT starts_with(name, '.') GROUP BY area)
    SELECT (SELECT count(*) FROM v_catalog) AS inspected_scans, (SELECT count(*) FROM v_cleaned) AS inspected_artifacts, CAST((SELECT sum(n) FROM f) AS BIGINT) AS inspected_files, (SELECT max(n) FROM f) > 1000 AS truncated, (SELECT string_agg(code || '=' || n, ',' ORDER BY code || '=' || n) FROM n) AS issues, (SELECT count(*) FROM n) = 0 AS passed""")
def r07_issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _tables(spark, sf_dir)
    return reconcile.report(reconcile.issues(*tables, _NOW, _STALE_AFTER), *tables, 1000).withColumn("issues", joined("issues"))


@query(_HELD_SQL + "SELECT 'scan' AS kind, scan_id AS id, whole FROM q UNION ALL SELECT 'artifact', artifact_id, whole FROM a")
def r10_storage_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans, artifacts, listing = _tables(spark, sf_dir)
    own = reconcile.held(scans, listing, reconcile.QUARANTINE).select(F.lit("scan").alias("kind"), F.col("scan_id").alias("id"), "whole")
    return own.unionAll(reconcile.held(artifacts, listing, reconcile.SANITIZED).select(F.lit("artifact"), "artifact_id", "whole"))


@query(f"""SELECT *, CASE WHEN hit THEN 1 ELSE 0 END AS audited, 0 AS changed_again FROM (SELECT scan_id, CASE WHEN hit THEN 'QUARANTINED' ELSE state END AS state, CASE WHEN hit THEN 'FAILED' ELSE worker_status END AS worker_status, CASE WHEN hit THEN 'recovery_stale_analysis' END AS error_code, CASE WHEN hit THEN 'QUARANTINE' ELSE decision END AS decision, hit
    FROM (SELECT *, state = 'ANALYZING' AND updated_at <= {_NOW - _STALE_AFTER} AS hit FROM v_catalog))""")
def r09_quarantine_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog table after stale scans are quarantined, each with its audit row; a second run changes none."""
    path, log = sinks.shared_path(spark, "catalog"), sinks.shared_path(spark, "audit")
    scans = view(spark, sf_dir, "v_catalog")
    catalog_table.create(scans, path)
    changed = [catalog_table.update(spark, path, reconcile.quarantine(scans, _NOW, _STALE_AFTER), reconcile.stale(_NOW, _STALE_AFTER), log, reconcile.quarantine_audit(_NOW)) for _ in range(2)]
    columns = ("scan_id", "state", "worker_status", "error_code", "decision")
    rows = catalog_table.read(spark, path).select(*columns)
    audited = spark.read.schema("scan_id long, event_type string").parquet(log).groupBy("scan_id").agg(F.count(F.lit(1)).cast("int").alias("audited")) if changed[0] else scans.limit(0).select("scan_id", F.lit(0).alias("audited"))
    return rows.join(audited, "scan_id", "left").withColumns({"hit": F.col("audited").isNotNull(), "audited": F.coalesce("audited", F.lit(0)), "changed_again": F.lit(changed[1])})


_FAILED = "scan_id % 59 = 0"


@query(_POLICY_SQL + """, r AS (SELECT e.*, v.status, v.detected_type, CASE WHEN v.scan_id % 59 = 0 THEN 'isolation_unavailable' WHEN status IS NULL THEN 'timeout' WHEN status = 'UNSUPPORTED' THEN 'unsupported' WHEN status = 'FAILED' THEN 'worker_failed' END AS failure FROM evaluation e JOIN v_scan v USING (scan_id))
    SELECT scan_id, CASE WHEN coalesce(status = 'SUCCESS', false) AND decision NOT IN ('QUARANTINE', 'BLOCK') THEN 'COMPLETED' ELSE 'QUARANTINED' END AS state, coalesce(status, 'FAILED') AS worker_status, CASE WHEN status IS NOT NULL THEN detected_type END AS detected_type, score, band, decision, release_eligible, true AS audited,
           CASE WHEN mandatory_reasons = 'POLICY_EVALUATION_FAILURE' THEN 'policy_evaluation_failed' WHEN status IS NULL THEN coalesce(failure, 'unknown') WHEN status <> 'SUCCESS' THEN coalesce(failure, lower(status)) END AS error_code FROM r""")
def d13_catalog_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog table after the results of all analyses are written to it, and whether each row has its audit row."""
    scans = view(spark, sf_dir, "v_scan")
    failure = F.when(F.expr(_FAILED), "isolation_unavailable").when(F.col("status").isNull(), "timeout").when(F.col("status") == "UNSUPPORTED", "unsupported").when(F.col("status") == "FAILED", "worker_failed")
    changes = policy.catalog_update(evaluated(spark, sf_dir), scans.select("scan_id", "status", "detected_type", failure.alias("failure")))
    path, log = sinks.shared_path(spark, "catalog"), sinks.shared_path(spark, "audit")
    empty = {"worker_status": "string", "detected_type": "string", "error_code": "string", "score": "int", "band": "string", "decision": "string", "release_eligible": "boolean"}
    catalog_table.create(scans.select("scan_id", F.lit("ANALYZING").alias("state"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()]), path)
    catalog_table.update(spark, path, changes, F.col("state") == "ANALYZING", log, [F.col("scan_id"), F.lit("SCAN_ANALYZED").alias("event_type"), F.col("_new_decision").alias("decision")])
    audited = spark.read.schema("scan_id long").parquet(log).select("scan_id", F.lit(True).alias("audited"))
    rows = catalog_table.read(spark, path).drop("part").join(audited, "scan_id", "left")
    return rows.withColumn("audited", F.coalesce("audited", F.lit(False)))


@query("SELECT 'scan' AS kind, storage_key AS subject FROM v_catalog GROUP BY storage_key HAVING count(*) > 1 UNION ALL SELECT 'artifact', artifact_id::VARCHAR FROM v_cleaned WHERE derived_scan_id NOT IN (SELECT scan_id FROM v_catalog) UNION ALL SELECT 'parent', scan_id::VARCHAR FROM v_catalog c WHERE parent_scan_id IS NOT NULL AND parent_scan_id NOT IN (SELECT scan_id FROM v_catalog)")
def c16_catalog_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans, artifacts, _ = _tables(spark, sf_dir)
    row = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("subject"))
    return row(contracts.repeated(scans, "storage_key"), "scan", "storage_key").unionAll(row(contracts.unresolved(artifacts, "derived_scan_id", scans, "scan_id"), "artifact", "artifact_id")).unionAll(row(contracts.unresolved(scans, "parent_scan_id", scans, "scan_id"), "parent", "scan_id"))
