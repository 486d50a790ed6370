"""Registered queries on what leaves: result files, report tables, run comparison, case checks, evidence reports, link summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import contracts, evaluate, reconcile
from ..sources import sinks
from ..sources.tables import saved
from . import dims
from .more_queries import _SCANS_SQL, _scans
from .queries import _MATCH_SQL, _POLICY_SQL, _RATE, _matched, evaluated, joined, query
from .views import view

# Result files ------------------------------------------------------------------------------------

_LINES = ("acceptable_decisions", "missing_expected_findings", "unexpected_findings")
_RESULT_SQL = _MATCH_SQL + """, res AS (SELECT case_id, category, case_class, decision AS actual_decision, list_sort(decisions) AS acceptable_decisions, compliant AS decision_compliant, release_eligible, complete AS analysis_complete, cls AS completeness_class, worker_status, len(missing) = 0 AS findings_recall_pass, missing AS missing_expected_findings, unexpected AS unexpected_findings,
    latency_ms, CASE WHEN worker_status = 'TIMEOUT' THEN 'timeout' END AS error FROM m) """


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.result_rows(_matched(spark, sf_dir).withColumn("error", F.when(F.col("worker_status") == "TIMEOUT", "timeout")))


@query(_RESULT_SQL + "SELECT case_id, category, case_class, coalesce(actual_decision, '') AS actual_decision, " + ", ".join(f"array_to_string({c}, '|') AS {c}" for c in _LINES) + ", " + ", ".join(f"coalesce({c}::VARCHAR, '') AS {c}" for c in ("decision_compliant", "release_eligible", "analysis_complete", "completeness_class", "worker_status", "findings_recall_pass", "error")) + ", latency_ms::VARCHAR AS latency_ms FROM res")
def s07_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen columns as a CSV file, read back as text."""
    path = sinks.shared_path(spark, "csv")
    rows = _results(spark, sf_dir)
    sinks.write_csv(rows, path)
    back = spark.read.option("header", True).option("nullValue", "\\u0000").csv(path)
    return back.select(F.col("case_id").cast("long").alias("case_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns if c != "case_id"])


@query(_RESULT_SQL + """, n AS (SELECT count(*) AS results FROM res) SELECT case_id, category, actual_decision, array_to_string(missing_expected_findings, ',') AS missing, completeness_class, '1.0.2' AS policy_version, results FROM res, n""")
def s06_result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in order of their ids as JSON lines, with the run's metadata beside them."""
    path = sinks.shared_path(spark, "results")
    rows = saved(_results(spark, sf_dir))
    sinks.write_results(rows, path, policy_version="1.0.2", corpus="v_case")
    run = spark.read.schema("policy_version string, corpus string, results long").json(f"{path}/metadata").withColumn("at", F.lit(1))
    back = spark.read.schema(rows.schema).json(f"{path}/results").withColumn("at", F.lit(1))
    return back.join(F.broadcast(run), "at").select("case_id", "category", "actual_decision", joined("missing_expected_findings").alias("missing"), "completeness_class", "policy_version", "results")


_PAIRS = (("risky_recall", "category = 'RISKY' AND len(expected) > 0 AND len(missing) = 0", "category = 'RISKY' AND len(expected) > 0"), ("benign_allow", "category = 'BENIGN' AND decision = 'ALLOW'", "category = 'BENIGN'"), ("compliance", "compliant", "true"))
_METRICS_SQL = _MATCH_SQL + ", met AS (SELECT " + ", ".join(_RATE(*x) for x in _PAIRS) + " FROM m) "


@query(_METRICS_SQL + ", lat AS (SELECT count(latency_ms) AS n, max(latency_ms) AS high FROM v_result) SELECT risky_recall_n, risky_recall_d, risky_recall, benign_allow, compliance, n AS timed, high AS slowest, 'v_result' AS source FROM met, lat")
def s08_metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics, latency and what is said about the run as one JSON document, read back in part."""
    json = sinks.metrics_document(evaluate.metrics(_matched(spark, sf_dir)), evaluate.latency(view(spark, sf_dir, "v_result")), source="v_result")
    of = lambda key, kind: F.get_json_object("json", f"$.{key}").cast(kind)
    fields = [of(f"metrics.{c}", k).alias(c) for c, k in (("risky_recall_n", "long"), ("risky_recall_d", "long"), ("risky_recall", "double"), ("benign_allow", "double"), ("compliance", "double"))]
    return json.select(*fields, of("metrics.latency.n", "long").alias("timed"), of("metrics.latency.high", "long").alias("slowest"), of("metadata.source", "string").alias("source"))


_CLASS_SQL = """CASE WHEN complete IS NULL THEN 'UNKNOWN' WHEN complete THEN 'COMPLETE' WHEN worker_status = 'TIMEOUT' THEN 'TIMEOUT' WHEN len(list_filter(codes, x -> ends_with(x, '_MALFORMED'))) > 0 THEN 'MALFORMED' WHEN len(list_filter(codes, x -> ends_with(x, '_RESOURCE_LIMIT'))) > 0 THEN 'RESOURCE_LIMIT'
      WHEN len(list_filter(codes, x -> regexp_matches(x, '(_ENCRYPTED|_PARTIAL_ANALYSIS|_NESTING_LIMIT)$'))) > 0 THEN 'PARTIAL' ELSE 'OTHER_FAIL_CLOSED' END"""
_COUNTS_SQL = f"classes AS (SELECT {_CLASS_SQL} AS bucket, count(*) AS n FROM (SELECT *, string_split(actual, ',') AS codes FROM v_result) GROUP BY 1) "


@query("WITH " + _COUNTS_SQL + "SELECT * FROM classes")
def e10_completeness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results, with a case or without, by why they aren't complete."""
    return evaluate.completeness_counts(view(spark, sf_dir, "v_result"))


_TEXT = lambda n, d: f"CASE WHEN {d} > 0 THEN printf('%.1f%% (%d/%d)', 100.0 * {n} / {d}, {n}, {d}) ELSE 'not applicable' END"


@query(_METRICS_SQL + ", " + _COUNTS_SQL + f""", hits AS (SELECT c.category, CAST(coalesce(sum(len(list_intersect(expected, actual))), 0) AS BIGINT) AS n, CAST(coalesce(sum(len(expected)), 0) AS BIGINT) AS d FROM (SELECT DISTINCT category FROM v_case) c LEFT JOIN m USING (category) GROUP BY c.category)
    SELECT 'categories' AS "table", category AS line, count(*)::VARCHAR AS value FROM v_case GROUP BY category UNION ALL SELECT 'recall', category, {_TEXT('n', 'd')} FROM hits UNION ALL SELECT 'completeness', bucket, n::VARCHAR FROM classes
    UNION ALL SELECT 'latency', 'count', count(latency_ms)::VARCHAR FROM v_result UNION ALL SELECT 'latency', 'low', min(latency_ms)::VARCHAR FROM v_result UNION ALL SELECT 'latency', 'high', max(latency_ms)::VARCHAR FROM v_result UNION ALL SELECT 'latency', 'p95', quantile_disc(latency_ms, 0.95)::VARCHAR FROM v_result UNION ALL SELECT 'latency', 'mean', printf('%.1f', avg(latency_ms)) FROM v_result
    UNION ALL SELECT 'metrics', 'risky_recall', {_TEXT('risky_recall_n', 'risky_recall_d')} FROM met UNION ALL SELECT 'metrics', 'benign_allow', {_TEXT('benign_allow_n', 'benign_allow_d')} FROM met UNION ALL SELECT 'metrics', 'compliance', {_TEXT('compliance_n', 'compliance_d')} FROM met""")
def s09_report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the report, line by line."""
    return sinks.report_lines(view(spark, sf_dir, "v_case"), _matched(spark, sf_dir), view(spark, sf_dir, "v_result"), ("risky_recall", "benign_allow", "compliance"))


@query(_MATCH_SQL + """, a AS (SELECT count(*) AS cases, count(*) FILTER (decision = 'ALLOW') AS allowed, count(*) FILTER (worker_status = 'TIMEOUT') AS timeouts, round(avg(latency_ms), 6) AS mean, count(*) FILTER (compliant) AS compliant FROM m),
    b AS (SELECT count(*) AS cases, count(*) FILTER (r.decision = 'ALLOW') AS allowed, count(*) FILTER (worker_status = 'TIMEOUT') AS timeouts, round(avg(latency_ms), 6) AS mean, count(*) FILTER (list_contains(string_split(c.decisions, ','), r.decision)) AS compliant FROM v_case c JOIN v_rerun r USING (case_id)),
    s AS (SELECT 'cases' AS metric, a.cases::DOUBLE AS before, b.cases::DOUBLE AS after FROM a, b UNION ALL SELECT 'allowed', a.allowed, b.allowed FROM a, b UNION ALL SELECT 'timeouts', a.timeouts, b.timeouts FROM a, b UNION ALL SELECT 'mean_latency', a.mean, b.mean FROM a, b UNION ALL SELECT 'compliant', a.compliant, b.compliant FROM a, b) SELECT *, round(after - before, 6) AS change FROM s""")
def e21_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' metrics side by side."""
    cases = view(spark, sf_dir, "v_case")
    before = _matched(spark, sf_dir).select("decision", "worker_status", "latency_ms", "compliant")
    after = cases.join(view(spark, sf_dir, "v_rerun"), "case_id").select("decision", "worker_status", "latency_ms", F.array_contains(F.split("decisions", ","), F.col("decision")).alias("compliant"))
    return evaluate.side_by_side(before, after)


# Cases -------------------------------------------------------------------------------------------


@query("""SELECT case_id, concat_ws(' ', case_id, category, case_class, CASE WHEN expected = '' THEN '-' ELSE replace(expected, ',', '|') END, replace(decisions, ',', '|'), CASE WHEN fail_secure THEN 'F' END, CASE WHEN case_id % 6 = 1 THEN 'C' END) AS line FROM v_case""")
def e15_case_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = view(spark, sf_dir, "v_case").withColumn("follow_up", F.col("case_id") % 6 == 1)
    return evaluate.case_lines(cases).select("case_id", "line")


@query(f"""WITH dim(code, severity, family, points, floor, hard_block, techniques, explanation) AS ({dims.sql_values(dims.finding_rows())}), c AS (SELECT case_id, case_id % 11 AS k, string_split(expected, ',') AS e0, any_additional, fail_secure, decisions, acceptable FROM v_case),
    e AS (SELECT *, list_filter(CASE WHEN k = 1 THEN ['NO_SUCH_CODE'] WHEN k = 2 THEN ['PDF_XFA', 'PDF_ACROFORM'] ELSE e0 END, x -> x <> '') AS expected2, CASE WHEN k = 3 THEN e0 ELSE list_filter(string_split(acceptable, ','), x -> x <> '') END AS acceptable2, CASE WHEN k = 4 THEN ['ALLOW', 'ALLOW'] ELSE string_split(decisions, ',') END AS decisions2, fail_secure AND k = 5 AS complete2, k = 6 AS derived2, k IN (6, 7) AS follow2 FROM c),
    f AS (SELECT *, list_filter(acceptable2, x -> x <> '') AS acc FROM e), h AS (SELECT list(code) FILTER (hard_block) AS hard, list(code) AS known FROM dim)
    SELECT case_id, array_to_string(list_sort(list_filter([CASE WHEN len(list_filter(list_concat(expected2, acc), x -> NOT list_contains(known, x))) > 0 THEN 'unknown_code' END, CASE WHEN list_has_any(expected2, acc) THEN 'overlap' END, CASE WHEN any_additional AND len(acc) > 0 THEN 'any_excludes_list' END, CASE WHEN fail_secure AND list_contains(decisions2, 'ALLOW') THEN 'fail_secure_allow' END, CASE WHEN complete2 THEN 'fail_secure_complete' END,
      CASE WHEN derived2 AND NOT follow2 THEN 'follow_up' END, CASE WHEN expected2 <> list_sort(list_distinct(expected2)) OR acc <> list_sort(list_distinct(acc)) OR decisions2 <> list_distinct(decisions2) AND k = 4 THEN 'order' END, CASE WHEN list_has_any(expected2, hard) AND decisions2 <> ['BLOCK'] THEN 'hard_block_decision' END], x -> x IS NOT NULL)), ',') AS violations FROM f, h""")
def e18_19_case_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases as they are, and some with an unknown code, codes out of order, one list in the other, a decision twice, or complete though they must fail."""
    k = F.col("case_id") % 11
    text = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    rows = view(spark, sf_dir, "v_case").withColumns({
        "expected": F.when(k == 1, F.array(F.lit("NO_SUCH_CODE"))).when(k == 2, F.array(F.lit("PDF_XFA"), F.lit("PDF_ACROFORM"))).otherwise(text("expected")), "acceptable": F.when(k == 3, text("expected")).otherwise(text("acceptable")),
        "decisions": F.when(k == 4, F.array(F.lit("ALLOW"), F.lit("ALLOW"))).otherwise(text("decisions")), "complete": F.col("fail_secure") & (k == 5), "derived_expected": k == 6, "follow_up": k.isin(6, 7),
    })
    return rows.select("case_id", joined(contracts.violations(evaluate.case_rules(dims.finding_dim(spark)))).alias("violations"))


# Catalog -----------------------------------------------------------------------------------------


@query(_SCANS_SQL + """, f AS (SELECT scan_id, string_agg(code, ',' ORDER BY code) AS codes FROM (SELECT DISTINCT scan_id, code FROM v_finding) GROUP BY scan_id) SELECT s.scan_id, s.decision, coalesce(f.codes, '') AS findings, coalesce(e.contributions, '') AS contributions, coalesce(e.reasons, 'POLICY_EVALUATION_MISSING') AS reasons, a.artifact_id, d.decision AS derived_decision, l.parent_id, p.decision AS parent_decision
    FROM scans s JOIN v_lineage l USING (scan_id) LEFT JOIN f USING (scan_id) LEFT JOIN evaluation e ON e.scan_id = s.scan_id AND s.status IS NOT NULL LEFT JOIN v_artifact a ON a.scan_id = s.scan_id LEFT JOIN scans d ON d.scan_id = a.derived_scan_id LEFT JOIN scans p ON p.scan_id = l.parent_id""")
def q11_evidence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan with its findings, what they contributed, its reasons, its cleaned copy and its parent. The policy is evaluated once."""
    evaluation = evaluated(spark, sf_dir).select("scan_id", "decision", joined("contributions").alias("contributions"), joined("reasons").alias("reasons"))
    scans = view(spark, sf_dir, "v_scan").select("scan_id", "status")
    scans = saved(scans.join(evaluation, "scan_id", "left").select("scan_id", *[F.when(F.col("status").isNotNull(), F.col(c)).alias(c) for c in ("decision", "contributions", "reasons")]))
    found = view(spark, sf_dir, "v_finding").groupBy("scan_id").agg(joined(F.array_sort(F.collect_set("code"))).alias("findings"))
    other = lambda key, name: scans.select(F.col("scan_id").alias(key), F.col("decision").alias(name))
    artifacts = view(spark, sf_dir, "v_artifact").select("scan_id", "artifact_id", "derived_scan_id")
    rows = scans.join(view(spark, sf_dir, "v_lineage").select("scan_id", "parent_id"), "scan_id").join(artifacts, "scan_id", "left").join(found, "scan_id", "left")
    rows = rows.join(other("derived_scan_id", "derived_decision"), "derived_scan_id", "left").join(other("parent_id", "parent_decision"), "parent_id", "left")
    blank = lambda c, text="": F.coalesce(c, F.lit(text)).alias(c)
    return rows.select("scan_id", "decision", blank("findings"), blank("contributions"), blank("reasons", "POLICY_EVALUATION_MISSING"), "artifact_id", "derived_decision", "parent_id", "parent_decision")


@query("""WITH s AS (SELECT * FROM v_store WHERE area = 'sanitized'), a AS (SELECT c.scan_id, c.policy_fingerprint AS fingerprint, c.artifact_id, coalesce(s.kind = 'file' AND s.links = 1 AND s.mode = 256 AND s.size_bytes = c.size_bytes AND s.sha = c.sha, false) AS whole FROM v_cleaned c LEFT JOIN s ON s.name = concat('a', c.artifact_id))
    SELECT scan_id, fingerprint, min(artifact_id) FILTER (whole) AS reusable, count(*) AS n FROM a GROUP BY scan_id, fingerprint""")
def l04_reusable_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The artifact of a source and sanitizer that may be handed out again: its bytes are as recorded."""
    artifacts = view(spark, sf_dir, "v_cleaned").withColumns({"storage_key": F.concat(F.lit("a"), F.col("artifact_id")), "fingerprint": F.col("policy_fingerprint")})
    held = reconcile.held(artifacts, view(spark, sf_dir, "v_store"), reconcile.SANITIZED)
    return held.groupBy("scan_id", "fingerprint").agg(F.min(F.when(F.col("whole"), F.col("artifact_id"))).alias("reusable"), F.count(F.lit(1)).alias("n"))


@query(_SCANS_SQL + "SELECT s.scan_id, s.decision AS before, b.decision AS after, b.case_id IS NULL AS lost FROM scans s LEFT JOIN v_rerun b ON b.case_id = s.scan_id WHERE b.case_id IS NULL OR s.decision IS DISTINCT FROM b.decision")
def l06_source_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose decision by the policy isn't the same after the follow-up run, or that can't be read back: all scans against the later snapshot."""
    before = _scans(spark, sf_dir).select("scan_id", F.col("decision").alias("before"))
    after = view(spark, sf_dir, "v_rerun").select(F.col("case_id").alias("scan_id"), F.col("decision").alias("after"), F.lit(True).alias("there"))
    lost = F.col("there").isNull()
    return before.join(after, "scan_id", "left").where(lost | ~F.col("before").eqNullSafe(F.col("after"))).select("scan_id", "before", "after", lost.alias("lost"))


@query(_SCANS_SQL + "SELECT scan_id, created_at, (SELECT count(*) FROM scans WHERE decision = 'QUARANTINE' AND state = 'COMPLETED') AS total FROM scans WHERE decision = 'QUARANTINE' AND state = 'COMPLETED' ORDER BY created_at DESC, scan_id DESC LIMIT 20 OFFSET 20")
def q01_scan_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page and the number of all that it is a page of; the policy is evaluated once."""
    from ..operators import catalog

    found = saved(catalog.listing(_scans(spark, sf_dir), decision="QUARANTINE", state="COMPLETED").select("scan_id", "created_at"))
    return catalog.page(found, [F.desc("created_at"), F.desc("scan_id")], 2, 20).withColumn("total", F.lit(found.count()).cast("long"))


# Names and links ---------------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT doc_id, action_id, rel_type, CASE WHEN doc_id % 5 = 0 THEN concat(target, repeat('x', 2100)) ELSE target END AS target FROM (SELECT *, concat('http://x/', subtype) AS rel_type FROM v_action)), c AS (SELECT *, substr(target, 1, 256) AS short FROM t)
    SELECT doc_id, action_id, CASE WHEN starts_with(target, '\\') THEN 'unc' WHEN starts_with(target, 'HTTP') THEN 'http' END AS scheme, CASE WHEN starts_with(target, '\\') THEN substr(CASE WHEN length(target) > 1000 THEN 'srv' ELSE 'srv' END, 1, 128) WHEN starts_with(target, 'HTTP') THEN lower(regexp_extract(short, '//([^:/]+)', 1)) END AS hostname,
           CASE WHEN starts_with(target, '\\') OR starts_with(target, 'HTTP') THEN 'parsed' ELSE 'invalid' END AS parse_status, subtype_last AS relationship, length(target) AS target_length, length(target) > 2048 AS truncated FROM (SELECT *, list_extract(string_split(rel_type, '/'), -1) AS subtype_last FROM c)""")
def n13_14_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_action").withColumns({"rel_type": F.concat(F.lit("http://x/"), F.col("subtype")), "target": F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("target"), F.repeat(F.lit("x"), F.lit(2100)))).otherwise(F.col("target"))})
    return rows.select("doc_id", "action_id", names.link_summary(F.col("target"), F.col("rel_type")).alias("s")).select("doc_id", "action_id", "s.*")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN substr(SHA(text), 1, 32) WHEN doc_id % 4 = 1 THEN upper(substr(SHA(text), 1, 32)) WHEN doc_id % 4 = 2 THEN substr(SHA(text), 1, 31) END AS storage_key, doc_id % 4 = 0 OR doc_id % 4 = 1 AND NOT regexp_matches(substr(SHA(text), 1, 32), '[a-f]') AS ok FROM documents""")
def n15_storage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, sha = F.col("doc_id") % 4, F.substring(F.sha2("text", 256), 1, 32)
    key = F.when(k == 0, sha).when(k == 1, F.upper(sha)).when(k == 2, F.substring(sha, 1, 31))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", key.alias("storage_key"), names.storage_key_ok(key).alias("ok"))


@query("""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('a', chr(10), substr(text, 1, 300)) WHEN doc_id % 3 = 1 THEN '' ELSE substr(text, 1, 100) END AS name FROM documents), e AS (SELECT doc_id, regexp_replace(regexp_replace(name, chr(10), '\\u000a', 'g'), chr(9), '\\u0009', 'g') AS e FROM n) SELECT doc_id, CASE WHEN e = '' THEN 'unnamed' ELSE substr(e, 1, 256) END AS name, length(e) > 256 AS truncated FROM e""".replace("'\\u", "'\\\\u"))
def n10_member_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped names, cut, and whether they were."""
    k, text = F.col("doc_id") % 3, F.col("text")
    name = F.when(k == 0, F.concat(F.lit("a\n"), F.substring(text, 1, 300))).when(k == 1, "").otherwise(F.substring(text, 1, 100))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", name.alias("name"))
    return rows.select("doc_id", names.escaped_member(F.col("name")).alias("name"), names.escaped_cut(F.col("name")).alias("truncated"))
