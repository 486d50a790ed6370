"""Registered queries on contracts: registries, JSON of findings, audits and evaluations, domains, attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_text
from ..operators import contracts, policy, rules
from . import dims
from .queries import _POLICY_SQL, _contents, _limits_sql, evaluated, joined, query
from .views import view

_PRINT = "0" * 64


def _cases(*pairs: tuple[str, str]) -> str:
    """SQL of a sorted, joined list of the names whose condition is broken."""
    return "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], x -> x IS NOT NULL)), ',')"


_REGISTRY_SQL = "reg(code, title, description, severity, category, techniques) AS (" + dims.sql_values([(*r[:5], ",".join(r[5])) for r in dims.registry_rows()]) + ")"
_SENT = ("title", "description", "severity", "category", "techniques")


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as a worker sends them; in some, one of the attributes isn't the registry's."""
    k = F.col("scan_id") % 13
    rows = contracts.enriched(view(spark, sf_dir, "v_finding"), dims.registry_dim(spark))
    rows = rows.withColumns({"title": F.when(k == 1, "Other").otherwise(F.col("title")), "description": F.when(k == 2, "").otherwise(F.col("description")), "severity": F.when(k == 3, "NONE").otherwise(F.col("severity")), "category": F.when(k == 4, "x").otherwise(F.col("category"))})
    techniques = F.when(k == 5, F.array(F.lit("T0"))).when(k == 6, F.array(F.repeat(F.lit("T"), F.lit(33)))).otherwise(F.col("techniques"))
    return rows.withColumns({"techniques": techniques, "score_delta": F.when(k == 7, 5).otherwise(0), "code": F.when(k == 8, F.lower("code")).otherwise(F.col("code"))})


@query(f"WITH {_REGISTRY_SQL} SELECT scan_id, f.code, title, severity, category, coalesce(techniques, '') AS techniques, 0 AS score_delta FROM v_finding f LEFT JOIN reg USING (code)")
def c01_enriched_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contracts.enriched(view(spark, sf_dir, "v_finding"), dims.registry_dim(spark))
    return rows.select("scan_id", "code", "title", "severity", "category", F.coalesce(joined("techniques"), F.lit("")).alias("techniques"), "score_delta")


@query(f"""WITH {_REGISTRY_SQL}, s AS (SELECT scan_id, scan_id % 13 AS k, code, severity IS NULL AS unknown FROM v_finding LEFT JOIN reg USING (code))
    SELECT scan_id, CASE WHEN k = 8 THEN lower(code) ELSE code END AS code, """ + _cases(
    ("unknown_code", "unknown OR k = 8"), ("bad_code", "k = 8"), ("technique_length", "k = 6 OR unknown AND k <> 5"), ("scored", "k = 7"), ("title", "unknown OR k IN (1, 8)"), ("description", "unknown OR k IN (2, 8)"), ("severity", "unknown OR k IN (3, 8)"), ("category", "unknown OR k IN (4, 8)"), ("techniques", "unknown OR k IN (5, 6, 8)")
) + " AS violations FROM s")
def c02_finding_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.conformance(_sent(spark, sf_dir), dims.registry_dim(spark)).select("scan_id", "code", joined("violations").alias("violations"))


@query(_limits_sql(32, 16, 4096, 12 << 10) + ", c AS (SELECT scan_id, rule_id, code, len(strings) AS ids, len(offsets) AS places, scan_id % 12 AS k FROM lim WHERE kept) SELECT scan_id, CASE WHEN k = 3 THEN 'nobody' ELSE rule_id END AS rule_id, " + _cases(
    ("keys", "k IN (1, 2)"), ("rule", "k = 3"), ("registry", "k IN (3, 4)"), ("code", "k IN (3, 5)"), ("count", "k IN (2, 6)"), ("strings", "k = 7"), ("offsets", "k = 8 OR k = 9 AND places > 1 OR k = 10"),
) + " AS violations FROM c")
def c03_match_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of rule matches as they are, and with one thing wrong in most: exact keys, the registry's values, ranges, orders."""
    limited = rules.limits(rules.matches(_contents(spark, sf_dir), dims.RULES), dims.rule_definitions(spark), "1", "pack").where("kept")
    k, m = F.col("scan_id") % 12, F.col("metadata")
    swap = lambda old, new: F.regexp_replace(m, F.lit(old), F.lit(new))
    wrong = {
        1: swap("^[{]", '{"extra":1,'), 2: swap('"match_count":[0-9]+,', ""), 3: swap('"rule_id":"[a-z_]+"', '"rule_id":"nobody"'), 4: swap('"scope":"TOP_LEVEL"', '"scope":"MEMBER"'), 6: swap('"match_count":[0-9]+', '"match_count":0'), 7: swap('"string_ids":\\[', '"string_ids":["a",'),
        8: swap('"offsets":\\[', '"offsets":[-1,'), 10: swap('"offsets":\\[[0-9]+', '"offsets":[true'),
    }
    turned = F.concat(F.lit('"offsets":['), F.array_join(F.reverse("offsets").cast("array<string>"), ","), F.lit("]"))
    text = m
    for n, changed in wrong.items():
        text = F.when(k == n, changed).otherwise(text)
    text = F.when(k == 9, F.concat(F.substring_index(m, '"offsets":[', 1), turned, F.regexp_extract(m, '"offsets":\\[[0-9,]*\\](.*)$', 1))).otherwise(text)
    sent = limited.select("scan_id", F.when(k == 5, "OTHER").otherwise(F.col("code")).alias("code"), text.alias("metadata"))
    definitions = dims.rule_definitions(spark).join(F.broadcast(dims.rule_dim(spark).select("rule_id", "code").distinct()), "rule_id")
    return contracts.match_conformance(sent, definitions, "1", "pack").select("scan_id", "rule_id", joined("violations").alias("violations"))


@query("SELECT doc_id AS scan_id, " + _cases(("keys", "doc_id % 8 IN (0, 7)"), ("pack", "doc_id % 8 IN (1, 7)"), ("empty", "doc_id % 8 IN (2, 7)"), ("unknown", "doc_id % 8 IN (3, 7)"), ("order", "doc_id % 8 IN (4, 5, 7)")) + " AS violations FROM documents")
def c04_partial_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("scan_id") % 8
    text = lambda reasons, version="1", more="": f'{{"reasons":{reasons},{more}"rule_pack_sha256":"s","rule_pack_version":"{version}"}}'
    good = '["metadata_limit","offset_limit"]'
    sent = F.when(k == 0, text(good, more='"x":1,')).when(k == 1, text(good, "0")).when(k == 2, text("[]")).when(k == 3, text('["odd"]')).when(k == 4, text('["offset_limit","metadata_limit"]')).when(k == 5, text('["offset_limit","offset_limit"]')).when(k == 7, "none").otherwise(text(good))
    rows = view(spark, sf_dir, "v_scan").select("scan_id", sent.alias("metadata"))
    return contracts.partial_conformance(rows, "1", "s").select("scan_id", joined("violations").alias("violations"))


@query("SELECT doc_id AS scan_id, concat_ws(',', CASE WHEN doc_id % 300 > 256 THEN 'findings' END, CASE WHEN strlen(text) > 8000 THEN 'metadata' END, CASE WHEN doc_id % 7 = 0 THEN 'times' END, CASE WHEN doc_id % 11 = 0 THEN 'version' END) AS violations FROM documents")
def c05_result_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("scan_id")
    rows = view(spark, sf_dir, "v_scan").withColumns({"schema_version": F.when(s % 11 == 0, "0").otherwise("1"), "started_at": s, "completed_at": F.when(s % 7 == 0, s - 1).otherwise(s + 1), "findings": s % 300, "metadata_bytes": F.col("size_bytes")})
    return rows.select("scan_id", joined(contracts.violations(contracts.envelope_rules("1", most_bytes=8000))).alias("violations"))


@query("""SELECT event_id, CASE event_id % 14 WHEN 0 THEN 'depth' WHEN 2 THEN 'list' WHEN 4 THEN 'text' WHEN 7 THEN 'fields' WHEN 8 THEN 'bytes' WHEN 10 THEN 'object' WHEN 11 THEN 'object' WHEN 12 THEN 'object' ELSE '' END AS violations,
    CASE event_id % 14 WHEN 1 THEN '{"a":{"d":{"c":{"b":null}}},"z":1}' WHEN 3 THEN replace(details, ' ', '') WHEN 5 THEN details WHEN 6 THEN '{"a":1,"b":2}' WHEN 9 THEN replace(details, ' ', '') WHEN 13 THEN concat('{"decision":"ALLOW","k":', event_id, ',"role":{"a":[true,null],"b":1}}') END AS details FROM v_details""")
def c06_audit_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_text.bounded(view(spark, sf_dir, "v_details"), "details").select("event_id", joined("violations").alias("violations"), "details")


@query(_POLICY_SQL + ", t AS (SELECT *, scan_id % 7 AS k, decision = 'ALLOW' AS allowed FROM evaluation) SELECT scan_id, " + _cases(
    ("release", "k = 1"), ("hard_block", "CASE WHEN k = 2 THEN decision <> 'BLOCK' ELSE hard_block_reasons <> '' AND decision <> 'BLOCK' END"), ("complete", "allowed AND k = 3"), ("score", "k = 4"), ("sorted", "k = 5"),
) + " AS violations FROM t")
def c07_evaluation_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations as they are, and in some one thing that an evaluation must not show."""
    k = F.col("scan_id") % 7
    rows = evaluated(spark, sf_dir).withColumns({
        "release_eligible": F.when(k == 1, ~F.col("release_eligible")).otherwise(F.col("release_eligible")), "hard_block_reasons": F.when(k == 2, F.array(F.lit("X"))).otherwise(F.col("hard_block_reasons")), "complete": F.when(k == 3, False).otherwise(F.col("complete")),
        "score": F.when(k == 4, 101).otherwise(F.col("score")), "reasons": F.when(k == 5, F.array(F.lit("B"), F.lit("A"))).otherwise(F.col("reasons")),
    })
    return rows.select("scan_id", joined(contracts.violations(contracts.evaluation_rules())).alias("violations"))


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.with_explanations(evaluated(spark, sf_dir), dims.finding_dim(spark), dims.compound_dim(spark))


_WORDS = [(r[0], r[7]) for r in dims.finding_rows()] + [(r[0], policy.compound_explanation(r[0])) for r in dims.compound_rows()] + list(policy.EXPLANATIONS.items())
_TEXT_LIST = lambda c: f"'[' || CASE WHEN {c} = '' THEN '' ELSE '\"' || replace({c}, ',', '\",\"') || '\"' END || ']'"
_JSON_SQL = _POLICY_SQL + f""", words(code, explanation) AS ({dims.sql_values(_WORDS)}), u AS (SELECT scan_id, unnest(list_filter(string_split(reasons, ','), x -> x <> '')) AS code FROM evaluation),
    why AS (SELECT scan_id, string_agg('{{"code":"' || code || '","explanation":"' || coalesce(explanation, '') || '"}}', ',' ORDER BY code) AS j FROM u LEFT JOIN words USING (code) GROUP BY scan_id),
    js AS (SELECT evaluation.*, concat('{{"analysis_complete":', complete, ',"compound_rules_triggered":', {_TEXT_LIST('compounds')}, ',"contributions":[', CASE WHEN contributions = '' THEN '' ELSE regexp_replace(contributions, '([A-Z0-9_]+)=([0-9]+)', '{{"code":"\\1","points":\\2}}', 'g') END,
      '],"decision":"', decision, '","decision_reasons":[', coalesce(j, ''), '],"hard_block_reasons":', {_TEXT_LIST('hard_block_reasons')}, ',"mandatory_quarantine_reasons":', {_TEXT_LIST('mandatory_reasons')}, ',"policy_fingerprint":"{_PRINT}","policy_version":"1.0.2","release_eligible":', release_eligible,
      ',"risk_band":"', band, '","risk_score":', score, '}}') AS stored FROM evaluation LEFT JOIN why USING (scan_id)) """


@query(_JSON_SQL + "SELECT scan_id, coalesce(j, '') AS reasons FROM evaluation LEFT JOIN why USING (scan_id)")
def d10_decision_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.transform("decision_reasons", lambda r: F.to_json(r))
    return _explained(spark, sf_dir).select("scan_id", F.array_join(text, ",").alias("reasons"))


@query(_JSON_SQL + "SELECT scan_id, strlen(stored) AS bytes, sha256(stored) AS fingerprint FROM js")
def d15_evaluation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explained(spark, sf_dir).withColumn("text", policy.as_json(_explained(spark, sf_dir), "1.0.2", _PRINT)).select("scan_id", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("fingerprint"))


@query(_JSON_SQL + "SELECT scan_id, scan_id % 10 IN (0, 9) AS same FROM js")
def c08_persisted_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six persisted columns against the stored evaluation; in some one of the six differs, or there is no readable one."""
    k = F.col("scan_id") % 10
    rows = _explained(spark, sf_dir).withColumns({"stored": policy.as_json(_explained(spark, sf_dir), "1.0.2", _PRINT)})
    rows = rows.withColumns({
        "policy_version": F.when(k == 1, "0").otherwise("1.0.2"), "policy_fingerprint": F.when(k == 2, "x").otherwise(_PRINT), "score": F.when(k == 3, F.col("score") + 1).otherwise(F.col("score")), "band": F.when(k == 4, "NONE").otherwise(F.col("band")),
        "decision": F.when(k == 5, None).otherwise(F.col("decision")), "release_eligible": F.when(k == 6, ~F.col("release_eligible")).otherwise(F.col("release_eligible")), "stored": F.when(k == 7, None).when(k == 8, F.expr("substring(stored, 2)")).otherwise(F.col("stored")),
    })
    return rows.select("scan_id", policy.identity_agrees("stored").alias("same"))


_PACK_SQL = """WITH pol AS (SELECT concat('P', p_partkey) AS code, CASE WHEN p_partkey % 31 = 1 THEN 101 ELSE p_partkey % 101 END AS points, CASE WHEN p_partkey % 5 = 2 THEN 'BLOCK' WHEN p_partkey % 29 = 3 THEN 'ALLOW' END AS floor, p_partkey % 5 = 2 OR p_partkey % 37 = 4 AS hard_block FROM part UNION ALL SELECT concat('P', p_partkey), 1, NULL, false FROM part WHERE p_partkey % 41 = 5),
    codes AS (SELECT concat('P', p_partkey) AS code FROM part WHERE p_partkey % 43 <> 6 UNION ALL SELECT concat('S', s_suppkey) FROM supplier WHERE s_suppkey % 7 = 0),
    comp AS (SELECT concat('C', s_suppkey) AS name, concat('P', s_suppkey) AS a, CASE WHEN s_suppkey % 11 = 3 THEN 'NONE' ELSE 'P1' END AS b, CASE s_suppkey % 6 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'BLOCK' ELSE 'QUARANTINE' END AS floor FROM supplier) """


def _policy_of_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    code = F.concat(F.lit("P"), p)
    own = read("part").select(code.alias("code"), F.when(p % 31 == 1, 101).otherwise(p % 101).cast("long").alias("points"), F.when(p % 5 == 2, "BLOCK").when(p % 29 == 3, "ALLOW").alias("floor"), ((p % 5 == 2) | (p % 37 == 4)).alias("hard_block"))
    again = read("part").where(p % 41 == 5).select(code, F.lit(1).cast("long"), F.lit(None).cast("string"), F.lit(False))
    codes = read("part").where(p % 43 != 6).select(code.alias("code")).unionAll(read("supplier").where(s % 7 == 0).select(F.concat(F.lit("S"), s)))
    compounds = read("supplier").select(F.concat(F.lit("C"), s).alias("name"), F.array(F.concat(F.lit("P"), s), F.when(s % 11 == 3, "NONE").otherwise("P1")).alias("required"), F.when(s % 6 == 0, "ALLOW").when(s % 6 == 1, "BLOCK").otherwise("QUARANTINE").alias("floor"))
    return own.unionAll(again), compounds, codes


@query(_PACK_SQL + """SELECT 'repeated_code' AS rule, code AS subject FROM pol GROUP BY code HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'points', code FROM pol WHERE points NOT BETWEEN 0 AND 100 UNION ALL SELECT DISTINCT 'floor', code FROM pol WHERE floor = 'ALLOW' UNION ALL SELECT DISTINCT 'hard_block', code FROM pol WHERE hard_block <> coalesce(floor = 'BLOCK', false)
    UNION ALL SELECT 'unknown_reference', name FROM comp WHERE a NOT IN (SELECT code FROM pol) OR b NOT IN (SELECT code FROM pol) UNION ALL SELECT 'compound_floor', name FROM comp WHERE floor IN ('ALLOW', 'BLOCK') UNION ALL SELECT 'without_policy', code FROM codes WHERE code NOT IN (SELECT code FROM pol) UNION ALL SELECT DISTINCT 'unregistered', code FROM pol WHERE code NOT IN (SELECT code FROM codes)""")
def c09_registry_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a policy, suppliers as its compounds: every rule is broken by some row."""
    return contracts.registry_faults(*_policy_of_parts(spark, sf_dir))


@query(_PACK_SQL + """, t AS (SELECT substr(md5(code), 1, 2) AS part, concat('{"code":"', code, '","floor":', CASE WHEN floor IS NULL THEN 'null' ELSE '"' || floor || '"' END, ',"hard_block":', hard_block, ',"points":', points, '}') AS j FROM pol),
    d AS (SELECT part, sha256(string_agg(j, ',' ORDER BY j)) AS digest FROM t GROUP BY part) SELECT sha256(string_agg(digest, ',' ORDER BY part)) AS fingerprint FROM d""")
def c10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.fingerprint(_policy_of_parts(spark, sf_dir)[0], "code")


@query("""SELECT scan_id, CASE WHEN scan_id % 59 = 0 THEN 'isolation_unavailable' WHEN scan_id % 13 = 0 THEN 'timeout' WHEN scan_id % 17 = 0 THEN 'output_limit_exceeded' WHEN scan_id % 19 = 0 THEN 'non_zero_exit' WHEN scan_id % 23 = 0 THEN 'malformed_output' WHEN status = 'UNSUPPORTED' THEN 'unsupported' WHEN status IS DISTINCT FROM 'SUCCESS' THEN 'worker_failed' END AS failure FROM v_scan""")
def c11_attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("scan_id")
    rows = view(spark, sf_dir, "v_scan").withColumns({"available": s % 59 != 0, "timed_out": s % 13 == 0, "output_over": s % 17 == 0, "exit_code": F.when(s % 19 == 0, F.when(s % 2 == 0, 1)).otherwise(0), "well_formed": s % 23 != 0})
    return rows.select("scan_id", contracts.failure_code().alias("failure"))


@query("""WITH s AS (SELECT scan_id, detected_type, CASE scan_id % 4 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'MALFORMED' ELSE 'UNKNOWN' END AS st, CASE scan_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'partial' ELSE 'failed' END AS e FROM v_scan)
    SELECT scan_id, 'pdf' AS family, 'pdf_analysis_' || e AS event, st AS parser_status, concat('{"page_count":', CASE WHEN scan_id % 5 = 0 THEN 'null' ELSE CAST(scan_id % 5 AS VARCHAR) END, '}') AS counters FROM s WHERE detected_type = 'PDF' AND scan_id % 3 <> 2
    UNION ALL SELECT scan_id, 'archive', 'archive_analysis_' || e, st, concat('{"actual_decompressed_bytes":', scan_id, ',"entry_count":7,"nested_archive_count":null}') FROM s WHERE scan_id % 3 = 1 UNION ALL SELECT scan_id, 'yara', 'yara_scan_completed', 'COMPLETE', '{"matched_rule_count":2}' FROM s
    UNION ALL SELECT scan_id, 'office', 'office_analysis_failed', 'UNKNOWN', '{"embedded_object_count":null,"external_relationship_count":null,"vba_project_count":null}' FROM s WHERE scan_id % 6 = 0""")
def c12_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("scan_id")
    state = F.when(s % 4 == 0, '"COMPLETE"').when(s % 4 == 1, '"PARTIAL"').when(s % 4 == 2, '"MALFORMED"').otherwise("7")
    pages = F.when(s % 5 == 0, '"many"').otherwise((s % 5).cast("string"))
    pdf = F.when(s % 3 != 2, F.concat(F.lit('"pdf":{"page_count":'), pages, F.lit(',"parser_status":'), state, F.lit("},")))
    archive = F.when(s % 3 == 1, F.concat(F.lit('"archive":{"parser_status":'), state, F.lit(',"entry_count":7,"nested_archive_count":1.5,"actual_decompressed_bytes":'), s, F.lit("},")))
    office = F.when(s % 6 == 0, '"office":{},').when(s % 6 == 1, '"office":[],')
    metadata = F.concat(F.lit("{"), *[F.coalesce(x, F.lit("")) for x in (pdf, archive, office)], F.lit('"yara":{"matched_rule_count":2,"parser_status":"COMPLETE"}}'))
    return contracts.run_log(view(spark, sf_dir, "v_scan").select("scan_id", "detected_type", metadata.alias("metadata")))


_AUDIT_TYPES = [*contracts.DOMAINS["event_type"], "ODD", "OTHER"]


@query("WITH a AS (SELECT " + f"[{', '.join(repr(x) for x in _AUDIT_TYPES)}][1 + event_id % {len(_AUDIT_TYPES)}]" + """ AS event_type, CASE event_id % 4 WHEN 0 THEN 'SYSTEM' WHEN 1 THEN 'OPERATOR' WHEN 2 THEN 'ANONYMOUS' ELSE 'ROBOT' END AS actor_type, CASE WHEN event_id % 9 = 0 THEN 'LOST' ELSE outcome END AS outcome FROM v_audit),
    v AS (SELECT 'event_type' AS domain, event_type AS value FROM a UNION ALL SELECT 'actor_type', actor_type FROM a UNION ALL SELECT 'outcome', outcome FROM a UNION ALL SELECT 'state', CASE WHEN scan_id % 71 = 0 THEN 'GONE' ELSE state END FROM v_record UNION ALL SELECT 'decision', CASE WHEN scan_id % 73 = 0 THEN 'MAYBE' ELSE decision END FROM v_record UNION ALL SELECT 'origin', CASE WHEN scan_id % 79 = 0 THEN 'MAIL' ELSE origin END FROM v_record)
    SELECT domain, value, count(*) AS n, value IN ('ODD', 'OTHER', 'ROBOT', 'LOST', 'GONE', 'MAYBE', 'MAIL') AS outside FROM v WHERE value IS NOT NULL GROUP BY domain, value""")
def c15_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six columns of the catalog and the audit log; some values are in none of their domains."""
    e, s = F.col("event_id"), F.col("scan_id")
    types = F.element_at(F.array(*map(F.lit, _AUDIT_TYPES)), (1 + e % len(_AUDIT_TYPES)).cast("int"))
    actor = F.when(e % 4 == 0, "SYSTEM").when(e % 4 == 1, "OPERATOR").when(e % 4 == 2, "ANONYMOUS").otherwise("ROBOT")
    audit = view(spark, sf_dir, "v_audit").select(types.alias("event_type"), actor.alias("actor_type"), F.when(e % 9 == 0, "LOST").otherwise(F.col("outcome")).alias("outcome"))
    odd = lambda c, n, value: F.when(s % n == 0, value).otherwise(F.col(c)).alias(c)
    records = view(spark, sf_dir, "v_record").select(odd("state", 71, "GONE"), odd("decision", 73, "MAYBE"), odd("origin", 79, "MAIL"))
    return contracts.domain_counts(audit, ["event_type", "actor_type", "outcome"]).unionAll(contracts.domain_counts(records, ["state", "decision", "origin"]))


#: The keys of an audit event's details that are shown.
SHOWN = ("decision", "derived_decision", "derived_scan_id", "duration_ms", "output_bytes", "page_count", "policy_version", "reason_codes", "requested_scan_id", "requested_artifact_id", "role", "sanitizer_version", "source_decision", "source_scan_id")


@query("""SELECT event_id, CASE event_id % 14 WHEN 10 THEN NULL WHEN 11 THEN NULL WHEN 12 THEN NULL WHEN 13 THEN '{"decision":"ALLOW","role":{"a":[true,null],"b":1}}' ELSE '{}' END AS kept,
    CASE event_id % 14 WHEN 0 THEN strlen(details) WHEN 1 THEN 34 WHEN 2 THEN strlen(details) - 1 WHEN 3 THEN strlen(details) - 1 WHEN 6 THEN strlen(details) - 2 WHEN 9 THEN strlen(replace(details, ' ', '')) WHEN 11 THEN NULL WHEN 12 THEN NULL WHEN 13 THEN strlen(replace(details, ' ', '')) ELSE strlen(details) END AS bytes FROM v_details""")
def n18_19_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_details")
    return rows.select("event_id", json_text.kept_keys(F.col("details"), SHOWN).alias("kept"), json_text.canonical_bytes(F.col("details")).alias("bytes"))
