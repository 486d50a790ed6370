"""Registered queries on the catalog, storage, contracts, office and page documents, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalog, contracts, documents, evaluate, reconcile
from . import dims, queries
from .queries import _MATCH_SQL, _POLICY_SQL, evaluated, joined, query
from .views import view


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans with their evaluation; those without a worker status have none."""
    evaluation = evaluated(spark, sf_dir).select(F.col("scan_id").alias("_scan"), "score", "band", "decision", "release_eligible", "complete")
    scans = view(spark, sf_dir, "v_scan").drop("text")
    return scans.join(evaluation, F.when(F.col("status").isNotNull(), F.col("scan_id")) == F.col("_scan"), "left").drop("_scan")


_SCANS_SQL = _POLICY_SQL + ", scans AS (SELECT v_scan.*, e.score, e.band, e.decision, e.release_eligible, e.complete FROM v_scan LEFT JOIN evaluation e ON e.scan_id = v_scan.scan_id AND status IS NOT NULL) "


def _newest() -> list:
    return [F.desc("created_at"), F.desc("scan_id")]


# Operator queries --------------------------------------------------------------------------------


@query(_SCANS_SQL + "SELECT scan_id, decision FROM scans WHERE decision IN ('REVIEW', 'QUARANTINE', 'BLOCK') ORDER BY created_at DESC, scan_id DESC LIMIT 100")
def q02_containment_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page(catalog.listing(_scans(spark, sf_dir), decision="ALLOW", contained_only=True), _newest(), 1, 100).select("scan_id", "decision")


_APPROVED_SQL = _SCANS_SQL + ", ok AS (SELECT a.*, s.score AS derived_score FROM v_artifact a JOIN scans s ON s.scan_id = a.derived_scan_id WHERE artifact_type = 'CLEANED' AND s.decision = 'ALLOW' AND s.release_eligible) "


@query(_APPROVED_SQL + "SELECT artifact_id, derived_scan_id, derived_score FROM ok ORDER BY created_at DESC, artifact_id DESC LIMIT 50")
def q03_approved_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = catalog.approved(view(spark, sf_dir, "v_artifact"), _scans(spark, sf_dir))
    return catalog.page(ok, [F.desc("created_at"), F.desc("artifact_id")], 1, 50).select("artifact_id", "derived_scan_id", "derived_score")


@query(_APPROVED_SQL + "SELECT artifact_id, fingerprint FROM ok WHERE artifact_id % 20 = 0")
def q04_artifact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.approved(view(spark, sf_dir, "v_artifact"), _scans(spark, sf_dir)).where(F.col("artifact_id") % 20 == 0).select("artifact_id", "fingerprint")


@query("SELECT event_id, event_type, username FROM v_audit LEFT JOIN v_operator ON operator_id = actor_id ORDER BY us DESC, event_id DESC LIMIT 100")
def q05_audit_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    operators = view(spark, sf_dir, "v_operator").withColumnRenamed("operator_id", "actor_id")
    return catalog.page(view(spark, sf_dir, "v_audit").join(operators, "actor_id", "left"), [F.desc("us"), F.desc("event_id")], 1, 100).select("event_id", "event_type", "username")


@query(_SCANS_SQL + """SELECT * FROM (SELECT 'recent' AS list, scan_id FROM scans ORDER BY created_at DESC, scan_id DESC LIMIT 5) UNION ALL SELECT * FROM (SELECT 'contained', scan_id FROM scans WHERE decision IN ('REVIEW', 'QUARANTINE', 'BLOCK') ORDER BY created_at DESC, scan_id DESC LIMIT 5)""")
def q07_dashboard_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = _scans(spark, sf_dir)
    top = lambda df, name: catalog.page(df, _newest(), 1, 5).select(F.lit(name).alias("list"), "scan_id")
    return top(scans, "recent").unionAll(top(catalog.listing(scans, contained_only=True), "contained"))


@query(_APPROVED_SQL + "SELECT count(*) AS approved FROM ok")
def q08_approved_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.approved(view(spark, sf_dir, "v_artifact"), _scans(spark, sf_dir)).agg(F.count(F.lit(1)).alias("approved"))


@query(_SCANS_SQL + """SELECT s.scan_id, coalesce(decision, 'QUARANTINE') AS decision, coalesce(score, 0) AS score, coalesce(band, 'LOW') AS band, CASE coalesce(decision, 'QUARANTINE') WHEN 'ALLOW' THEN 'may be released' WHEN 'REVIEW' THEN 'needs a look' WHEN 'BLOCK' THEN 'is refused' ELSE 'is held' END AS message,
    coalesce(string_agg(code, ',' ORDER BY code), '') AS codes, CASE WHEN decision IS NULL THEN 'POLICY_EVALUATION_MISSING' ELSE '' END AS reason FROM scans s LEFT JOIN (SELECT DISTINCT scan_id, code FROM v_finding) f USING (scan_id) GROUP BY s.scan_id, decision, score, band""")
def q09_10_scan_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = view(spark, sf_dir, "v_finding").groupBy("scan_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    rows = _scans(spark, sf_dir).withColumn("reason", F.when(F.col("decision").isNull(), "POLICY_EVALUATION_MISSING").otherwise("")).join(codes, "scan_id", "left")
    return catalog.with_defaults(rows).select("scan_id", "decision", "score", "band", "message", F.coalesce(joined("codes"), F.lit("")).alias("codes"), "reason")


# Lineage and remediation -------------------------------------------------------------------------


@query("""WITH p AS (SELECT doc_id, page_no, CAST(ceil(width * 150 / 72) * ceil(height * 150 / 72) AS BIGINT) AS pixels FROM v_page_size), q AS (SELECT *, sum(pixels) OVER (PARTITION BY doc_id ORDER BY page_no) AS running FROM p),
    r AS (SELECT doc_id, count(*) AS pages, min(page_no) FILTER (pixels > 20000000 OR running > 60000000) AS breach_page, CAST(sum(pixels) AS BIGINT) AS pixels FROM q GROUP BY doc_id)
    SELECT *, CASE WHEN pages NOT BETWEEN 1 AND 100 THEN 'page_limit' WHEN breach_page IS NOT NULL THEN 'pixel_limit' ELSE 'ok' END AS verdict FROM r""")
def l05_page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page_budget(view(spark, sf_dir, "v_page_size"), 150, 20_000_000, 60_000_000)


# Reconciliation ----------------------------------------------------------------------------------

@query("SELECT scan_id, (SELECT count(*) FROM v_scan) > 100 AS truncated FROM v_scan ORDER BY scan_id LIMIT 100")
def r08_bounded_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, more = reconcile.bounded_batch(view(spark, sf_dir, "v_scan").select("scan_id"), "scan_id", 100)
    return rows.withColumn("truncated", F.lit(more))


@query("SELECT session_id, expires_at FROM v_session WHERE revoked_at IS NOT NULL OR expires_at <= 200000 ORDER BY expires_at, session_id LIMIT 500")
def t07_session_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_session").where("revoked_at IS NOT NULL OR expires_at <= 200000")
    return rows.orderBy("expires_at", "session_id").limit(500).select("session_id", "expires_at")


@query("SELECT role, count(*) AS n FROM v_operator WHERE active GROUP BY role")
def t08_active_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_operator").where("active").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


# Contracts ---------------------------------------------------------------------------------------


@query("SELECT 'repeated_key' AS fault, storage_key AS subject FROM v_artifact GROUP BY storage_key HAVING count(*) > 1 UNION ALL SELECT 'no_derived', artifact_id::VARCHAR FROM v_artifact WHERE derived_scan_id NOT IN (SELECT scan_id FROM v_scan) UNION ALL SELECT 'no_parent', scan_id::VARCHAR FROM v_lineage WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT scan_id FROM v_scan)")
def c16_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts, scans = view(spark, sf_dir, "v_artifact"), view(spark, sf_dir, "v_scan")
    row = lambda df, fault, c: df.select(F.lit(fault).alias("fault"), F.col(c).cast("string").alias("subject"))
    lineage = contracts.unresolved(view(spark, sf_dir, "v_lineage"), "parent_id", scans, "scan_id")
    return row(contracts.repeated(artifacts, "storage_key"), "repeated_key", "storage_key").unionAll(row(contracts.unresolved(artifacts, "derived_scan_id", scans, "scan_id"), "no_derived", "artifact_id")).unionAll(row(lineage, "no_parent", "scan_id"))


# Office ------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT doc_id, CASE WHEN part_name = 'word/document.xml' AND contains(lower(content_type), 'wordprocessingml') THEN 'word' WHEN part_name = 'xl/workbook.xml' AND contains(lower(content_type), 'spreadsheetml') THEN 'excel' END AS app, lower(content_type) AS ct FROM v_part)
    SELECT doc_id, CASE WHEN count(DISTINCT app) = 1 THEN max(app) ELSE 'unknown' END AS application, bool_or(app IS NOT NULL AND contains(ct, 'macroenabled')) AS macro_enabled FROM a GROUP BY doc_id""")
def i10_package_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.classify_packages(view(spark, sf_dir, "v_part"))


@query("SELECT doc_id, part_name, count(DISTINCT content_type) AS types, count(*) AS n FROM v_part GROUP BY ALL HAVING count(DISTINCT content_type) > 1 OR count(*) > 1")
def i11_o05_ambiguous_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.ambiguous_parts(view(spark, sf_dir, "v_part"))


@query("""SELECT doc_id, least(count(*) FILTER (regexp_matches(part_name, '^(word|xl|ppt)/embeddings/')), 256) AS embedded, least(count(*) FILTER (regexp_matches(part_name, '^(word|xl|ppt)/activeX/')), 256) AS activex,
    count(DISTINCT part_name) FILTER (contains(lower(content_type), 'vbaproject') OR regexp_matches(part_name, '^(word|xl|ppt)/vbaProject\\.bin$')) AS projects, count(DISTINCT part_name) FILTER (contains(lower(content_type), 'vbaproject') OR regexp_matches(part_name, '^(word|xl|ppt)/vbaProject\\.bin$')) > 8 OR count(*) FILTER (regexp_matches(part_name, '^(word|xl|ppt)/embeddings/')) >= 256 AS partial FROM v_part GROUP BY doc_id""")
def o06_08_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.capabilities(view(spark, sf_dir, "v_part"))


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source_part, ordinal) AS nth, split_part(rel_type, '/', 4) || ' ' || lower(regexp_extract(target, '^([a-zA-Z]+):', 1)) || ' ' || lower(regexp_extract(target, '//([^/?#:]*)', 1)) AS s FROM v_relationship WHERE lower(target_mode) = 'external' AND source_part <> '')
    SELECT doc_id, count(*) AS external, count(*) FILTER (ends_with(lower(rel_type), '/attachedtemplate')) AS templates, string_agg(s, ',' ORDER BY nth) FILTER (nth <= 2) AS kept FROM x GROUP BY doc_id""")
def o01_04_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.external_relationships(view(spark, sf_dir, "v_relationship"), 2).select("doc_id", "external", "templates", joined("kept").alias("kept"))


# Page documents ----------------------------------------------------------------------------------

_TYPED_SQL = f"WITH a AS (SELECT *, subtype IN {tuple(dims.ACTIONS)} AS known FROM v_action), b AS (SELECT *, CASE WHEN NOT known AND row_number() OVER (PARTITION BY doc_id, subtype ORDER BY action_id) = 1 THEN 1 ELSE 0 END AS new FROM a), t AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY doc_id ORDER BY action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b), typed AS (SELECT *, CASE WHEN known THEN subtype WHEN before >= 1 THEN 'Unknown:other' ELSE 'Unknown:' || subtype END AS type FROM t) "


@query(_TYPED_SQL + "SELECT doc_id, type, count(*) AS n FROM typed GROUP BY doc_id, type")
def p01_action_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.action_types(view(spark, sf_dir, "v_action"), 1).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query(_TYPED_SQL.replace(">= 1 THEN 'Unknown:other'", ">= 32 THEN 'Unknown:other'") + """SELECT doc_id, count(*) FILTER (type = 'JavaScript') AS scripts, count(*) FILTER (type = 'Launch') AS launches, count(*) FILTER (type = 'URI') AS links, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT holder_id) AS holders, least(count(*) FILTER (type = 'URI'), 32) AS kept_targets, count(*) FILTER (type = 'URI') > 128 AS partial,
    least(count(*) FILTER (type = 'SubmitForm' AND target <> 'no target'), 32) AS external_forms FROM typed GROUP BY doc_id""")
def p03_06_action_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.action_summary(documents.action_types(view(spark, sf_dir, "v_action"))).withColumn("sources", joined("sources"))


_WORDS = {"links": ["href=", "src="], "tracking": ["track("], "tables": ["<table"], "none": ["getField("]}


@query("SELECT doc_id, concat_ws(',', CASE WHEN contains(substr(source_text, 1, 65536), 'href=') OR contains(substr(source_text, 1, 65536), 'src=') THEN 'links' END, CASE WHEN contains(substr(source_text, 1, 65536), '<table') THEN 'tables' END, CASE WHEN contains(substr(source_text, 1, 65536), 'track(') THEN 'tracking' END) AS categories FROM v_script")
def p07_script_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.script_behavior(view(spark, sf_dir, "v_script"), _WORDS).select("doc_id", joined("categories").alias("categories"))


@query("SELECT page_id AS doc_id, least(len(regexp_extract_all(html, '/(?:d|#64)(?:i|#69)(?:v|#76)')), 9999) AS div, least(len(regexp_extract_all(html, '/(?:p|#70)')), 9999) AS p FROM pages")
def p09_name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    counts = documents.name_tokens(F.col("html"), ["div", "p"])
    return pages.select(F.col("page_id").alias("doc_id"), counts[0]["n"].alias("div"), counts[1]["n"].alias("p"))


@query(_TYPED_SQL + """, s AS (SELECT doc_id, count(*) FILTER (type = 'JavaScript') AS a, count(*) FILTER (type = 'Launch') AS b, count(*) FILTER (type = 'URI') AS c, bool_or(source = 'open') AS o, bool_or(source = 'page') AS p, bool_or(source = 'form') AS f, count(*) FILTER (type = 'SubmitForm' AND target <> 'no target') AS x FROM typed GROUP BY doc_id)
    SELECT 'PDF_JAVASCRIPT' AS code, count(*) FILTER (a > 0) AS n FROM s UNION ALL SELECT 'PDF_LAUNCH_ACTION', count(*) FILTER (b > 0) FROM s UNION ALL SELECT 'PDF_EXTERNAL_URI', count(*) FILTER (c > 0) FROM s UNION ALL SELECT 'PDF_OPEN_ACTION', count(*) FILTER (o) FROM s UNION ALL SELECT 'PDF_ADDITIONAL_ACTION', count(*) FILTER (p) FROM s UNION ALL SELECT 'PDF_ACROFORM', count(*) FILTER (f) FROM s UNION ALL SELECT 'PDF_EXTERNAL_SUBMISSION', count(*) FILTER (x > 0) FROM s""")
def p11_page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.page_findings(documents.action_summary(documents.action_types(view(spark, sf_dir, "v_action"))))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# Evaluation cases and sinks ----------------------------------------------------------------------


@query("SELECT case_class AS id, count(*) AS n FROM v_case GROUP BY case_class HAVING count(*) > 1")
def e17_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.repeated(view(spark, sf_dir, "v_case"), "case_class").withColumnRenamed("case_class", "id")


@query("SELECT doc_id, SHA(text) AS sha, strlen(text) AS size, CASE WHEN strlen(text) = 0 THEN 'EMPTY' WHEN strlen(text) > 4000 THEN 'TOO_LARGE' END AS reject_reason FROM documents")
def s01_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.ingest import ingest

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("content"))
    return ingest(docs, 4000).select("doc_id", "sha", "size", "reject_reason")


@query("SELECT area, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM v_listing WHERE NOT starts_with(name, '.') GROUP BY area")
def s03_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_listing").where(~F.startswith("name", F.lit("."))).groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))


@query("SELECT doc_id, CASE WHEN contains(text, 'License') THEN 'License' WHEN contains(text, 'token') THEN 'token' END AS leak FROM documents")
def s11_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import leak

    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", leak(F.col("text"), ["License", "token"]).alias("leak"))


@query("WITH a AS (SELECT * FROM v_audit QUALIFY row_number() OVER (PARTITION BY actor_id ORDER BY us DESC, event_id DESC) = 1) SELECT actor_id, event_id AS last_event, outcome FROM a")
def s02_10_audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.row_number().over(Window.partitionBy("actor_id").orderBy(F.desc("us"), F.desc("event_id")))
    return view(spark, sf_dir, "v_audit").withColumn("nth", last).where("nth = 1").select("actor_id", F.col("event_id").alias("last_event"), "outcome")


# Streams over the given tables, drained ------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    from ..streaming import jobs

    return jobs.drain(stream, mode)


def _streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over events as a stream, with its time as a timestamp."""
    return view(spark, sf_dir, name, lambda _: _stream(spark, sf_dir)).withColumn("ts", F.timestamp_micros("us"))


@query("SELECT CAST(us // 3600000000 AS BIGINT) AS hour, event_type, count(*) AS n FROM v_event GROUP BY ALL")
def t10_stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import jobs

    return _drained(jobs.hourly_counts(_stream(spark, sf_dir)), "complete").select(F.expr("unix_micros(hour) div 3600000000").alias("hour"), "event_type", "n")


@query(queries.T01_SQL)
def t01_stream_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import jobs

    return _drained(jobs.accepted(_stream(spark, sf_dir), 21600, 2)).select("event_id", "accepted")


@query(queries.T05_SQL)
def t05_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import jobs

    return _drained(jobs.session_validity(_streamed(spark, sf_dir, "v_session_event"))).select("event_id", "valid")


@query("""WITH c AS (SELECT *, lead(us) OVER (PARTITION BY scan_id ORDER BY us, event_id) AS next_us, max(us) OVER () AS last_us FROM v_change)
    SELECT scan_id, us + 900000000 AS stale_us FROM c WHERE state = 'ANALYZING' AND (next_us >= us + 900000000 OR next_us IS NULL AND (us + 900000000) // 1000 + 1 <= (last_us - 600000000) // 1000)""")
def t09_stream_stale_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans that stay in analysis for 15 minutes; the last ones show when the watermark, ten minutes behind, has passed their deadline."""
    from ..streaming import jobs

    return _drained(jobs.stale_watch(_streamed(spark, sf_dir, "v_change"), 15))


@query("SELECT event_id, event_type, actor_id, outcome, us FROM v_audit")
def s10_stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log written by the streaming sink and read back."""
    import uuid

    from ..sources.tables import shared_folder
    from ..streaming import jobs

    path = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    events = view(spark, sf_dir, "v_audit", lambda _: _stream(spark, sf_dir)).select("event_id", "event_type", "actor_id", "outcome", "us")
    jobs.append_audit(events, path, f"{path}-checkpoint").start().awaitTermination()
    return spark.read.schema(events.schema).parquet(path)


# More evidence and contracts ---------------------------------------------------------------------


@query("""WITH p AS (SELECT doc_id, count(*) FILTER (NOT r) AS loose FROM (SELECT doc_id, payload_id, bool_or(referenced) AS r FROM v_attachment GROUP BY ALL) GROUP BY doc_id), o AS (SELECT doc_id, count(*) FILTER (named) AS named, count(DISTINCT spec_id) AS specs FROM v_attachment GROUP BY doc_id)
    SELECT doc_id, least(greatest(named, specs) + loose, 128) AS embedded FROM o JOIN p USING (doc_id)""")
def p08_embedded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.embedded_count(view(spark, sf_dir, "v_attachment"))


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS nth, count(*) OVER (PARTITION BY doc_id) AS total FROM v_attachment WHERE named) SELECT doc_id, ordinal, CASE WHEN total > 2 THEN 'attachment_limit' END AS reason FROM n WHERE nth <= 2")
def p10_13_15_visit_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.within_limit(view(spark, sf_dir, "v_attachment").where("named"), "ordinal", 2, "attachment_limit").select("doc_id", "ordinal", "reason")


@query("SELECT action_id, CASE WHEN subtype IN ('JavaScript', 'Launch') THEN 'action' ELSE 'destination' END AS kind, count(*) AS n FROM v_action WHERE source = 'open' GROUP BY ALL")
def p14_open_action_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("subtype").isin("JavaScript", "Launch"), "action").otherwise("destination")
    return view(spark, sf_dir, "v_action").where("source = 'open'").groupBy("action_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT concat('R', p_partkey % 97) AS rule_id, CASE WHEN p_partkey % 400 < 2 THEN '$x' ELSE concat('$', p_partkey) END AS string_id, p_name AS expression, CASE WHEN p_partkey % 211 = 0 THEN 'other' ELSE concat('C', p_partkey % 97) END AS code FROM part), m AS (SELECT DISTINCT concat('R', s_suppkey % 101) AS rule_id FROM supplier),
    d AS (SELECT rule_id, sha256(string_agg(rule_id || chr(9) || string_id || chr(9) || expression || chr(9) || code, chr(10) ORDER BY rule_id || chr(9) || string_id || chr(9) || expression || chr(9) || code)) AS digest FROM p GROUP BY rule_id), w AS (SELECT sha256(string_agg(digest, chr(10) ORDER BY rule_id)) AS digest FROM d)
    SELECT 'repeated' AS fault, rule_id FROM p GROUP BY rule_id HAVING count(*) > count(DISTINCT string_id) OR count(DISTINCT code) > 1 UNION ALL SELECT 'undeclared', rule_id FROM (SELECT DISTINCT rule_id FROM p) WHERE rule_id NOT IN (SELECT rule_id FROM m)
    UNION ALL SELECT 'missing', rule_id FROM m WHERE rule_id NOT IN (SELECT rule_id FROM p) UNION ALL SELECT 'digest', NULL UNION ALL SELECT 'found', digest FROM w""")
def y05_rule_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as strings of a pack of rules, suppliers as its manifest: what differs, and the digest found."""
    from ..operators import rules

    k = F.col("p_partkey")
    number = lambda prefix, n: F.concat(F.lit(prefix), (k % n).cast("string"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    pack = part.select(number("R", 97).alias("rule_id"), F.when(k % 400 < 2, "$x").otherwise(F.concat(F.lit("$"), k)).alias("string_id"), F.col("p_name").alias("expression"), F.when(k % 211 == 0, "other").otherwise(number("C", 97)).alias("code"))
    manifest = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("R"), (F.col("s_suppkey") % 101).cast("string")).alias("rule_id"))
    return rules.pack_faults(pack, manifest, "expected").unionAll(rules.pack_digest(pack).select(F.lit("found"), "digest"))


# Compound files ----------------------------------------------------------------------------------


@query("""WITH e AS (SELECT DISTINCT doc_id, family, lower(path) AS path, regexp_extract(lower(path), '([^/]*)$', 1) AS leaf FROM v_ole_entry),
    g AS (SELECT doc_id, min(family) AS family, bool_or(path = 'worddocument') AS word, bool_or(path IN ('workbook', 'book')) AS excel, bool_or(path = 'powerpoint document') AS powerpoint, bool_or(leaf = 'encryptioninfo') AND bool_or(leaf = 'encryptedpackage') AS encrypted,
          count(*) FILTER (leaf IN ('ole10native', 'package') OR starts_with(path, 'objectpool/')) AS embedded, count(*) FILTER (starts_with(path, 'ctls/') OR starts_with(path, 'activex/') OR contains(path, '/activex/')) AS active,
          count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1)) FILTER (ends_with(path, '/dir') AND (starts_with(path, 'vba/') OR contains(path, '/vba/'))) AS vba_projects FROM e GROUP BY doc_id)
    SELECT doc_id, CASE WHEN word THEN 'word' WHEN excel THEN 'excel' WHEN powerpoint THEN 'powerpoint' ELSE 'unknown' END AS application, encrypted, least(embedded, 256) AS embedded_objects, least(active, 256) AS activex, vba_projects,
           array_to_string(list_filter([CASE WHEN embedded > 256 THEN 'embedded_object_limit' END, CASE WHEN active > 256 THEN 'activex_object_limit' END, CASE WHEN family <> 'OLE_COMPOUND' THEN 'container_mismatch' END], x -> x IS NOT NULL), ',') AS reasons, family = 'OLE_COMPOUND' AS container_ok FROM g""")
def i12_13_o08_15_compound_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.compound_files(view(spark, sf_dir, "v_ole_entry"))
