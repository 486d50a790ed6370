"""Registered queries on file identity, relationships, page documents, rendered copies, manifests and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts, documents, evaluate, identity, pages, relationships, render
from ..sources import ingest, sinks
from .more_queries import _TYPED_SQL
from .queries import _MATCH_SQL, _matched, joined, query
from .views import view

# Identity ----------------------------------------------------------------------------------------

_CONTENT_SQL = """WITH f AS (SELECT scan_id, CASE WHEN content_hex = '' THEN 'UNKNOWN' WHEN starts_with(content_hex, '255044462D') THEN 'PDF' WHEN starts_with(content_hex, 'D0CF11E0A1B11AE1') THEN 'OLE_COMPOUND'
    WHEN regexp_matches(content_hex, '^504B(0304|0506|0708)') THEN 'ZIP' WHEN starts_with(content_hex, '4D5A') THEN 'WINDOWS_EXECUTABLE' WHEN regexp_matches(content_hex, '^([0-9A-F]{2})*00') THEN 'UNKNOWN' ELSE 'TEXT' END AS family FROM v_content) """


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.unhex("content_hex")
    return view(spark, sf_dir, "v_content").select("scan_id", identity.family_of_bytes(content).alias("family"))


@query(_CONTENT_SQL + "SELECT * FROM f")
def i02_family_of_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _families(spark, sf_dir)


@query(
    _CONTENT_SQL
    + """, p AS (SELECT doc_id, CASE WHEN count(DISTINCT app) = 1 THEN max(app) END AS app FROM (SELECT doc_id, CASE WHEN part_name = 'word/document.xml' AND contains(lower(content_type), 'wordprocessingml') THEN 'WORD' WHEN part_name = 'xl/workbook.xml' AND contains(lower(content_type), 'spreadsheetml') THEN 'EXCEL' END AS app FROM v_part) GROUP BY doc_id),
    o AS (SELECT doc_id, CASE WHEN bool_or(lower(path) = 'worddocument') THEN 'WORD' WHEN bool_or(lower(path) IN ('workbook', 'book')) THEN 'EXCEL' WHEN bool_or(lower(path) = 'powerpoint document') THEN 'POWERPOINT' END AS app FROM v_ole_entry GROUP BY doc_id),
    t AS (SELECT scan_id, family, CASE WHEN family = 'ZIP' AND p.app IS NOT NULL THEN concat('OFFICE_', p.app, '_OOXML') WHEN family = 'OLE_COMPOUND' AND o.app IS NOT NULL THEN concat('OFFICE_', o.app, '_OLE') ELSE family END AS detected_type FROM f LEFT JOIN p ON p.doc_id = scan_id LEFT JOIN o ON o.doc_id = scan_id)
    SELECT scan_id, detected_type, CASE WHEN (family = 'PDF' AND scan_id % 5 = 0) OR (family IN ('ZIP', 'OLE_COMPOUND') AND scan_id % 3 = 0) OR scan_id % 7 = 0 THEN 'FAILED' WHEN family = 'UNKNOWN' THEN 'UNSUPPORTED' ELSE 'SUCCESS' END AS status FROM t"""
)
def i03_04_routed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = documents.classify_packages(view(spark, sf_dir, "v_part"))
    rows = identity.routed(_families(spark, sf_dir), packages, documents.compound_files(view(spark, sf_dir, "v_ole_entry")))
    s = F.col("scan_id")
    return rows.select("scan_id", "detected_type", identity.scan_status(F.col("family"), s % 5 != 0, s % 3 != 0, s % 7 != 0).alias("status"))


# Relationships -----------------------------------------------------------------------------------


@query("""WITH r AS (SELECT *, row_number() OVER w AS nth, count(*) FILTER (lower(target_mode) = 'external' AND source_part <> '') OVER (PARTITION BY doc_id ORDER BY source_part, ordinal ROWS UNBOUNDED PRECEDING) AS ext, lower(target_mode) = 'external' AND source_part <> '' AS is_ext
      FROM v_relationship WINDOW w AS (PARTITION BY doc_id ORDER BY source_part, ordinal)), b AS (SELECT *, CASE WHEN nth > 30 THEN 'relationship_limit' WHEN ext > 16 THEN 'external_relationship_limit' END AS why FROM r)
    SELECT doc_id, count(*) FILTER (why IS NULL) AS kept, count(*) FILTER (why IS NULL AND is_ext) AS "external", arg_min(why, nth) FILTER (why IS NOT NULL) AS reason FROM b GROUP BY doc_id""")
def o04_relationship_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships.within_limits(view(spark, sf_dir, "v_relationship"), 30, 16)


@query("""WITH p AS (SELECT doc_id, CASE WHEN count(DISTINCT app) = 1 THEN max(app) END AS application FROM (SELECT doc_id, CASE WHEN part_name = 'word/document.xml' AND contains(lower(content_type), 'wordprocessingml') THEN 'word' WHEN part_name = 'xl/workbook.xml' AND contains(lower(content_type), 'spreadsheetml') THEN 'excel' END AS app FROM v_part) GROUP BY doc_id),
    t AS (SELECT DISTINCT doc_id, CASE target WHEN './word//document.xml' THEN 'word' WHEN 'xl/workbook.xml' THEN 'excel' END AS application FROM v_relationship WHERE source_part = '' AND rel_type = 'http://x/officeDocument')
    SELECT doc_id, application FROM p WHERE application IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = p.doc_id AND t.application = p.application)""")
def o03_main_part_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships.without_main_part(documents.classify_packages(view(spark, sf_dir, "v_part")), view(spark, sf_dir, "v_relationship"))


# Page documents ----------------------------------------------------------------------------------

@query("""WITH n AS (SELECT doc_id, substr(replace(display_name, '/', '_'), 1, 128) AS name, min(ordinal) AS first_at FROM v_attachment WHERE named GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_at, name) AS nth, count(*) OVER (PARTITION BY doc_id) AS total FROM n)
    SELECT doc_id, string_agg(name, '|' ORDER BY name) AS names, max(total) > 8 AS capped FROM k WHERE nth <= 8 GROUP BY doc_id""")
def n12_attachment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = view(spark, sf_dir, "v_attachment").where("named")
    return pages.attachment_names(named, 8).withColumn("names", F.array_join("names", "|"))


# Rendered copies ---------------------------------------------------------------------------------

_RENDER_SQL = """WITH v AS (SELECT *, array_to_string(list_filter([CASE WHEN schema_version <> '1' OR operation <> 'SANITIZE' THEN 'contract' END, CASE WHEN status = 'FAILED' AND failure_code IS NULL THEN 'failure_code' END,
      CASE WHEN status = 'SUCCESS' AND (failure_code IS NOT NULL OR page_count < 1 OR output_bytes < 1) THEN 'success' END], x -> x IS NOT NULL), ',') AS violations FROM v_render),
    w AS (SELECT *, CASE WHEN unavailable THEN 'renderer_unavailable' WHEN timed_out THEN 'render_timeout' WHEN output_over OR exit_code <> 0 THEN 'render_failed' WHEN violations <> '' OR renderer <> '1.0' THEN 'output_invalid' WHEN status = 'FAILED' THEN failure_code END AS failure FROM v) """


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_render").withColumn("violations", contracts.violations(render.result_rules("1", "SANITIZE")))
    return rows.withColumn("failure", render.outcome(F.col("violations"), "1.0"))


@query(_RENDER_SQL + "SELECT scan_id, violations, failure FROM w")
def c13_14_render_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).select("scan_id", joined("violations").alias("violations"), "failure")


@query(_RENDER_SQL + """, x AS (SELECT *, failure IS NULL AND derived_scan_id IS NOT NULL AS approved FROM w), y AS (SELECT *, approved OR coalesce(failure <> 'ineligible', false) AS eligible FROM x)
    SELECT scan_id, eligible, CASE WHEN eligible THEN derived_scan_id END AS derived, NOT eligible AND derived_scan_id IS NOT NULL AS misplaced FROM y""")
def e20_follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rendered(spark, sf_dir).withColumn("approved", F.col("failure").isNull() & F.col("derived_scan_id").isNotNull())
    return render.follow_up(rows).select("scan_id", "eligible", "derived", "misplaced")


# Manifests and sinks, written to the shared folder and read back -----------------------------------


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases in the shape of a manifest."""
    rows = view(spark, sf_dir, "v_case")
    return rows.select(F.col("case_id").cast("string").alias("case_id"), "category", "case_class", evaluate.codes("expected").alias("expected_findings"), evaluate.codes("decisions").alias("acceptable_decisions"), "fail_secure")


@query("""SELECT CASE WHEN case_id % 53 = 0 THEN 'unreadable' ELSE 'case' END AS kind, CASE WHEN case_id % 53 <> 0 THEN case_id::VARCHAR END AS case_id, CASE WHEN case_id % 53 <> 0 THEN category END AS category, CASE WHEN case_id % 53 <> 0 THEN len(string_split(decisions, ',')) END AS decisions FROM v_case""")
def s04_manifest_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest in which some records break off: its cases, and all records that are none."""
    path = sinks.shared_path(spark, "manifest")
    line = F.to_json(F.struct("*"))
    broken = F.col("case_id").cast("long") % 53 == 0
    _cases(spark, sf_dir).select(F.when(broken, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    good, bad = ingest.read_manifest(spark, path)
    found = good.select(F.lit("case").alias("kind"), "case_id", "category", F.size("acceptable_decisions").alias("decisions"))
    return found.unionAll(bad.select(F.lit("unreadable"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int")))


@query("SELECT CASE WHEN fail_secure AND list_contains(string_split(decisions, ','), 'ALLOW') THEN 'fail_secure_allow' ELSE 'written' END AS fate, case_id::VARCHAR AS case_id FROM v_case")
def s05_manifest_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.shared_path(spark, "manifest")
    faults = ingest.write_manifest(_cases(spark, sf_dir), path)
    return ingest.read_manifest(spark, path)[0].select(F.lit("written").alias("fate"), "case_id").unionAll(faults.select(F.col("fault").alias("fate"), "case_id"))


@query("SELECT event_id, event_type, outcome, CASE WHEN outcome = 'SUCCESS' THEN 1 ELSE 2 END AS batch FROM v_audit")
def s10_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches appended to one log."""
    path = sinks.shared_path(spark, "audit")
    events = view(spark, sf_dir, "v_audit").select("event_id", "event_type", "outcome")
    for number, batch in ((1, events.where("outcome = 'SUCCESS'")), (2, events.where("outcome <> 'SUCCESS'"))):
        sinks.append_audit(batch.withColumn("batch", F.lit(number)), path)
    return spark.read.parquet(path)
