"""Registered queries on office documents as a whole: reads, macros, findings with status, what is handed on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, office
from . import dims
from .queries import joined, query
from .views import view

#: Limits that the given tables reach.
_READ = {"most_parts": 6, "most_xml": 3, "xml_bytes": 4 << 20, "part_bytes": 2_500_000, "total_bytes": 6_000_000}
_LISTS = ("names", "triggers", "classes", "reasons")
_DISTINCT = lambda c: f"array_to_string(list_sort(list_distinct(flatten(list({c})))), ',')"

_MACRO_SQL = f"""words(word, cls) AS ({dims.sql_values(list(dims.EXECUTION.items()))}), mo AS (SELECT DISTINCT doc_id, project, module_no, name, source_bytes FROM v_module),
    mw AS (SELECT *, coalesce(sum(source_bytes) OVER (PARTITION BY doc_id, project ORDER BY module_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM mo),
    mr AS (SELECT *, least(source_bytes, greatest(0, 4194304 - bef)) AS seen, module_no <= 5 AND bef < 4194304 AS taken, CASE WHEN module_no > 5 AND bef < 4194304 THEN 'vba_module_limit' WHEN module_no <= 5 AND source_bytes > greatest(0, 4194304 - bef) THEN 'vba_source_size_limit' END AS reason FROM mw),
    mk AS (SELECT v.doc_id, v.project, list(DISTINCT lower(trim(keyword))) FILTER (kind = 'AutoExec' AND lower(trim(keyword)) IN ('autoopen', 'document_open')) AS triggers, list(DISTINCT cls) FILTER (kind = 'Suspicious' AND cls IS NOT NULL) AS classes
      FROM v_module v JOIN mr USING (doc_id, project, module_no) LEFT JOIN words ON word = lower(trim(keyword)) WHERE taken AND keyword_at + strlen(keyword) <= seen GROUP BY ALL),
    mp AS (SELECT doc_id, project, count(*) FILTER (taken) AS modules, CAST(coalesce(sum(seen) FILTER (taken), 0) AS BIGINT) AS bytes, list(name ORDER BY module_no) FILTER (taken) AS names, list(DISTINCT reason) FILTER (reason IS NOT NULL) AS reasons FROM mr GROUP BY ALL),
    macros AS (SELECT doc_id, count(*) AS projects, least(sum(modules), 128) AS modules, least(sum(bytes), 4194304) AS bytes, array_to_string(flatten(list(coalesce(names, []) ORDER BY project)), ',') AS names, {_DISTINCT("coalesce(triggers, [])")} AS triggers, {_DISTINCT("coalesce(classes, [])")} AS classes, {_DISTINCT("coalesce(reasons, [])")} AS reasons FROM mp LEFT JOIN mk USING (doc_id, project) GROUP BY doc_id) """
_READ_SQL = f"""pk AS (SELECT *, CASE WHEN part_name = '[Content_Types].xml' THEN 0 WHEN ends_with(lower(part_name), '.xml') OR ends_with(lower(part_name), '.rels') THEN 1 WHEN contains(lower(part_name), 'vbaproject') THEN 2 END AS kind FROM v_package),
    pw AS (SELECT *, row_number() OVER w AS nth, coalesce(sum(CASE WHEN kind < 2 THEN bytes ELSE 0 END) OVER v, 0) AS xb, coalesce(sum(bytes) OVER v, 0) AS tb FROM pk WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY kind, part_name), v AS (PARTITION BY doc_id ORDER BY kind, part_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    pr AS (SELECT *, CASE WHEN kind < 2 THEN least({_READ["part_bytes"]}, {_READ["xml_bytes"]} - xb) ELSE {_READ["part_bytes"]} END AS room FROM pw),
    pb AS (SELECT doc_id, arg_min(breach, nth) FILTER (breach IS NOT NULL) AS breach FROM (SELECT *, CASE WHEN kind < 2 AND nth > {_READ["most_xml"]} THEN 'xml_part_limit' WHEN kind < 2 AND xb >= {_READ["xml_bytes"]} THEN 'xml_actual_byte_limit' WHEN bytes > room AND room <= {_READ["total_bytes"]} - tb THEN 'member_actual_byte_limit' WHEN tb + bytes > {_READ["total_bytes"]} THEN 'total_actual_byte_limit' END AS breach FROM pr) GROUP BY doc_id),
    po AS (SELECT doc_id, count(*) AS n, max(length(part_name)) > 512 AS long, bool_or(flag_bits = 1) AS locked, bool_or(part_name = '[Content_Types].xml') AS is_package, count(*) > count(DISTINCT part_name) AS twice FROM v_package GROUP BY doc_id),
    reads AS (SELECT doc_id, is_package, CASE WHEN n > {_READ["most_parts"]} THEN 'zip_entry_limit' WHEN twice THEN 'duplicate_zip_member' ELSE breach END AS stop, n <= {_READ["most_parts"]} AND twice AS malformed, n <= {_READ["most_parts"]} AND NOT twice AND locked AS encrypted,
      list_filter([CASE WHEN n > {_READ["most_parts"]} THEN 'zip_entry_limit' WHEN twice THEN 'duplicate_zip_member' ELSE breach END, CASE WHEN long AND n <= {_READ["most_parts"]} THEN 'zip_member_name_limit' END, CASE WHEN n <= {_READ["most_parts"]} AND NOT twice AND locked THEN 'encrypted_zip_member' END], x -> x IS NOT NULL) AS reasons FROM po LEFT JOIN pb USING (doc_id)) """


def _macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office.merged_macros(office.macro_projects(view(spark, sf_dir, "v_module"), most_modules=5))


@query("WITH " + _MACRO_SQL + "SELECT * FROM macros")
def o09_12_macro_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of a document merged; modules and their sources are read up to a limit, the last one in part."""
    return _macros(spark, sf_dir).withColumns({c: joined(c) for c in _LISTS})


@query("WITH " + _READ_SQL + "SELECT doc_id, is_package, stop, malformed, encrypted, array_to_string(list_sort(reasons), ',') AS reasons FROM reads")
def o14_read_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office.package_reads(view(spark, sf_dir, "v_package"), **_READ).withColumn("reasons", joined("reasons"))


_FOUND = lambda tests: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{code}' END" for t, code in zip(tests, office.CODES, strict=True)) + "], x -> x IS NOT NULL), ',')"
_CODES_SQL = _FOUND(("macro_on", "projects > 0", "triggers <> ''", "classes <> ''", "ext > 0", "tem > 0", "embedded > 0", "activex > 0", "encrypted", "malformed", "len(why) > 0"))
_PACKAGE_SQL = f"""WITH {_MACRO_SQL}, {_READ_SQL}, pc AS (SELECT doc_id, list(DISTINCT app) FILTER (app IS NOT NULL) AS apps, bool_or(app IS NOT NULL AND contains(lower(content_type), 'macroenabled')) AS mt, count(*) FILTER (regexp_matches(part_name, '^(word|xl|ppt)/embeddings/')) AS emb, count(*) FILTER (regexp_matches(part_name, '^(word|xl|ppt)/activeX/')) AS act,
      count(DISTINCT part_name) FILTER (contains(lower(content_type), 'vbaproject')) AS vp FROM (SELECT *, CASE WHEN part_name = 'word/document.xml' AND contains(content_type, 'wordprocessingml') THEN 'word' WHEN part_name = 'xl/workbook.xml' AND contains(content_type, 'spreadsheetml') THEN 'excel' END AS app FROM v_package) GROUP BY doc_id),
    pj AS (SELECT r.*, stop IS NULL AS whole, coalesce(apps, []) AS apps, mt, emb, act, greatest(vp, coalesce(m.projects, 0)) AS pn, coalesce(m.triggers, '') AS trg, coalesce(m.classes, '') AS cls, coalesce(m.reasons, '') AS mre, coalesce(l.external, 0) AS lx, coalesce(l.templates, 0) AS lt FROM reads r JOIN pc USING (doc_id) LEFT JOIN macros m USING (doc_id) LEFT JOIN v_link l USING (doc_id) WHERE is_package),
    pe AS (SELECT doc_id, CASE WHEN whole AND len(apps) = 1 THEN apps[1] ELSE 'unknown' END AS application, CASE WHEN whole THEN pn ELSE 0 END AS projects, whole AND (mt OR pn > 0) AS macro_on, CASE WHEN whole THEN emb ELSE 0 END AS embedded, CASE WHEN whole THEN act ELSE 0 END AS activex, CASE WHEN whole THEN lx ELSE 0 END AS ext, CASE WHEN whole THEN lt ELSE 0 END AS tem, CASE WHEN whole THEN trg ELSE '' END AS triggers,
      CASE WHEN whole THEN cls ELSE '' END AS classes, encrypted, malformed OR whole AND len(apps) <> 1 AS malformed, list_sort(list_distinct(list_concat(reasons, list_concat(CASE WHEN whole AND len(apps) <> 1 THEN ['inconsistent_package_structure'] ELSE [] END, CASE WHEN whole THEN list_filter(string_split(mre, ','), x -> x <> '') ELSE [] END)))) AS why FROM pj) """


@query(_PACKAGE_SQL + f"SELECT doc_id, 'OFFICE_' || upper(application) || '_OOXML' AS detected_type, {_CODES_SQL} AS findings, CASE WHEN malformed THEN 'MALFORMED' WHEN len(why) > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, array_to_string(why, ',') AS reasons FROM pe UNION ALL SELECT doc_id, NULL, 'handed to archives', NULL, NULL FROM reads WHERE NOT is_package")
def o13_office_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, handed = office.packages(office.package_evidence(view(spark, sf_dir, "v_package"), **_READ), view(spark, sf_dir, "v_link"), _macros(spark, sf_dir))
    nothing = F.lit(None).cast("string")
    return results.withColumns({"findings": joined("findings"), "reasons": joined("reasons")}).unionAll(handed.select("doc_id", nothing, F.lit("handed to archives"), nothing, nothing))


_OLE_SQL = f"""WITH {_MACRO_SQL}, oe AS (SELECT DISTINCT doc_id, family, lower(path) AS path, regexp_extract(lower(path), '([^/]*)$', 1) AS leaf FROM v_ole_entry),
    og AS (SELECT doc_id, CASE WHEN bool_or(path = 'worddocument') THEN 'word' WHEN bool_or(path IN ('workbook', 'book')) THEN 'excel' WHEN bool_or(path = 'powerpoint document') THEN 'powerpoint' ELSE 'unknown' END AS application, bool_or(leaf = 'encryptioninfo') AND bool_or(leaf = 'encryptedpackage') AS encrypted, count(*) FILTER (leaf IN ('ole10native', 'package') OR starts_with(path, 'objectpool/')) AS embedded,
      count(*) FILTER (starts_with(path, 'ctls/') OR starts_with(path, 'activex/') OR contains(path, '/activex/')) AS activex, count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1)) FILTER (ends_with(path, '/dir') AND (starts_with(path, 'vba/') OR contains(path, '/vba/'))) AS vp FROM oe WHERE family = 'OLE_COMPOUND' GROUP BY doc_id),
    oj AS (SELECT og.*, application <> 'unknown' AND NOT encrypted AS readable, m.projects AS mn, m.triggers AS trg, m.classes AS cls, m.reasons AS mre FROM og LEFT JOIN macros m USING (doc_id)),
    ok AS (SELECT *, greatest(vp, CASE WHEN readable THEN coalesce(mn, 0) ELSE 0 END) AS projects, CASE WHEN readable THEN coalesce(trg, '') ELSE '' END AS triggers, CASE WHEN readable THEN coalesce(cls, '') ELSE '' END AS classes, 0 AS ext, 0 AS tem, false AS malformed,
      list_sort(list_concat(list_filter([CASE WHEN application = 'unknown' THEN 'ole_application_unclassified' END, CASE WHEN encrypted THEN 'office_encryption_prevents_inspection' END], x -> x IS NOT NULL), CASE WHEN readable THEN list_filter(string_split(coalesce(mre, ''), ','), x -> x <> '') ELSE [] END)) AS why FROM oj), oz AS (SELECT *, projects > 0 AS macro_on FROM ok) """


@query(_OLE_SQL + f"SELECT doc_id, 'OFFICE_' || upper(application) || '_OLE' AS detected_type, {_CODES_SQL} AS findings, CASE WHEN len(why) > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, array_to_string(why, ',') AS reasons FROM oz WHERE application <> 'unknown' OR encrypted OR macro_on")
def o13_15_compound_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents.compound_files(view(spark, sf_dir, "v_ole_entry"))
    return office.compounds(files, _macros(spark, sf_dir)).withColumns({"findings": joined("findings"), "reasons": joined("reasons")})
