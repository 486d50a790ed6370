"""The registered queries of the triage jobs, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import archive, evaluate, limits, policy, rules
from . import dims
from .views import duck, members_by_root, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL of its result."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = duck(sql)
        return f

    return add


def joined(c: Column | str) -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, ",")


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_BASE = r"list_extract(string_split(regexp_replace(replace({}, '\', '/'), '/+$', ''), '/'), -1)"
_SEG = "string_split(lower(" + _BASE + "), '.')"
_ODD = "[\\p{C}" + dims.BIDI + "]"


# Names -------------------------------------------------------------------------------------------


@query(f"""
    WITH s AS (SELECT scan_id, filename, {_BASE.format("filename")} AS base, {_SEG.format("filename")} AS seg FROM v_scan)
    SELECT scan_id, list_aggregate(seg, 'string_agg', ',') AS segments, CASE WHEN len(seg) > 1 THEN seg[-1] END AS extension,
           coalesce(len(seg) >= 3 AND seg[-1] IN {_IN(dims.DANGEROUS)} AND list_has_any(seg[2:-2], {_LIST(dims.BUSINESS)}), false) AS double_extension,
           CASE WHEN contains(filename, '‮') THEN 'U+202E' ELSE '' END AS bidi,
           CASE WHEN strpos(ltrim(base, '.'), '.') > 0 THEN seg[-1] END AS catalog_extension FROM s""")
def n01_05_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("filename")
    return view(spark, sf_dir, "v_scan").select("scan_id", joined(names.segments(f)).alias("segments"), names.final_extension(f).alias("extension"), names.double_extension(f).alias("double_extension"), joined(names.bidi_marks(f)).alias("bidi"), names.catalog_extension(f).alias("catalog_extension"))


@query(f"""
    SELECT scan_id, substr(regexp_replace(regexp_replace(trim(regexp_replace(nfc_normalize(filename), '[\\x00-\\x1F\\x7F]', '', 'g')), '[{dims.BIDI}]', '', 'g'), '[/\\\\]', '_', 'g'), 1, 255) AS display,
           nullif(lower(trim(string_split(claimed, ';')[1])), '') AS mime, nullif(substr(trim(claimed), 1, 255), '') AS content_type,
           regexp_replace(filename, '[{dims.BIDI}]', '', 'g') AS safe, replace(filename, '‮', '\\u202e') AS escaped, false AS key_ok,
           CASE WHEN regexp_matches(lower(trim(source)), '^[a-z0-9._#-]{{3,64}}$') THEN lower(trim(source)) END AS username, 'source:' || SHA(source) AS digest FROM v_scan""")
def n06_17_name_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, c = F.col("filename"), F.col("claimed")
    return view(spark, sf_dir, "v_scan").select("scan_id", names.display_name(f).alias("display"), names.mime_type(c).alias("mime"), names.content_type(c).alias("content_type"), names.bounded(f, 255).alias("safe"), names.escaped_member(f).alias("escaped"), names.storage_key_ok(F.col("digest")).alias("key_ok"), names.username(F.col("source")).alias("username"), names.keyed_digest("source", F.col("source")).alias("digest"))


@query(r"""
    SELECT container_id, ordinal, CASE WHEN starts_with(replace(name, '\', '/'), '/') THEN '/' ELSE '' END || coalesce(list_aggregate(list_filter(string_split(replace(nfc_normalize(name), '\', '/'), '/'), p -> p NOT IN ('', '.')), 'string_agg', '/'), '') AS key FROM v_member""")
def n09_collision_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_member").select("container_id", "ordinal", names.collision_key(F.col("name")).alias("key"))


# Identity ----------------------------------------------------------------------------------------

_FAMILY = "CASE scan_id % 6 WHEN 0 THEN 'PDF' WHEN 1 THEN 'ZIP' WHEN 2 THEN 'TEXT' WHEN 3 THEN 'WINDOWS_EXECUTABLE' WHEN 4 THEN CASE WHEN scan_id % 4 = 0 THEN 'OLE_COMPOUND' ELSE 'UNKNOWN' END ELSE 'OOXML_CANDIDATE' END"


def _identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = view(spark, sf_dir, "v_scan")
    expected = spark.createDataFrame([(k, v.split(",")) for k, v in dims.EXPECTED_FAMILIES.items()], "extension string, families array<string>")
    rows = scans.withColumns({"family": names.family(F.col("mime"), F.col("description")), "extension": names.final_extension(F.col("filename")), "claim": names.mime_type(F.col("claimed"))})
    return rows.join(F.broadcast(expected), "extension", "left")


@query(f"""
    WITH s AS (SELECT *, {_FAMILY} AS family, {_SEG.format("filename")} AS seg FROM v_scan), t AS (SELECT *, CASE WHEN len(seg) > 1 THEN seg[-1] END AS extension FROM s),
    e(ext, families) AS ({dims.sql_values(list(dims.EXPECTED_FAMILIES.items()))})
    SELECT scan_id, family, family <> 'UNKNOWN' AS supported,
           coalesce(len(seg) >= 3 AND extension IN {_IN(dims.DANGEROUS)} AND list_has_any(seg[2:-2], {_LIST(dims.BUSINESS)}), false) AS double_extension, contains(filename, '‮') AS bidi,
           coalesce(NOT list_contains(string_split(families, ','), family), false) AS type_mismatch, coalesce(family = 'WINDOWS_EXECUTABLE' AND extension IN {_IN(dims.BUSINESS)}, false) AS masquerade,
           coalesce(nullif(lower(trim(string_split(claimed, ';')[1])), '') NOT IN ('application/octet-stream', lower(mime)), false) AS mime_mismatch
    FROM t LEFT JOIN e ON ext = extension""")
def i01_09_identity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.coalesce
    no = F.lit(False)
    return _identity(spark, sf_dir).select(
        "scan_id", "family", (F.col("family") != "UNKNOWN").alias("supported"), f(names.double_extension(F.col("filename")), no).alias("double_extension"), (F.size(names.bidi_marks(F.col("filename"))) > 0).alias("bidi"),
        f(~F.array_contains("families", F.col("family")), no).alias("type_mismatch"), f((F.col("family") == "WINDOWS_EXECUTABLE") & F.col("extension").isin(*dims.BUSINESS), no).alias("masquerade"),
        f(F.col("claim").isNotNull() & (F.col("claim") != "application/octet-stream") & (F.col("claim") != F.lower("mime")), no).alias("mime_mismatch"),
    )


# Policy ------------------------------------------------------------------------------------------

_POLICY_SQL = f"""
    WITH dim(code, severity, family, points, floor, hard_block, techniques, explanation) AS ({dims.sql_values(dims.finding_rows())}),
    comp(name, points, floor, required) AS ({dims.sql_values(dims.compound_rows())}),
    codes AS (SELECT DISTINCT scan_id, code FROM v_finding),
    own AS (SELECT scan_id, bool_or(points IS NULL) AS unknown, sum(points) AS p, list(code) FILTER (hard_block) AS hard, list(code) FILTER (floor = 'QUARANTINE') AS floors, list(codes.code) AS codes, list(codes.code || '=' || points) FILTER (points IS NOT NULL) AS contrib,
                   bool_or(ends_with(code, '_PARTIAL_ANALYSIS') OR ends_with(code, '_MALFORMED')) AS partial FROM codes LEFT JOIN dim USING (code) GROUP BY scan_id),
    hits AS (SELECT scan_id, name, points, floor FROM own, comp WHERE list_has_all(codes, string_split(required, ','))),
    tog AS (SELECT scan_id, sum(points) AS p, list(name) AS names, list(name || '=' || points) AS contrib FROM hits GROUP BY scan_id),
    rows AS (SELECT s.scan_id, coalesce(unknown, false) AS unknown, least(100, coalesce(own.p, 0) + coalesce(tog.p, 0)) AS score, coalesce(hard, []) AS hard, coalesce(floors, []) AS floors, coalesce(codes, []) AS codes, coalesce(names, []) AS names,
             list_concat(coalesce(own.contrib, []), coalesce(tog.contrib, [])) AS contrib,
             list_filter([CASE WHEN status IS NULL THEN 'POLICY_ANALYSIS_RESULT_MISSING' END, CASE WHEN status IN ('FAILED', 'TIMEOUT', 'UNSUPPORTED') THEN 'POLICY_ANALYSIS_STATUS_' || status END,
                CASE WHEN status IS NOT NULL AND coalesce(detected_type, '') NOT IN {_IN(dims.SUPPORTED_TYPES)} THEN 'POLICY_UNSUPPORTED_DETECTED_TYPE' END, CASE WHEN status = 'SUCCESS' AND partial THEN 'POLICY_ANALYSIS_CONTRADICTION' END,
                CASE WHEN failure_code IS NOT NULL THEN 'POLICY_ANALYSIS_FAILURE' END, CASE WHEN state NOT IN ('ANALYZING', 'COMPLETED') THEN 'POLICY_LIFECYCLE_INCONSISTENCY' END], x -> x IS NOT NULL) AS inc
             FROM v_scan s LEFT JOIN own USING (scan_id) LEFT JOIN tog USING (scan_id)),
    d AS (SELECT *, list_distinct(list_concat(floors, names, inc)) AS mandatory FROM rows),
    e AS (SELECT *, CASE WHEN unknown THEN 'QUARANTINE' WHEN len(hard) > 0 THEN 'BLOCK' WHEN len(mandatory) > 0 OR score >= 40 THEN 'QUARANTINE' WHEN score >= 20 THEN 'REVIEW' ELSE 'ALLOW' END AS decision FROM d),
    evaluation AS (SELECT scan_id, CASE WHEN unknown THEN 0 ELSE CAST(score AS INT) END AS score, CASE WHEN unknown OR score < 20 THEN 'LOW' WHEN score < 40 THEN 'MODERATE' WHEN score < 70 THEN 'HIGH' ELSE 'CRITICAL' END AS band, decision, decision = 'ALLOW' AS release_eligible, NOT unknown AND len(inc) = 0 AS complete,
        CASE WHEN unknown THEN '' ELSE array_to_string(list_sort(hard), ',') END AS hard_block_reasons, CASE WHEN unknown THEN 'POLICY_EVALUATION_FAILURE' ELSE array_to_string(list_sort(mandatory), ',') END AS mandatory_reasons,
        CASE WHEN unknown THEN '' ELSE array_to_string(list_sort(names), ',') END AS compounds, CASE WHEN unknown THEN 'POLICY_EVALUATION_FAILURE' ELSE array_to_string(list_sort(list_distinct(list_concat(codes, names, inc))), ',') END AS reasons,
        CASE WHEN unknown THEN '' ELSE array_to_string(list_sort(contrib), ',') END AS contributions FROM e) """


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.evaluate(view(spark, sf_dir, "v_scan"), view(spark, sf_dir, "v_finding"), dims.finding_dim(spark), dims.compound_dim(spark))


@query(_POLICY_SQL + "SELECT * FROM evaluation")
def d01_12_policy_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ("hard_block_reasons", "mandatory_reasons", "compounds", "reasons", "contributions")
    return evaluated(spark, sf_dir).withColumns({c: joined(c) for c in lists})


@query(f"WITH dim(code, severity, family, points, floor, hard_block, techniques, explanation) AS ({dims.sql_values(dims.finding_rows())}) SELECT scan_id, count(*) AS n, sum(points) AS row_points FROM v_finding LEFT JOIN dim USING (code) GROUP BY scan_id")
def d14_row_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.weigh_findings(view(spark, sf_dir, "v_finding"), dims.finding_dim(spark)).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score_delta").alias("row_points"))


@query(_POLICY_SQL + "SELECT decision, band, count(*) AS n FROM evaluation GROUP BY decision, band")
def q06_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).groupBy("decision", "band").count().withColumnRenamed("count", "n")


# Archives ----------------------------------------------------------------------------------------

_MARKED_SQL = rf"""
    WITH k AS (SELECT *, replace(name, '\', '/') AS n, CASE WHEN starts_with(replace(name, '\', '/'), '/') THEN '/' ELSE '' END || coalesce(list_aggregate(list_filter(string_split(replace(nfc_normalize(name), '\', '/'), '/'), p -> p NOT IN ('', '.')), 'string_agg', '/'), '') AS key, {_SEG.format("name")} AS seg FROM v_member),
    m AS (SELECT *, list_contains(string_split(n, '/'), '..') AS traversal, starts_with(n, '/') OR regexp_matches(name, '^[A-Za-z]:[\\/]') AS rooted, row_number() OVER w AS occ, first_value(name) OVER w AS first_name,
          coalesce(len(seg) > 1 AND seg[-1] IN {_IN(dims.DANGEROUS)}, false) AS dangerous, coalesce(len(seg) >= 3 AND seg[-1] IN {_IN(dims.DANGEROUS)} AND list_has_any(seg[2:-2], {_LIST(dims.BUSINESS)}), false) AS double_extension, contains(name, '‮') AS bidi,
          CASE WHEN is_dir THEN 'directory' WHEN create_system = 3 AND ((external_attr >> 16) & 61440) = 40960 THEN 'symlink' WHEN flag_bits & 1 = 1 THEN 'encrypted' WHEN compress_type NOT IN (0, 8, 12, 14) THEN 'unsupported' ELSE 'read' END AS what
          FROM k WINDOW w AS (PARTITION BY container_id, key ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) """


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.name_marks(view(spark, sf_dir, "v_member"))


@query(_MARKED_SQL + "SELECT container_id, ordinal, traversal, rooted, CASE WHEN occ > 1 THEN first_name END AS collides_with, CASE WHEN occ > 1 THEN CASE WHEN name = first_name THEN 'exact' ELSE 'portable_normalized' END END AS collision_kind, dangerous, double_extension, bidi, what FROM m")
def a01_10_member_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("container_id", "ordinal", "traversal", "rooted", "collides_with", "collision_kind", "dangerous", "double_extension", "bidi", archive.disposition().alias("what"))


def _visit_sql(limits: archive.Limits) -> str:
    """One row of each root at a time, in the order of the paths; the state is what the budgets need."""
    return _MARKED_SQL.replace("WITH k", "WITH RECURSIVE k", 1) + f""",
    p AS (SELECT root_id, container_id, 0 AS depth, CAST([] AS BIGINT[]) AS path, bytes, malformed FROM v_container WHERE parent_id IS NULL UNION ALL
      SELECT c.root_id, c.container_id, p.depth + 1, list_append(p.path, c.parent_ordinal), c.bytes, c.malformed FROM p JOIN v_container c ON c.parent_id = p.container_id WHERE p.depth < {limits.depth}),
    e0 AS (SELECT m.*, p.depth, list_append(p.path, m.ordinal) AS ord, m.actual_bytes AS size, c.container_id AS child, c.sha AS child_sha, false AS malformed, false AS crowded FROM m JOIN p USING (root_id, container_id)
        LEFT JOIN v_container c ON c.parent_id = m.container_id AND c.parent_ordinal = m.ordinal WHERE m.ordinal <= {limits.entries} UNION ALL BY NAME
      SELECT root_id, container_id, 0 AS ordinal, depth, list_append(path, 0) AS ord, bytes AS size, 'container' AS what, malformed, EXISTS (SELECT 1 FROM m WHERE m.container_id = p.container_id AND m.ordinal > {limits.entries}) AS crowded FROM p),
    e AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY ord, name) AS nth FROM e0),
    r AS (SELECT DISTINCT root_id, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS inspected, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS considered, CAST(0 AS BIGINT) AS nested, CAST([] AS VARCHAR[]) AS seen, CAST([] AS BIGINT[]) AS live, CAST(-1 AS BIGINT) AS pending,
        CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS reason, CAST(0 AS BIGINT) AS read_bytes FROM e UNION ALL
      SELECT root_id, nth, inspected + CAST(insp AS BIGINT), total + took, considered + CASE WHEN head THEN size ELSE 0 END,
             nested + CASE WHEN NOT rd OR child IS NULL THEN 0 WHEN breach IS NULL THEN took ELSE greatest(0, least(took, 4 + (took - 5) // 65536 * 65536)) END,
             CASE WHEN descend THEN list_append(seen, child_sha) ELSE seen END,
             CASE WHEN head AND verdict = 'opened' THEN list_append(live, container_id) WHEN verdict IN ('left', 'stopped') THEN list_filter(live, x -> x <> container_id) ELSE live END,
             CASE WHEN descend THEN child ELSE pending END, verdict,
             CASE WHEN verdict = 'opened' AND crowded OR breach IS NOT NULL OR over_c OR over_m THEN 'resource' WHEN head AND malformed THEN 'malformed' WHEN verdict IN ('encrypted', 'unsupported', 'too_deep') THEN 'partial' END,
             CASE WHEN over_c THEN 'compressed_input_limit' WHEN head AND malformed THEN CASE WHEN depth > 0 THEN 'malformed_nested_archive' ELSE 'malformed_archive' END WHEN verdict = 'opened' AND crowded THEN 'zip_entry_limit' WHEN over_m THEN 'member_inspection_limit'
                  WHEN verdict = 'encrypted' THEN 'encrypted_member' WHEN verdict = 'unsupported' THEN 'unsupported_compression_method' WHEN verdict = 'too_deep' THEN 'nesting_depth_limit' ELSE breach END, took
      FROM (SELECT *, verdict = 'nested' AS descend FROM (SELECT *, CASE WHEN over_c OR over_m OR head AND malformed THEN 'left' WHEN head THEN 'opened' WHEN NOT insp THEN NULL WHEN NOT rd THEN what WHEN breach IS NOT NULL THEN 'stopped' WHEN child IS NULL THEN 'read'
              WHEN depth + 1 > {limits.depth} THEN 'too_deep' WHEN list_contains(seen, child_sha) THEN 'repeated' ELSE 'nested' END AS verdict
        FROM (SELECT *, CASE WHEN NOT rd THEN NULL WHEN took > {limits.member_bytes} THEN 'member_actual_byte_limit' WHEN total + took > {limits.total_bytes} THEN 'total_actual_byte_limit' WHEN child IS NOT NULL AND nested + took > {limits.nested_bytes} THEN 'nested_materialization_limit' END AS breach
        FROM (SELECT *, CASE WHEN rd THEN least(size, greatest(1, least({limits.member_bytes}, {limits.total_bytes} - total, CASE WHEN child IS NULL THEN {limits.total_bytes} ELSE {limits.nested_bytes} - nested END) + 1)) ELSE 0 END AS took
        FROM (SELECT *, head AND considered + size > {limits.compressed_bytes} AS over_c, mem AND inspected >= {limits.members} AS over_m, mem AND inspected < {limits.members} AS insp, mem AND inspected < {limits.members} AND what = 'read' AS rd
        FROM (SELECT e.root_id, e.nth, e.container_id, e.depth, e.what, e.size, e.child, e.child_sha, e.malformed, e.crowded, r.inspected, r.total, r.considered, r.nested, r.seen, r.live, r.pending,
              e.ordinal = 0 AND (e.depth = 0 OR e.container_id = r.pending) AS head, e.ordinal > 0 AND list_contains(r.live, e.container_id) AS mem FROM r JOIN e ON e.root_id = r.root_id AND e.nth = r.nth + 1))))))),
    v AS (SELECT e.*, r.verdict, r.kind, r.reason, r.read_bytes, e.ordinal > 0 AND r.verdict <> 'left' AS inspected FROM r JOIN e USING (root_id, nth) WHERE r.verdict IS NOT NULL) """


#: Limits that the given tables reach in each way.
_TIGHT = archive.Limits(entries=4, members=30, compressed_bytes=100 << 20, total_bytes=200 << 20, nested_bytes=40 << 20)
_VISIT_SQL, _TIGHT_SQL = _visit_sql(archive.Limits()), _visit_sql(_TIGHT)


#: Marks of names that findings are made of.
_SHOWN = ("traversal", "rooted", "collides_with", "dangerous", "double_extension", "bidi")


def _visited(spark: SparkSession, sf_dir: str, limits: archive.Limits = archive.Limits(), keep: tuple[str, ...] = ()) -> DataFrame:
    # members and paths both lie by root, and are joined by root and container where they are
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return archive.visit(archive.name_marks(members_by_root(spark, sf_dir)), view(spark, sf_dir, "v_container"), limits, keep)


@query(_TIGHT_SQL + "SELECT root_id, count(*) FILTER (inspected) AS inspected, count(*) FILTER (reason = 'zip_entry_limit') AS crowded, count(*) FILTER (reason = 'member_inspection_limit') AS left_at_members FROM v GROUP BY root_id")
def a11_entry_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _visited(spark, sf_dir, _TIGHT)
    return rows.groupBy("root_id").agg(F.count_if("inspected").alias("inspected"), F.count_if(F.col("reason") == "zip_entry_limit").alias("crowded"), F.count_if(F.col("reason") == "member_inspection_limit").alias("left_at_members"))


@query(_TIGHT_SQL + "SELECT container_id, ordinal, verdict, reason, read_bytes FROM v WHERE ordinal > 0")
def a12_byte_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visited(spark, sf_dir, _TIGHT).where("ordinal > 0").select("container_id", "ordinal", "verdict", "reason", "read_bytes")


@query(_TIGHT_SQL + "SELECT container_id, ordinal, depth, verdict, reason FROM v WHERE ordinal = 0 OR verdict IN ('nested', 'repeated', 'too_deep')")
def a13_15_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _visited(spark, sf_dir, _TIGHT).where("ordinal = 0 OR verdict IN ('nested', 'repeated', 'too_deep')")
    return rows.select("container_id", "ordinal", "depth", "verdict", "reason")


_EVIDENCE_SQL = ", ev AS (SELECT root_id, container_id, ordinal, nth AS place, f.rank AS rank, f.code AS code FROM (SELECT root_id, container_id, ordinal, nth, unnest(list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {{'rank': {k}, 'code': '{code}'}} END" for k, (cond, (code, _)) in enumerate(zip(("traversal", "rooted", "occ > 1", "dangerous", "double_extension", "bidi", "what = 'symlink'", "what = 'encrypted'", "verdict = 'too_deep'"), archive.CATEGORIES, strict=True))) + "], x -> x IS NOT NULL)) AS f FROM v WHERE inspected)) "


@query(_TIGHT_SQL + _EVIDENCE_SQL + """, a AS (SELECT *, row_number() OVER (PARTITION BY root_id, code ORDER BY place, rank) AS nth FROM ev), b AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY place, rank) AS nth_of_root FROM a WHERE nth <= CASE WHEN rank <= 2 THEN 16 ELSE 32 END)
    SELECT root_id, container_id, ordinal, code FROM b WHERE nth_of_root <= 32""")
def a16_retained_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.retained(archive.evidence(_visited(spark, sf_dir, _TIGHT, ("name", *_SHOWN)))).select("root_id", "container_id", "ordinal", "code")


_FOUND_SQL = _EVIDENCE_SQL + """, why AS (SELECT DISTINCT root_id, kind, reason FROM v WHERE reason IS NOT NULL), f AS (SELECT root_id, CASE WHEN rank = 6 THEN 1.5 ELSE rank END AS rank, code, count(*) AS n FROM ev WHERE rank < 8 GROUP BY ALL UNION ALL
      SELECT root_id, 100, 'ARCHIVE_NESTING_LIMIT', count(*) FROM why WHERE reason = 'nesting_depth_limit' GROUP BY root_id UNION ALL SELECT root_id, 101, 'ARCHIVE_RESOURCE_LIMIT', count(*) FROM why WHERE kind = 'resource' GROUP BY root_id UNION ALL
      SELECT root_id, 102, 'ARCHIVE_MALFORMED', count(*) FROM why WHERE kind = 'malformed' GROUP BY root_id UNION ALL SELECT root_id, 103, 'ARCHIVE_PARTIAL_ANALYSIS', count(*) FROM why GROUP BY root_id) """


@query(_VISIT_SQL + _FOUND_SQL + "SELECT root_id, code, n FROM f")
def a17_18_archive_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.findings(_visited(spark, sf_dir, keep=_SHOWN))


@query(_TIGHT_SQL + _FOUND_SQL + """, s AS (SELECT root_id FROM f GROUP BY root_id HAVING count(*) > 8), g AS (SELECT root_id, rank, code, n + CASE WHEN rank IN (101, 103) AND root_id IN (SELECT root_id FROM s) THEN 1 ELSE 0 END AS n FROM f
      UNION ALL SELECT root_id, 101, 'ARCHIVE_RESOURCE_LIMIT', 1 FROM s WHERE root_id NOT IN (SELECT root_id FROM f WHERE rank = 101) UNION ALL SELECT root_id, 103, 'ARCHIVE_PARTIAL_ANALYSIS', 1 FROM s WHERE root_id NOT IN (SELECT root_id FROM f WHERE rank = 103)),
    o AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY rank < 100, rank) AS nth FROM g) SELECT root_id, code, n FROM o WHERE nth <= 8""")
def a18_findings_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most eight findings a root, so that the cut shows."""
    return archive.findings(_visited(spark, sf_dir, _TIGHT, _SHOWN), most=8)


@query(_VISIT_SQL + """SELECT root_id, count(*) FILTER (verdict = 'opened') AS containers, count(*) FILTER (inspected) AS members, count(*) FILTER (inspected AND what = 'directory') AS directories, count(*) FILTER (inspected AND what = 'symlink') AS symlinks,
    count(*) FILTER (inspected AND what = 'encrypted') AS encrypted, count(*) FILTER (inspected AND what = 'unsupported') AS unsupported, count(*) FILTER (inspected AND what = 'read') AS "read", count(*) FILTER (inspected AND traversal) AS traversals, count(*) FILTER (inspected AND rooted) AS rooted,
    count(*) FILTER (inspected AND occ > 1) AS duplicates, count(*) FILTER (inspected AND dangerous) AS dangerous, count(*) FILTER (verdict IN ('nested', 'repeated', 'too_deep')) AS nested, count(*) FILTER (verdict = 'repeated') AS repeated, CAST(sum(read_bytes) AS BIGINT) AS bytes,
    coalesce(string_agg(DISTINCT compress_type::VARCHAR, ',') FILTER (inspected AND what = 'unsupported'), '') AS methods, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons,
    CASE WHEN coalesce(bool_or(kind = 'malformed'), false) THEN 'MALFORMED' WHEN count(reason) > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM v GROUP BY root_id""")
def a19_archive_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.status(_visited(spark, sf_dir, keep=(*_SHOWN, "compress_type")))


# Pattern rules -----------------------------------------------------------------------------------

_RULE_SQL = "WITH r(rule_id, string_id, regex, code, nth, needed) AS (" + dims.sql_values([(p.rule_id, p.string_id, ("(?i)" if p.nocase else "") + p.expression, p.code, k, sum(q.rule_id == p.rule_id for q in dims.RULES)) for k, p in enumerate(dims.RULES)]) + """),
    t AS (SELECT doc_id AS scan_id, r.*, doc_id % 7 = 3 AS wide, regexp_extract_all(text, regex) AS ms, string_split_regex(text, regex) AS gaps FROM documents JOIN r ON regexp_matches(text, regex)),
    z AS (SELECT *, list_transform(ms[1:16], x -> CASE WHEN wide THEN 2 * length(x) ELSE strlen(x) END) AS m, list_transform(gaps[1:16], x -> CASE WHEN wide THEN 2 * length(x) ELSE strlen(x) END) AS g FROM t),
    h AS (SELECT *, list_transform(range(1, len(m) + 1), i -> CAST(list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0) AS BIGINT)) AS offs FROM z),
    g AS (SELECT scan_id, rule_id, code, CAST(sum(len(ms)) AS BIGINT) AS match_count, list(string_id ORDER BY string_id) AS strings, list_sort(list_distinct(flatten(list(offs ORDER BY nth))[1:16])) AS offsets FROM h GROUP BY scan_id, rule_id, code, needed HAVING count(*) = needed) """


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes, one in seven as UTF-16."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("scan_id"), F.when(F.col("doc_id") % 7 == 3, F.encode("text", "UTF-16LE")).otherwise(F.col("text").cast("binary")).alias("content"))


@query(_RULE_SQL + "SELECT scan_id, rule_id, code, match_count, array_to_string(strings, ',') AS strings, array_to_string(offsets, ',') AS offsets FROM g")
def y01_02_rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.matches(_contents(spark, sf_dir), dims.RULES)
    return found.withColumns({"strings": joined("strings"), "offsets": F.array_join(F.col("offsets").cast("array<string>"), ",")})


def _limits_sql(most_rules: int, most_strings: int, most_instances: int, most_bytes: int) -> str:
    return _RULE_SQL + f""", def(rule_id, title, explanation, category, confidence) AS ({dims.sql_values(dims.RULE_DEFINITIONS)}),
    l AS (SELECT g.*, row_number() OVER (PARTITION BY scan_id ORDER BY rule_id) AS nth, count(*) OVER (PARTITION BY scan_id) AS rules, concat('{{"confidence_class":"', confidence, '","match_count":', least(match_count, {most_instances}), ',"offsets":[', array_to_string(offsets, ','), '],"rule_category":"', category, '","rule_explanation":"', explanation,
      '","rule_id":"', rule_id, '","rule_pack_sha256":"pack","rule_pack_version":"1","rule_title":"', title, '","scope":"TOP_LEVEL","string_ids":["', array_to_string(strings[1:{most_strings}], '","'), '"]}}') AS metadata FROM g JOIN def USING (rule_id)),
    b AS (SELECT *, sum(strlen(metadata)) OVER (PARTITION BY scan_id ORDER BY rule_id) AS bytes FROM l), k AS (SELECT *, nth <= {most_rules} AND coalesce(lag(bytes) OVER (PARTITION BY scan_id ORDER BY rule_id), 0) <= {most_bytes} AS looked FROM b),
    why AS (SELECT scan_id, 'matched_rule_limit' AS reason FROM k WHERE rules > {most_rules} UNION SELECT scan_id, 'string_identifier_limit' FROM k WHERE looked AND len(strings) > {most_strings} UNION SELECT scan_id, 'match_instance_limit' FROM k WHERE looked AND match_count > {most_instances}
      UNION SELECT scan_id, 'offset_limit' FROM k WHERE looked AND match_count > len(offsets) UNION SELECT scan_id, 'metadata_limit' FROM k WHERE looked AND bytes > {most_bytes}),
    w AS (SELECT scan_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM why GROUP BY scan_id), lim AS (SELECT k.*, nth <= {most_rules} AND bytes <= {most_bytes} AS kept, coalesce(reasons, '') AS reasons FROM k LEFT JOIN w USING (scan_id)) """


#: Limits that the given tables reach in each way.
_FEW = {"most_rules": 2, "most_strings": 1, "most_instances": 4, "most_bytes": 620}
_FEW_SQL = _limits_sql(*_FEW.values())


def _limited(spark: SparkSession, sf_dir: str, limits: dict) -> DataFrame:
    return rules.limits(rules.matches(_contents(spark, sf_dir), dims.RULES), dims.rule_definitions(spark), "1", "pack", **limits)


@query(_FEW_SQL + "SELECT scan_id, rule_id, least(match_count, 4) AS match_count, array_to_string(strings[1:1], ',') AS strings, sha256(metadata) AS metadata, kept, reasons FROM lim")
def y03_04_match_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _limited(spark, sf_dir, _FEW)
    return rows.select("scan_id", "rule_id", "match_count", joined("strings").alias("strings"), F.sha2("metadata", 256).alias("metadata"), "kept", joined("reasons").alias("reasons"))


@query(_limits_sql(32, 16, 4096, 12 << 10) + f""", dim(code, severity, family, points, floor, hard_block, techniques, explanation) AS ({dims.sql_values(dims.finding_rows())}), f AS (SELECT scan_id, code FROM lim WHERE kept UNION ALL SELECT DISTINCT scan_id, 'YARA_PARTIAL_ANALYSIS' FROM lim WHERE reasons <> '')
    SELECT code, severity, techniques, count(*) AS n FROM f JOIN dim USING (code) GROUP BY ALL""")
def y06_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings under the limits in use: a document with more matches than offsets are kept of is a partial one."""
    return rules.findings(_limited(spark, sf_dir, {}), dims.finding_dim(spark)).groupBy("code", "severity", "techniques").agg(F.count(F.lit(1)).alias("n"))


@query(_FEW_SQL + """SELECT doc_id AS scan_id, CASE WHEN coalesce(why, '') = '' THEN 'COMPLETE' ELSE 'PARTIAL' END AS status, coalesce(n, 0) AS matched_rules, coalesce(kept_n, 0) + CASE WHEN coalesce(why, '') = '' THEN 0 ELSE 1 END AS retained_findings, coalesce(why, '') AS reasons
    FROM documents LEFT JOIN (SELECT scan_id AS doc_id, count(*) AS n, count(*) FILTER (kept) AS kept_n, any_value(reasons) AS why FROM lim GROUP BY scan_id) USING (doc_id)""")
def y07_scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.status(_contents(spark, sf_dir), _limited(spark, sf_dir, _FEW)).withColumn("reasons", joined("reasons"))


# Limits and sessions -----------------------------------------------------------------------------


@query("SELECT event_id, count(*) OVER w AS offered, count(*) OVER w > 2 AS over FROM v_event WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)")
def t02_offered_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.offered_over_limit(view(spark, sf_dir, "v_event"), ["user_id", "event_type"], 21600, 2).select("event_id", "offered", "over")


@query(T01_SQL := """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS nth FROM v_event),
    r AS (SELECT user_id, event_type, nth, event_id, [us] AS kept, true AS accepted FROM e WHERE nth = 1 UNION ALL
      SELECT e.user_id, e.event_type, e.nth, e.event_id, CASE WHEN len(list_filter(r.kept, t -> t > e.us - 21600000000)) < 2 THEN list_append(list_filter(r.kept, t -> t > e.us - 21600000000), e.us) ELSE list_filter(r.kept, t -> t > e.us - 21600000000) END,
             len(list_filter(r.kept, t -> t > e.us - 21600000000)) < 2 FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.nth = r.nth + 1)
    SELECT event_id, accepted FROM r""")
def t01_accepted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.accepted(view(spark, sf_dir, "v_event"), ["user_id", "event_type"], 21600, 2).select("event_id", "accepted")


@query("""SELECT event_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS last_minute,
    sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS last_hour FROM v_event""")
def t04_failure_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.failure_density(view(spark, sf_dir, "v_event"), "user_id", F.col("event_type") == "click").select("event_id", "last_minute", "last_hour")


@query("""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS nth FROM v_event),
    r AS (SELECT user_id, nth, us, us AS began, CAST(1 AS BIGINT) AS session FROM e WHERE nth = 1 UNION ALL
      SELECT e.user_id, e.nth, e.us, CASE WHEN e.us - r.us >= 1800000000 OR e.us - r.began >= 28800000000 THEN e.us ELSE r.began END, r.session + CASE WHEN e.us - r.us >= 1800000000 OR e.us - r.began >= 28800000000 THEN 1 ELSE 0 END
      FROM r JOIN e ON e.user_id = r.user_id AND e.nth = r.nth + 1)
    SELECT user_id, session, min(us) AS start_us, max(us) AS end_us, count(*) AS events FROM r GROUP BY user_id, session""")
def t06_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.sessions(view(spark, sf_dir, "v_event"), "user_id")


@query("""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS nth FROM v_event),
    r AS (SELECT user_id, nth, event_id, us AS seen, us AS began, false AS valid FROM e WHERE nth = 1 UNION ALL
      SELECT e.user_id, e.nth, e.event_id, CASE WHEN NOT (e.us - r.seen < 1800000000 AND e.us - r.began < 28800000000) OR e.us - r.seen >= 300000000 THEN e.us ELSE r.seen END,
        CASE WHEN e.us - r.seen < 1800000000 AND e.us - r.began < 28800000000 THEN r.began ELSE e.us END, e.us - r.seen < 1800000000 AND e.us - r.began < 28800000000 FROM r JOIN e ON e.user_id = r.user_id AND e.nth = r.nth + 1)
    SELECT event_id, valid FROM r""")
def t05_session_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.session_checks(view(spark, sf_dir, "v_event"), "user_id").select("event_id", "valid")


@query(T05_SQL := f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY us, event_id) AS nth FROM v_session_event),
    r AS (SELECT DISTINCT actor_id, CAST(0 AS BIGINT) AS nth, CAST(-1 AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS valid, true AS active, CAST([] AS STRUCT(k BIGINT, began BIGINT, seen BIGINT, revoked BOOLEAN)[]) AS s FROM e UNION ALL
      SELECT actor_id, nth, event_id, CASE WHEN kind = 'use' THEN ok END, CASE kind WHEN 'activate' THEN true WHEN 'deactivate' THEN false ELSE active END,
             CASE WHEN kind = 'open' THEN list_append(rest, {{'k': session_id, 'began': us, 'seen': us, 'revoked': false}})
                  WHEN own IS NULL OR kind IN ('activate', 'deactivate') THEN s WHEN kind = 'revoke' THEN list_append(rest, {{'k': session_id, 'began': own.began, 'seen': own.seen, 'revoked': true}})
                  ELSE list_append(rest, {{'k': session_id, 'began': own.began, 'seen': CASE WHEN ok AND us - own.seen >= 300000000 THEN us ELSE own.seen END, 'revoked': NOT ok}}) END
      FROM (SELECT *, coalesce(NOT own.revoked AND us < own.began + 28800000000 AND us - own.seen < 1800000000 AND active, false) AS ok FROM (SELECT e.*, r.active, r.s, list_filter(r.s, x -> x.k = e.session_id)[1] AS own, list_filter(r.s, x -> x.k <> e.session_id) AS rest
        FROM r JOIN e ON e.actor_id = r.actor_id AND e.nth = r.nth + 1)))
    SELECT event_id, valid FROM r WHERE valid IS NOT NULL""")
def t05_revocable_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.session_validity(view(spark, sf_dir, "v_session_event"))


_IN_MINUTE = "x.t > us - 60000000"


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY us, event_id) AS nth FROM v_attempt),
    r AS (SELECT DISTINCT tenant, CAST(0 AS BIGINT) AS nth, CAST(-1 AS BIGINT) AS event_id, true AS allowed, CAST([] AS STRUCT(t BIGINT, k VARCHAR)[]) AS s, CAST([] AS STRUCT(t BIGINT, k VARCHAR)[]) AS u FROM e UNION ALL
      SELECT tenant, nth, event_id, ok, CASE WHEN ok AND NOT success THEN list_append(s, {{'t': us, 'k': source}}) ELSE s END,
             CASE WHEN ok AND NOT success THEN list_append(u, {{'t': us, 'k': username}}) WHEN ok THEN list_filter(u, x -> x.k <> username) ELSE u END
      FROM (SELECT *, len(own_s) < 3 AND len(own_u) < 3 AND len(list_filter(own_s, x -> {_IN_MINUTE})) < 2 AND len(list_filter(own_u, x -> {_IN_MINUTE})) < 2 AS ok
        FROM (SELECT *, list_filter(s, x -> x.k = source) AS own_s, list_filter(u, x -> x.k = username) AS own_u
          FROM (SELECT e.tenant, e.nth, e.event_id, e.us, e.source, e.username, e.success, list_filter(r.s, x -> x.t > e.us - 3600000000) AS s, list_filter(r.u, x -> x.t > e.us - 3600000000) AS u
            FROM r JOIN e ON e.tenant = r.tenant AND e.nth = r.nth + 1))))
    SELECT event_id, allowed FROM r WHERE nth > 0""")
def t03_login_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each username comes from several sources, and each source has several usernames; tenants only keep the SQL's recursion short."""
    return limits.login_throttle(view(spark, sf_dir, "v_attempt"), 2, 3)


@query("SELECT event_type, us // 3600000000 AS hour, count(*) AS n FROM v_event GROUP BY ALL")
def t10_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_event").groupBy("event_type", F.expr("us div 3600000000").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


# Evaluation --------------------------------------------------------------------------------------

_MATCH_SQL = """WITH l AS (SELECT * FROM v_result QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY run DESC) = 1), c AS (SELECT case_id, category, case_class, any_additional, fail_secure, list_filter(string_split(expected, ','), x -> x <> '') AS expected, list_filter(string_split(acceptable, ','), x -> x <> '') AS acceptable, string_split(decisions, ',') AS decisions,
    list_sort(list_distinct(list_filter(string_split(actual, ','), x -> x <> ''))) AS actual, decision, release_eligible, complete, worker_status, latency_ms, cdr_eligible, derived_release FROM v_case JOIN l USING (case_id)),
    m AS (SELECT *, list_filter(expected, x -> NOT list_contains(actual, x)) AS missing, CASE WHEN any_additional THEN [] ELSE list_filter(actual, x -> NOT list_contains(expected, x) AND NOT list_contains(acceptable, x)) END AS unexpected, CASE WHEN decision IS NOT NULL THEN list_contains(decisions, decision) END AS compliant,
    CASE WHEN complete IS NULL THEN NULL WHEN complete THEN 'COMPLETE' WHEN worker_status = 'TIMEOUT' THEN 'TIMEOUT' WHEN len(list_filter(actual, x -> ends_with(x, '_MALFORMED'))) > 0 THEN 'MALFORMED' WHEN len(list_filter(actual, x -> ends_with(x, '_RESOURCE_LIMIT'))) > 0 THEN 'RESOURCE_LIMIT'
      WHEN len(list_filter(actual, x -> regexp_matches(x, '(_ENCRYPTED|_PARTIAL_ANALYSIS|_NESTING_LIMIT)$'))) > 0 THEN 'PARTIAL' ELSE 'OTHER_FAIL_CLOSED' END AS cls FROM c) """


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.differences(evaluate.match(view(spark, sf_dir, "v_case"), view(spark, sf_dir, "v_result")))


@query(_MATCH_SQL + "SELECT case_id, array_to_string(missing, ',') AS missing, array_to_string(unexpected, ',') AS unexpected, compliant, cls AS completeness FROM m")
def e01_03_case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("case_id", joined("missing").alias("missing"), joined("unexpected").alias("unexpected"), "compliant", evaluate.completeness_class().alias("completeness"))


_RATE = lambda name, n, d: f"count(*) FILTER ({n}) AS {name}_n, count(*) FILTER ({d}) AS {name}_d, round(CASE WHEN count(*) FILTER ({d}) > 0 THEN count(*) FILTER ({n}) / count(*) FILTER ({d}) END, 6) AS {name}"


@query(_MATCH_SQL + "SELECT " + ", ".join(_RATE(*x) for x in (("risky_recall", "category = 'RISKY' AND len(expected) > 0 AND len(missing) = 0", "category = 'RISKY' AND len(expected) > 0"), ("benign_escalation", "category = 'BENIGN' AND decision IN ('REVIEW', 'QUARANTINE', 'BLOCK')", "category = 'BENIGN'"), ("benign_allow", "category = 'BENIGN' AND decision = 'ALLOW'", "category = 'BENIGN'"), ("compliance", "compliant", "true"), ("fail_secure", "fail_secure AND release_eligible = false", "fail_secure"), ("recovery", "cdr_eligible AND derived_release", "cdr_eligible"))) + """,
    CAST(sum(len(list_intersect(expected, actual))) AS BIGINT) AS finding_recall_n, CAST(sum(len(expected)) AS BIGINT) AS finding_recall_d, round(sum(len(list_intersect(expected, actual))) / sum(len(expected)), 6) AS finding_recall FROM m""")
def e04_14_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(_matched(spark, sf_dir))


@query(_MATCH_SQL + ", k AS (SELECT DISTINCT case_class FROM v_case) SELECT case_class, CAST(coalesce(sum(len(list_intersect(expected, actual))), 0) AS BIGINT) AS n, CAST(coalesce(sum(len(expected)), 0) AS BIGINT) AS d, count(case_id) AS cases FROM k LEFT JOIN m USING (case_class) GROUP BY case_class")
def e07_16_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = view(spark, sf_dir, "v_case").select("case_class").distinct()
    hits = F.size(F.array_intersect("expected", "actual"))
    return classes.join(_matched(spark, sf_dir), "case_class", "left").groupBy("case_class").agg(F.coalesce(F.sum(F.when(F.col("case_id").isNotNull(), hits)), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("case_id").isNotNull(), F.size("expected"))), F.lit(0)).alias("d"), F.count("case_id").alias("cases"))


@query("SELECT count(latency_ms) AS n, round(avg(latency_ms), 6) AS mean, median(latency_ms) AS median, min(latency_ms) AS low, max(latency_ms) AS high, quantile_disc(latency_ms, 0.95) AS p95 FROM v_result")
def e12_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(view(spark, sf_dir, "v_result"))


@query("""SELECT case_id, a.decision AS before, b.decision AS after, b.latency_ms - a.latency_ms AS latency_change, CASE WHEN a.case_id IS NULL THEN 'added' WHEN b.case_id IS NULL THEN 'removed' ELSE 'changed' END AS kind
    FROM v_result a FULL JOIN v_rerun b USING (case_id) WHERE a.case_id IS NULL OR b.case_id IS NULL OR a.decision IS DISTINCT FROM b.decision OR a.worker_status IS DISTINCT FROM b.worker_status""")
def e21_run_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.run_differences(view(spark, sf_dir, "v_result"), view(spark, sf_dir, "v_rerun"))
