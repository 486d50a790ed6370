"""Registered queries on page documents as graphs of objects and actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import pages, walks
from .queries import joined, query
from .views import view

#: Limits that the given tables reach in each way.
_TIGHT = walks.Limits(pages=4, objects=12, depth=3, actions=9, triggers=1 << 20)


def _walk_sql(x: walks.Limits) -> str:
    """Both walks as loops over a stack, documents side by side: the fields first, as their order gives starts to the actions."""
    return f"""WITH RECURSIVE o AS (SELECT * FROM v_object),
    kids AS (SELECT doc_id, parent_id, list(object_id ORDER BY object_id) AS kids FROM o WHERE kind = 'field' AND parent_id IS NOT NULL GROUP BY ALL),
    f AS (SELECT doc_id, CAST(0 AS BIGINT) AS nth, list({{'k': object_id, 'd': 0}} ORDER BY object_id) AS stack, CAST([] AS BIGINT[]) AS met, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS field, CAST(NULL AS VARCHAR) AS reason FROM o WHERE kind = 'field' AND parent_id IS NULL GROUP BY doc_id UNION ALL
      SELECT doc_id, nth + 1, CASE WHEN deep OR again THEN rest WHEN used >= {x.objects} THEN [] ELSE list_concat(rest, list_transform(coalesce(kids, []), q -> {{'k': q, 'd': top.d + 1}})) END, CASE WHEN deep OR again OR used >= {x.objects} THEN met ELSE list_append(met, top.k) END,
             CASE WHEN deep OR used >= {x.objects} THEN used ELSE used + 1 END, CASE WHEN NOT deep AND used < {x.objects} AND NOT again THEN top.k END, CASE WHEN deep THEN 'form_tree_depth_limit' WHEN used >= {x.objects} THEN 'custom_object_limit' END
      FROM (SELECT f.*, kids.kids, f.stack[-1] AS top, f.stack[1:len(f.stack) - 1] AS rest, f.stack[-1].d > {x.depth} AS deep, f.used < {x.objects} AND list_contains(f.met, f.stack[-1].k) AS again FROM f LEFT JOIN kids ON kids.doc_id = f.doc_id AND kids.parent_id = f.stack[-1].k WHERE len(f.stack) > 0)),
    fu AS (SELECT doc_id, max(used) AS used, list(field ORDER BY nth) FILTER (field IS NOT NULL) AS fields FROM f GROUP BY doc_id),
    pg AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY object_id) AS page_no FROM o WHERE kind = 'page'),
    an AS (SELECT o.*, page_no, row_number() OVER (PARTITION BY o.doc_id ORDER BY page_no, o.object_id) + coalesce(used, 0) AS spent FROM o JOIN pg ON pg.doc_id = o.doc_id AND pg.object_id = o.parent_id LEFT JOIN fu ON fu.doc_id = o.doc_id WHERE o.kind = 'annotation' AND page_no <= {x.pages}),
    stop AS (SELECT doc_id, min(page_no) AS last_page FROM an WHERE spent > {x.objects} GROUP BY doc_id),
    h AS (SELECT doc_id, object_id, 0 AS phase, 0 AS i, 0 AS j, 'OpenAction' AS source, a1, NULL AS t1, NULL AS t2 FROM o WHERE kind = 'open' UNION ALL SELECT doc_id, object_id, 1, 0, 0, 'Catalog', NULL, t1, t2 FROM o WHERE kind = 'catalog'
      UNION ALL SELECT doc_id, object_id, 2, object_id, 0, 'NameTree', a1, NULL, NULL FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY object_id) AS nn FROM o WHERE kind = 'name') WHERE nn <= {x.actions} UNION ALL SELECT doc_id, object_id, 3, 0, 0, 'AcroForm', NULL, t1, t2 FROM o WHERE kind = 'acroform'
      UNION ALL SELECT doc_id, object_id, 4, f.nth, 0, 'FormField', a1, t1, t2 FROM f JOIN o USING (doc_id) WHERE o.object_id = f.field UNION ALL SELECT doc_id, object_id, 5, page_no, 0, 'Page', a1, t1, t2 FROM pg LEFT JOIN stop USING (doc_id) WHERE page_no <= least({x.pages}, coalesce(last_page, 1000000))
      UNION ALL SELECT doc_id, object_id, 5, page_no, object_id, 'Annotation', a1, t1, t2 FROM an WHERE spent <= {x.objects}
      UNION ALL SELECT doc_id, object_id, 6, object_id, 0, 'Object', CASE WHEN kind = 'action' THEN object_id ELSE a1 END, t1, t2 FROM o WHERE object_id <= {x.objects}),
    h1 AS (SELECT *, t1 IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, object_id, t1 IS NOT NULL ORDER BY phase, i, j) = 1 AS held FROM h),
    g AS (SELECT doc_id, phase, i, j, 0 AS k, a1 AS a, source FROM h1 WHERE a1 IS NOT NULL UNION ALL SELECT doc_id, phase, i, j, 1, t1, source || 'AA' FROM h1 WHERE held UNION ALL SELECT doc_id, phase, i, j, 2, t2, source || 'AA' FROM h1 WHERE held),
    acts AS (SELECT doc_id, object_id, list_filter([n2, n1], q -> q IS NOT NULL) AS nexts FROM o WHERE kind = 'action'),
    w AS (SELECT doc_id, CAST(0 AS BIGINT) AS nth, list({{'k': a, 'd': 0, 's': source}} ORDER BY phase DESC, i DESC, j DESC, k DESC) AS stack, CAST([] AS BIGINT[]) AS met, CAST(NULL AS BIGINT) AS action_id, CAST(NULL AS INTEGER) AS depth, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS reason FROM g GROUP BY doc_id UNION ALL
      SELECT doc_id, nth + 1, CASE WHEN go THEN list_concat(rest, list_transform(nexts, q -> {{'k': q, 'd': top.d + 1, 's': top.s}})) ELSE rest END, CASE WHEN go THEN list_append(met, top.k) ELSE met END, CASE WHEN go THEN top.k END, CASE WHEN go THEN top.d END, CASE WHEN go THEN top.s END,
             CASE WHEN deep THEN 'action_depth_limit' WHEN fresh AND NOT go THEN 'action_node_limit' END
      FROM (SELECT *, fresh AND len(met) < {x.actions} AS go FROM (SELECT w.*, acts.nexts, w.stack[-1] AS top, w.stack[1:len(w.stack) - 1] AS rest, w.stack[-1].d > {x.depth} AS deep, w.stack[-1].d <= {x.depth} AND acts.nexts IS NOT NULL AND NOT list_contains(w.met, w.stack[-1].k) AS fresh
        FROM w LEFT JOIN acts ON acts.doc_id = w.doc_id AND acts.object_id = w.stack[-1].k WHERE len(w.stack) > 0))),
    visits AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS place, action_id, source, depth FROM w WHERE action_id IS NOT NULL) """


_WALK_SQL, _TIGHT_SQL = _walk_sql(walks.Limits()), _walk_sql(_TIGHT)


def _inspected(spark: SparkSession, sf_dir: str, limits: walks.Limits) -> DataFrame:
    both = lambda *xs: F.array_compact(F.array(*xs))
    trigger = lambda name, at: F.struct(F.lit(name).alias("trigger"), F.col(at).alias("action"))
    objects = view(spark, sf_dir, "v_object")
    return walks.inspect(objects.select("doc_id", "object_id", "kind", "parent_id", both("a1").alias("a"), F.when(F.col("t1").isNotNull(), F.array(trigger("O", "t1"), trigger("C", "t2"))).alias("aa"), both("n1", "n2").alias("next"), "subtype"), limits)


@query(_TIGHT_SQL + "SELECT * FROM visits")
def p02_action_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches meet again and run in circles; each action costs one visit, at the place where it is met first."""
    return walks.visited_actions(_inspected(spark, sf_dir, _TIGHT))


@query(_WALK_SQL + """, s AS (SELECT doc_id, count(*) FILTER (held) AS holders FROM h1 GROUP BY doc_id), c AS (SELECT v.doc_id, string_agg(DISTINCT v.source, ',' ORDER BY v.source) FILTER (o.subtype = 'JavaScript') AS script_sources, count(*) FILTER (o.subtype = 'JavaScript') AS scripts, count(*) FILTER (o.subtype = 'Launch') AS launches FROM visits v JOIN o ON o.doc_id = v.doc_id AND o.object_id = v.action_id GROUP BY v.doc_id)
    SELECT s.doc_id, holders, 2 * holders AS triggers_visited, coalesce(script_sources, '') AS script_sources, coalesce(scripts, 0) AS scripts, coalesce(launches, 0) AS launches FROM s LEFT JOIN c USING (doc_id)""")
def p03_04_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts by where they were met, launches, additional-action holders with their triggers."""
    inspected = _inspected(spark, sf_dir, walks.Limits(triggers=1 << 20))
    scripts = F.filter("visited", lambda v: v["subtype"] == "JavaScript")
    sources = F.array_sort(F.array_distinct(F.transform(scripts, lambda v: v["source"])))
    return inspected.select("doc_id", "holders", "triggers_visited", joined(sources).alias("script_sources"), walks.visits_of("JavaScript").alias("scripts"), walks.visits_of("Launch").alias("launches"))


@query(_TIGHT_SQL + "SELECT o.doc_id, coalesce(array_to_string(any_value(fields), ','), '') AS fields, coalesce(any_value(used), 0) AS spent_on_fields FROM o LEFT JOIN fu USING (doc_id) GROUP BY o.doc_id")
def p12_form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in the order of the visit, under the budget that annotations share."""
    rows = _inspected(spark, sf_dir, _TIGHT)
    return rows.select("doc_id", F.array_join(F.col("fields").cast("array<string>"), ",").alias("fields"), (F.col("custom_objects") - F.col("annotations")).alias("spent_on_fields"))


_WHY_SQL = f""", why AS (SELECT doc_id, reason FROM f WHERE reason IS NOT NULL UNION SELECT doc_id, reason FROM w WHERE reason IS NOT NULL UNION SELECT doc_id, 'custom_object_limit' FROM an WHERE spent > {_TIGHT.objects} UNION SELECT doc_id, 'page_limit' FROM pg WHERE page_no > {_TIGHT.pages}
      UNION SELECT doc_id, 'indirect_object_limit' FROM o GROUP BY doc_id HAVING count(*) > {_TIGHT.objects} UNION SELECT doc_id, 'javascript_name_tree_limit' FROM o WHERE kind = 'name' GROUP BY doc_id HAVING count(*) > {_TIGHT.actions}) """


@query(_TIGHT_SQL + _WHY_SQL + f"""SELECT doc_id, (SELECT count(*) FROM h WHERE h.doc_id = d.doc_id AND source = 'Page') AS pages, (SELECT count(*) FROM an WHERE an.doc_id = d.doc_id AND spent <= {_TIGHT.objects}) AS annotations, least(n, {_TIGHT.objects}) AS objects,
           coalesce((SELECT string_agg(DISTINCT reason, ',' ORDER BY reason) FROM why WHERE why.doc_id = d.doc_id), '') AS reasons FROM (SELECT doc_id, count(*) AS n FROM o GROUP BY doc_id) d""")
def p10_15_object_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indirect objects, inspected objects, pages and actions have limits of their own; one budget is spent in visiting order."""
    return _inspected(spark, sf_dir, _TIGHT).select("doc_id", "pages", "annotations", "objects", joined("reasons").alias("reasons"))


_TARGET = "CASE WHEN doc_id % 3 = 0 THEN concat('HTTP://Host', action_id % 9, '.Example.com:80/p?q=', action_id) WHEN doc_id % 3 = 1 THEN concat('mailto:a', action_id) ELSE NULL END"


@query(_WALK_SQL + f""", t AS (SELECT v.doc_id, v.place, {_TARGET.replace("action_id", "v.action_id").replace("doc_id %", "v.doc_id %")} AS target, row_number() OVER (PARTITION BY v.doc_id ORDER BY v.place) AS nth FROM visits v JOIN o ON o.doc_id = v.doc_id AND o.object_id = v.action_id WHERE o.subtype = 'URI')
    SELECT doc_id, max(nth) AS links, string_agg(CASE WHEN nth <= 2 THEN CASE WHEN target IS NULL THEN 'missing' ELSE lower(regexp_extract(target, '^([A-Za-z]+):', 1)) || '|' || lower(regexp_extract(target, '//([^:/]+)', 1)) END END, ' ' ORDER BY nth) AS targets, max(nth) > 2 AS capped,
           CASE WHEN max(nth) > 3 THEN 'uri_action_limit' ELSE '' END AS reasons FROM t GROUP BY doc_id""")
def p05_uri_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of the links that are visited first, by scheme and host; more of them are counted."""
    inspected = _inspected(spark, sf_dir, walks.Limits(triggers=1 << 20))
    links = walks.visited_actions(inspected, "subtype").where("subtype = 'URI'").withColumn("target", F.expr(_TARGET))
    return walks.link_targets(links, most_kept=2, most_links=3).withColumn("targets", F.array_join(F.transform("targets", lambda t: F.when(t["parse_status"] == "missing", "missing").otherwise(F.concat_ws("|", F.coalesce(t["scheme"], F.lit("")), F.coalesce(t["hostname"], F.lit(""))))), " ")).withColumn("reasons", joined("reasons"))


_SUBMITTED = "doc_id % 3 < 2"


@query(_TIGHT_SQL + _WHY_SQL + f""", c AS (SELECT v.doc_id, count(*) FILTER (o.subtype = 'JavaScript') AS scripts, count(*) FILTER (o.subtype = 'Launch') AS launches, count(*) FILTER (o.subtype = 'URI') AS links, count(*) FILTER (o.subtype = 'SubmitForm') AS forms FROM visits v JOIN o ON o.doc_id = v.doc_id AND o.object_id = v.action_id GROUP BY v.doc_id),
    k AS (SELECT doc_id, count(*) FILTER (held) AS holders FROM h1 GROUP BY doc_id), d AS (SELECT doc_id, count(*) FILTER (kind = 'open' AND a1 IS NOT NULL) > 0 AS opens, count(*) FILTER (kind = 'acroform') > 0 AS form FROM o GROUP BY doc_id), r AS (SELECT doc_id, count(*) AS n FROM why GROUP BY doc_id)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN scripts > 0 THEN 'PDF_JAVASCRIPT' END, CASE WHEN opens THEN 'PDF_OPEN_ACTION' END, CASE WHEN holders > 0 THEN 'PDF_ADDITIONAL_ACTION' END, CASE WHEN launches > 0 THEN 'PDF_LAUNCH_ACTION' END, CASE WHEN doc_id % 4 > 0 THEN 'PDF_EMBEDDED_FILE' END, CASE WHEN form THEN 'PDF_ACROFORM' END, CASE WHEN form AND doc_id % 20 = 0 THEN 'PDF_XFA' END,
        CASE WHEN links > 0 THEN 'PDF_EXTERNAL_URI' END, CASE WHEN forms > 0 AND {_SUBMITTED} THEN 'PDF_EXTERNAL_SUBMISSION' END, CASE WHEN doc_id % 9 = 0 THEN 'PDF_ENCRYPTED' END, CASE WHEN doc_id % 12 = 0 THEN 'PDF_MALFORMED' END, CASE WHEN n > 0 THEN 'PDF_PARTIAL_ANALYSIS' END, CASE WHEN doc_id % 24 = 0 THEN 'PDF_FALLBACK_INDICATOR' END], x -> x IS NOT NULL), ',') AS findings,
      CASE WHEN doc_id % 12 = 0 THEN 'MALFORMED' WHEN n > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)""")
def p11_page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    inspected = _inspected(spark, sf_dir, _TIGHT)
    counts = {"scripts": "JavaScript", "launches": "Launch", "links": "URI", "external_forms": "SubmitForm"}
    rows = inspected.select("doc_id", F.col("holders").alias("additional"), "reasons", (F.col("open_actions") > 0).alias("open_action"), (F.col("forms") > 0).alias("acroform"), *[walks.visits_of(subtype).alias(c) for c, subtype in counts.items()])
    d = F.col("doc_id")
    flags = {"embedded": d % 4, "xfa": F.col("acroform") & (d % 20 == 0), "encrypted": d % 9 == 0, "malformed": d % 12 == 0, "fallback": d % 24 == 0, "external_forms": F.when(F.expr(_SUBMITTED), F.col("external_forms"))}
    return pages.result(rows.withColumns(flags)).select("doc_id", joined("findings").alias("findings"), "status")
