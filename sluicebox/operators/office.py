"""Office documents as a whole: what is read of a package or compound file, merged macro evidence, findings and status.

Parts: doc_id, ordinal, part_name, content_type, bytes, flag_bits. Modules: doc_id, project, module_no, name,
source_bytes, kind, keyword, keyword_at (its first byte in the source). Sums and orders are windows by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import dims
from .documents import MAIN_PARTS

#: What is read of a package, and of macros.
MOST_PARTS, MOST_NAME, MOST_XML, XML_BYTES, PART_BYTES, TOTAL_BYTES = 4096, 512, 256, 4 << 20, 8 << 20, 64 << 20
MOST_PROJECTS, MOST_MODULES, SOURCE_BYTES, MOST_NAMES, MOST_OBJECTS = 8, 128, 4 << 20, 64, 256
CONTENT_TYPES = "[Content_Types].xml"
#: Findings in their order.
CODES = (
    "OFFICE_MACRO_ENABLED", "OFFICE_VBA_MACRO", "OFFICE_VBA_AUTOEXEC", "OFFICE_VBA_EXECUTION_INDICATOR", "OFFICE_EXTERNAL_RELATIONSHIP", "OFFICE_EXTERNAL_TEMPLATE", "OFFICE_EMBEDDED_OBJECT", "OFFICE_ACTIVEX", "OFFICE_ENCRYPTED", "OFFICE_MALFORMED", "OFFICE_PARTIAL_ANALYSIS",
)


def _none() -> Column:
    return F.array().cast("array<string>")


def macro_projects(modules: DataFrame, most_modules: int = MOST_MODULES, source_bytes: int = SOURCE_BYTES) -> DataFrame:
    """doc_id, project, modules, bytes, names, triggers, classes, reasons of each macro project.

    Modules are read in order until there are too many or their sources are too long; the last one read is cut, and what
    stands behind the cut isn't seen.
    """
    # dealt by document, as the projects are merged and joined by it; a module has a row for each of its keywords, and counts at the first
    modules = modules.repartition("doc_id")
    order = Window.partitionBy("doc_id", "project").orderBy("module_no", "name", "source_bytes")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct("module_no", "name", "source_bytes")
    rows = modules.withColumn("first", F.coalesce(~F.lag(own).over(order).eqNullSafe(own), F.lit(True)))
    rows = rows.withColumns({"nth": F.count_if("first").over(order.rowsBetween(Window.unboundedPreceding, 0)), "before": F.coalesce(F.sum(F.when(F.col("first"), F.col("source_bytes"))).over(before), F.lit(0)) - F.when(F.col("first"), 0).otherwise(F.coalesce("source_bytes", F.lit(0)))})
    rows = rows.withColumn("read", F.least("source_bytes", F.greatest(F.lit(0), F.lit(source_bytes) - F.col("before"))))
    taken = (F.col("nth") <= most_modules) & (F.col("before") < source_bytes)
    reason = F.when((F.col("nth") > most_modules) & (F.col("before") < source_bytes), "vba_module_limit").when((F.col("nth") <= most_modules) & (F.col("read") < F.col("source_bytes")), "vba_source_size_limit")
    counted = F.col("first") & taken
    word = F.lower(F.trim("keyword"))
    classes = F.element_at(F.create_map(*[F.lit(x) for kv in dims.EXECUTION.items() for x in kv]), word)
    seen = taken & (F.col("keyword_at") + F.octet_length("keyword") <= F.col("read"))
    only = lambda c, v: F.slice(F.array_sort(F.collect_set(F.when(seen & c, v))), 1, MOST_NAMES)
    return rows.groupBy("doc_id", "project").agg(
        F.count_if(counted).alias("modules"), F.sum(F.when(counted, F.col("read")).otherwise(0)).alias("bytes"),
        F.transform(F.array_sort(F.collect_list(F.when(counted & (F.col("nth") <= MOST_NAMES), F.struct("nth", "name")))), lambda m: m["name"]).alias("names"), F.array_sort(F.collect_set(F.when(F.col("first"), reason))).alias("reasons"),
        only((F.col("kind") == "AutoExec") & word.isin(*dims.AUTO_EXEC), word).alias("triggers"), only((F.col("kind") == "Suspicious") & classes.isNotNull(), classes).alias("classes"),
    )


def merged_macros(projects: DataFrame, most_projects: int = MOST_PROJECTS) -> DataFrame:
    """One row for each document: sets united, sums capped, names of the first projects first; projects beyond the limit aren't read."""
    order = Window.partitionBy("doc_id").orderBy("project")
    rows = projects.withColumns({"nth": F.row_number().over(order), "all": F.count(F.lit(1)).over(Window.partitionBy("doc_id"))}).where(F.col("nth") <= most_projects)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    names = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "names"))), lambda p: p["names"]))
    out = rows.groupBy("doc_id").agg(F.max("all").alias("projects"), F.least(F.sum("modules"), F.lit(MOST_MODULES)).alias("modules"), F.least(F.sum("bytes"), F.lit(SOURCE_BYTES)).cast("long").alias("bytes"), F.slice(names, 1, MOST_NAMES).alias("names"), union("triggers"), union("classes"), union("reasons"))
    more = F.when(F.col("projects") > most_projects, F.array(F.lit("vba_project_count_limit"))).otherwise(_none())
    return out.withColumn("reasons", F.array_sort(F.array_union("reasons", more)))


_READ_COLUMNS = ("doc_id", "is_package", "stop", "malformed", "encrypted", "reasons")


def package_evidence(parts: DataFrame, most_parts: int = MOST_PARTS, most_xml: int = MOST_XML, xml_bytes: int = XML_BYTES, part_bytes: int = PART_BYTES, total_bytes: int = TOTAL_BYTES, most_name: int = MOST_NAME) -> DataFrame:
    """What package_reads tells, and what the parts of each package show: apps, macro_type, all_embedded, all_activex, vba_parts. Parts are shuffled and sorted once."""
    xml = F.endswith(F.lower("part_name"), F.lit(".xml")) | F.endswith(F.lower("part_name"), F.lit(".rels"))
    kind = F.when(F.col("part_name") == CONTENT_TYPES, 0).when(xml, 1).when(F.contains(F.lower("part_name"), F.lit("vbaproject")), 2).otherwise(3)
    vba = F.coalesce(F.contains(F.lower("content_type"), F.lit("vbaproject")), F.lit(False))
    # equal names lie side by side, as their kind hangs on the name; what isn't read comes last
    order = Window.partitionBy("doc_id").orderBy("kind", "part_name", F.desc("vba"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumns({"kind": kind, "vba": vba})
    of_xml = F.when(F.col("kind") < 2, F.col("bytes")).otherwise(0)
    rows = rows.withColumns({"nth": F.row_number().over(order), "xml_before": F.coalesce(F.sum(of_xml).over(before), F.lit(0)), "before": F.coalesce(F.sum("bytes").over(before), F.lit(0)), "last_name": F.lag("part_name").over(order)})
    room = F.when(F.col("kind") < 2, F.least(F.lit(part_bytes), F.lit(xml_bytes) - F.col("xml_before"))).otherwise(F.lit(part_bytes))
    breach = (
        F.when((F.col("kind") < 2) & (F.col("nth") > most_xml), "xml_part_limit").when((F.col("kind") < 2) & (F.col("xml_before") >= xml_bytes), "xml_actual_byte_limit")
        .when((F.col("bytes") > room) & (room <= F.lit(total_bytes) - F.col("before")), "member_actual_byte_limit").when(F.col("before") + F.col("bytes") > total_bytes, "total_actual_byte_limit")
    )
    again = (F.col("nth") > 1) & F.col("part_name").eqNullSafe(F.col("last_name"))
    main = F.coalesce(*[F.when((F.col("part_name") == part) & F.contains(F.lower("content_type"), F.lit(mark)), app) for app, part, mark in MAIN_PARTS])
    prefix = lambda folder: F.regexp_like("part_name", F.lit(f"^(word|xl|ppt)/{folder}/"))
    rows = rows.withColumns({"breach": F.when(F.col("kind") < 3, breach), "again": again, "app": main})
    out = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("entries"), (F.max(F.length("part_name")) > most_name).alias("long"), F.bool_or(F.col("flag_bits").bitwiseAND(F.lit(1)) == 1).alias("locked"), F.bool_or(F.col("part_name") == CONTENT_TYPES).alias("is_package"), F.bool_or("again").alias("twice"),
        F.min_by("breach", F.when(F.col("breach").isNotNull(), F.col("nth"))).alias("breach"), *[F.bool_or(F.col("app") == app).alias(f"_{app}") for app in sorted(x[0] for x in MAIN_PARTS)],
        F.bool_or(F.col("app").isNotNull() & F.contains(F.lower("content_type"), F.lit("macroenabled"))).alias("macro_type"), F.count_if(prefix("embeddings")).alias("all_embedded"), F.count_if(prefix("activeX")).alias("all_activex"),
        F.count_if(F.col("vba") & F.col("part_name").isNotNull() & ~F.col("again")).alias("vba_parts"),
    )
    crowded = F.col("entries") > most_parts
    stop = F.when(crowded, "zip_entry_limit").when(F.col("twice"), "duplicate_zip_member").otherwise(F.col("breach"))
    encrypted = F.col("locked") & ~crowded & ~F.col("twice")
    reasons = F.array_sort(F.array_compact(F.array(stop, F.when(F.col("long") & ~crowded, "zip_member_name_limit"), F.when(encrypted, "encrypted_zip_member"))))
    apps = F.array_compact(F.array(*[F.when(F.col(f"_{app}"), app) for app in sorted(x[0] for x in MAIN_PARTS)]))
    return out.select(*_READ_COLUMNS[:2], stop.alias("stop"), (F.col("twice") & ~crowded).alias("malformed"), encrypted.alias("encrypted"), reasons.alias("reasons"), apps.alias("apps"), "macro_type", "all_embedded", "all_activex", "vba_parts")


def package_reads(parts: DataFrame, **limits: int) -> DataFrame:
    """doc_id, is_package, stop, reasons, encrypted: how far the reading of each package gets.

    The content types are read first, then the other XML parts by name, then macro projects. The first limit that is met ends it (stop): too
    many entries, names twice (which is malformed), too many XML parts or bytes, a part or the whole too long. Long
    names and encrypted parts are reasons of their own. A container without content types is no package.
    """
    return package_evidence(parts, **limits).select(*_READ_COLUMNS)


def _assembled(rows: DataFrame, container: str) -> DataFrame:
    """doc_id, detected_type, findings, status, reasons from the evidence columns."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    tests = (
        on("macro_enabled"), some("projects"), F.size("triggers") > 0, F.size("classes") > 0, some("external"), some("templates"), some("embedded"), some("activex"), on("encrypted"), on("malformed"), F.size("reasons") > 0,
    )
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(code)) for t, code in zip(tests, CODES, strict=True)]))
    status = F.when(on("malformed"), "MALFORMED").when(F.size("reasons") > 0, "PARTIAL").otherwise("COMPLETE")
    return rows.select("doc_id", F.concat(F.lit("OFFICE_"), F.upper("application"), F.lit(f"_{container}")).alias("detected_type"), found.alias("findings"), status.alias("status"), "reasons")


def packages(evidence: DataFrame, links: DataFrame, macros: DataFrame, reads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Results of packages, and the containers (doc_id) that are none and go on to the archive job.

    Evidence is that of package_evidence; or it is parts, and reads come from package_reads. Links are (doc_id, external, templates), macros those
    of merged_macros. A package whose reading stopped shows no capabilities; one of no known application is malformed.
    """
    rows = evidence if reads is None else reads.join(package_evidence(evidence).drop(*_READ_COLUMNS[1:]), "doc_id")
    handed = rows.where("NOT is_package").select("doc_id")
    rows = rows.join(links, "doc_id", "left").join(macros.select("doc_id", F.col("projects").alias("macro_count"), "triggers", "classes", F.col("reasons").alias("macro_reasons")), "doc_id", "left")
    whole = F.col("stop").isNull()
    unknown = whole & (F.size("apps") != 1)
    limit = lambda c, name: F.when(whole & (F.col(c) > MOST_OBJECTS), F.lit(name))
    projects = F.greatest("vba_parts", F.coalesce("macro_count", F.lit(0)))
    more = F.array_compact(F.array(limit("all_embedded", "embedded_object_limit"), limit("all_activex", "activex_object_limit"), F.when(unknown, "inconsistent_package_structure")))
    seen = lambda c, none: F.when(whole, F.coalesce(F.col(c), none)).otherwise(none)
    zero = F.lit(0).cast("long")
    out = rows.where("is_package").withColumns({
        "application": F.when(whole & (F.size("apps") == 1), F.element_at("apps", 1)).otherwise("unknown"), "projects": F.when(whole, projects).otherwise(zero), "macro_enabled": whole & (F.col("macro_type") | (projects > 0)), "embedded": F.least(seen("all_embedded", zero), F.lit(MOST_OBJECTS)), "activex": F.least(seen("all_activex", zero), F.lit(MOST_OBJECTS)),
        "external": seen("external", zero), "templates": seen("templates", zero), "triggers": seen("triggers", _none()), "classes": seen("classes", _none()), "malformed": F.col("malformed") | unknown,
        "reasons": F.array_sort(F.array_distinct(F.concat("reasons", more, seen("macro_reasons", _none())))),
    })
    return _assembled(out, "OOXML"), handed


def compounds(files: DataFrame, macros: DataFrame) -> DataFrame:
    """Results of compound files (output of documents.compound_files); one of no known application, encryption or macros gives none."""
    own = macros.select("doc_id", F.col("projects").alias("macro_count"), "triggers", "classes", F.col("reasons").alias("macro_reasons"))
    rows = files.where("container_ok").join(own, "doc_id", "left")
    known, projects = F.col("application") != "unknown", F.greatest("vba_projects", F.when((F.col("application") != "unknown") & ~F.col("encrypted"), F.coalesce("macro_count", F.lit(0))).otherwise(0))
    read = known & ~F.col("encrypted")
    more = F.array_compact(F.array(F.when(~known, "ole_application_unclassified"), F.when(F.col("encrypted"), "office_encryption_prevents_inspection")))
    out = rows.withColumns({
        "projects": projects, "macro_enabled": projects > 0, "embedded": F.col("embedded_objects"), "external": F.lit(0), "templates": F.lit(0), "malformed": F.lit(False), "triggers": F.when(read, F.coalesce("triggers", _none())).otherwise(_none()), "classes": F.when(read, F.coalesce("classes", _none())).otherwise(_none()),
        "reasons": F.array_sort(F.array_distinct(F.concat(F.filter(F.split("reasons", ","), lambda x: x != ""), more, F.when(read, F.coalesce("macro_reasons", _none())).otherwise(_none())))),
    })
    return _assembled(out.where((F.col("application") != "unknown") | F.col("encrypted") | F.col("macro_enabled")), "OLE")
