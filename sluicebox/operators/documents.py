"""Office packages, compound files, macros and page documents: evidence rows to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..plans import dims

MAIN_PARTS = [("word", "word/document.xml", "wordprocessingml"), ("excel", "xl/workbook.xml", "spreadsheetml"), ("powerpoint", "ppt/presentation.xml", "presentationml")]


def classify_packages(parts: DataFrame) -> DataFrame:
    """doc_id, application, macro_enabled: the one application whose main part is there with its content type."""
    main = [F.when((F.col("part_name") == part) & F.contains(F.lower("content_type"), F.lit(mark)), app) for app, part, mark in MAIN_PARTS]
    found = parts.withColumn("app", F.coalesce(*main))
    out = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("app")).alias("apps"), F.bool_or(F.col("app").isNotNull() & F.contains(F.lower("content_type"), F.lit("macroenabled"))).alias("macro_enabled"))
    return out.select("doc_id", F.when(F.size("apps") == 1, F.element_at("apps", 1)).otherwise("unknown").alias("application"), "macro_enabled")


def ambiguous_parts(parts: DataFrame) -> DataFrame:
    """Parts of a package with several content types, and how many rows name them."""
    return parts.groupBy("doc_id", "part_name").agg(F.count_distinct("content_type").alias("types"), F.count(F.lit(1)).alias("n")).where("types > 1 OR n > 1")


def capabilities(parts: DataFrame, most: int = 256) -> DataFrame:
    """Embedded objects, ActiveX parts and macro projects of a package, counted up to a limit."""
    embedded, active = F.regexp_like("part_name", F.lit("^(word|xl|ppt)/embeddings/")), F.regexp_like("part_name", F.lit("^(word|xl|ppt)/activeX/"))
    macro = F.contains(F.lower("content_type"), F.lit("vbaproject")) | F.regexp_like("part_name", F.lit("^(word|xl|ppt)/vbaProject\\.bin$"))
    out = parts.groupBy("doc_id").agg(F.least(F.count_if(embedded), F.lit(most)).alias("embedded"), F.least(F.count_if(active), F.lit(most)).alias("activex"), F.count_distinct(F.when(macro, F.col("part_name"))).alias("projects"))
    return out.withColumn("partial", (F.col("projects") > 8) | (F.col("embedded") >= most))


def external_relationships(relationships: DataFrame, most: int = 64) -> DataFrame:
    """External targets of a package beside the root's: how many, how many templates, and the first kept."""
    rows = relationships.where((F.lower("target_mode") == "external") & (F.col("source_part") != ""))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("source_part", "ordinal")))
    t = F.col("target")
    summary = F.concat_ws(" ", F.substring_index("rel_type", "/", -1), names.link_scheme(t), names.link_host(t))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("external"), F.count_if(F.endswith(F.lower("rel_type"), F.lit("/attachedtemplate"))).alias("templates"), F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.struct("nth", summary.alias("s"))))), lambda x: x["s"]).alias("kept"))


# Page documents ----------------------------------------------------------------------------------


def action_types(actions: DataFrame, most_unknown: int = 32) -> DataFrame:
    """Known action types by name; unknown ones by theirs until a document has too many, then together."""
    known = F.col("subtype").isin(*dims.ACTIONS)
    first = F.row_number().over(Window.partitionBy("doc_id", "subtype").orderBy("action_id")) == 1
    order = Window.partitionBy("doc_id").orderBy("action_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = actions.withColumn("new", (~known & first).cast("int")).withColumn("before", F.coalesce(F.sum("new").over(order), F.lit(0)))
    return rows.withColumn("type", F.when(known, F.col("subtype")).when(F.col("before") >= most_unknown, "Unknown:other").otherwise(F.concat(F.lit("Unknown:"), names.bounded(F.col("subtype"), 64))))


def action_summary(typed: DataFrame, most_targets: int = 32) -> DataFrame:
    """Capabilities of a document's actions: counts by kind, sources, holders, targets kept, external forms."""
    t = F.col("target")
    count = lambda kind: F.count_if(F.col("type") == kind)
    return typed.groupBy("doc_id").agg(count("JavaScript").alias("scripts"), count("Launch").alias("launches"), count("URI").alias("links"), F.array_sort(F.collect_set("source")).alias("sources"), F.count_distinct("holder_id").alias("holders"), F.least(count("URI"), F.lit(most_targets)).alias("kept_targets"), (count("URI") > 128).alias("partial"), F.least(F.count_if((F.col("type") == "SubmitForm") & names.link_scheme(t).isNotNull()), F.lit(most_targets)).alias("external_forms"))


def script_behavior(scripts: DataFrame, words: dict[str, list[str]], first_chars: int = 65536) -> DataFrame:
    """Behavior categories of a document's scripts: any of a category's words in a script's first part."""
    source = F.substring("source_text", 1, first_chars)
    hit = lambda found: F.exists(F.array(*map(F.lit, found)), lambda w: F.contains(source, w))
    return scripts.select("doc_id", F.array_sort(F.array_compact(F.array(*[F.when(hit(found), name) for name, found in words.items()]))).alias("categories"))


def token_pattern(token: str) -> str:
    """A pattern for `/token` with any of its characters written as #XX."""
    either = lambda c: f"(?:{c}|#{ord(c) >> 4:x}[{ord(c) & 15:x}{ord(c) & 15:X}])"
    return "(?:/|#2[fF])" + "".join(map(either, token))


def name_tokens(content: Column, tokens: list[str], most: int = 9999, first_bytes: int = 8 << 20) -> Column:
    """Counts of `/token`, as a prefix, in the first part of a document's bytes read one to a character."""
    text = F.substring(content, 1, first_bytes)
    return F.array(*[F.struct(F.lit(t).alias("token"), F.least(F.regexp_count(text, F.lit(token_pattern(t))), F.lit(most)).alias("n")) for t in tokens])


def page_findings(summary: DataFrame) -> DataFrame:
    rules = (("PDF_JAVASCRIPT", F.col("scripts") > 0), ("PDF_OPEN_ACTION", F.array_contains("sources", "open")), ("PDF_ADDITIONAL_ACTION", F.array_contains("sources", "page")), ("PDF_LAUNCH_ACTION", F.col("launches") > 0), ("PDF_ACROFORM", F.array_contains("sources", "form")), ("PDF_EXTERNAL_URI", F.col("links") > 0), ("PDF_EXTERNAL_SUBMISSION", F.col("external_forms") > 0), ("PDF_PARTIAL_ANALYSIS", F.col("partial")))
    return summary.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(c, code) for code, c in rules]))).alias("code"))


def embedded_count(attachments: DataFrame, most: int = 128) -> DataFrame:
    """Embedded files of a document: named ones or file specs, whichever are more, and payloads that none refers to."""
    payloads = attachments.groupBy("doc_id", "payload_id").agg(F.bool_or("referenced").alias("referenced")).groupBy("doc_id").agg(F.count_if(~F.col("referenced")).alias("loose"))
    own = attachments.groupBy("doc_id").agg(F.count_if("named").alias("named"), F.count_distinct("spec_id").alias("specs"))
    return own.join(payloads, "doc_id").select("doc_id", F.least(F.greatest("named", "specs") + F.col("loose"), F.lit(most)).alias("embedded"))


def within_limit(rows: DataFrame, order: str, most: int, reason: str) -> DataFrame:
    """The first rows of a document in visiting order; reason is set where there were more."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(order))
    more = F.count(F.lit(1)).over(Window.partitionBy("doc_id")) > most
    return rows.withColumns({"nth": nth, "reason": F.when(more, reason)}).where(F.col("nth") <= most).drop("nth")


def compound_files(entries: DataFrame, most_entries: int = 4096, most_objects: int = 256) -> DataFrame:
    """Compound files (doc_id, family, path of each entry) by the names of their storages and streams.

    One row for each document: application, encrypted, embedded_objects, activex, vba_projects, reasons (limits
    that were met, and a container that its family doesn't fit), container_ok. Names count in lower case, once
    each; both streams of an encrypted package make a document encrypted.
    """
    # documents are dealt out once; names are made single before anything is found in them
    entries = entries.select("doc_id", "family", F.lower("path").alias("path")).repartition("doc_id").distinct()
    path = F.col("path")
    leaf = F.regexp_extract(path, "([^/]*)$", 1)
    embedded = leaf.isin("\x01ole10native", "ole10native", "package") | F.startswith(path, F.lit("objectpool/"))
    active = F.startswith(path, F.lit("ctls/")) | F.startswith(path, F.lit("activex/")) | F.contains(path, F.lit("/activex/"))
    project = F.endswith(path, F.lit("/dir")) & (F.startswith(path, F.lit("vba/")) | F.contains(path, F.lit("/vba/")))
    names_ = entries.select("doc_id", "family", "path", leaf.alias("leaf"), embedded.alias("embedded"), active.alias("active"), F.when(project, F.regexp_extract(path, "^(.*)/[^/]*$", 1)).alias("project"))
    out = names_.groupBy("doc_id").agg(
        F.first("family").alias("family"), F.count(F.lit(1)).alias("entries"), F.bool_or(F.col("path") == "worddocument").alias("word"), F.bool_or(F.col("path").isin("workbook", "book")).alias("excel"), F.bool_or(F.col("path") == "powerpoint document").alias("powerpoint"),
        (F.bool_or(F.col("leaf") == "encryptioninfo") & F.bool_or(F.col("leaf") == "encryptedpackage")).alias("encrypted"), F.count_if("embedded").alias("embedded_all"), F.count_if("active").alias("active_all"), F.count_distinct("project").alias("vba_projects"),
    )
    ok = F.col("family") == "OLE_COMPOUND"
    limits = [F.when(F.col("entries") > most_entries, "ole_entry_limit"), F.when(F.col("embedded_all") > most_objects, "embedded_object_limit"), F.when(F.col("active_all") > most_objects, "activex_object_limit"), F.when(~ok, "container_mismatch")]
    return out.select(
        "doc_id", F.when(F.col("word"), "word").when(F.col("excel"), "excel").when(F.col("powerpoint"), "powerpoint").otherwise("unknown").alias("application"), "encrypted",
        F.least("embedded_all", F.lit(most_objects)).cast("long").alias("embedded_objects"), F.least("active_all", F.lit(most_objects)).cast("long").alias("activex"), "vba_projects", F.array_join(F.array_compact(F.array(*limits)), ",").alias("reasons"), ok.alias("container_ok"),
    )
