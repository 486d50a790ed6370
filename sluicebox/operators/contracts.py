"""Contract checks: rows that break what the tables promise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, sorted; a rule is a condition that must hold, null breaks it."""
    return F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])))


def enriched(findings: DataFrame, registry: DataFrame) -> DataFrame:
    """Findings (code and more) with their code's title, description, severity, category, techniques, and no score."""
    own = registry.select("code", "title", "description", "severity", "category", "techniques")
    return findings.join(F.broadcast(own), "code", "left").withColumn("score_delta", F.lit(0))


def conformance(findings: DataFrame, registry: DataFrame) -> DataFrame:
    """Findings (code, title, description, severity, category, techniques, score_delta) with what differs from the registry."""
    parts = ("title", "description", "severity", "category", "techniques")
    known = registry.select("code", *[F.col(c).alias(f"due_{c}") for c in parts])
    rows = findings.join(F.broadcast(known), "code", "left")
    rules = {
        "unknown_code": F.col("due_title").isNotNull(),
        "bad_code": F.regexp_like("code", F.lit("^[A-Z0-9_]{1,128}$")),
        "technique_length": F.forall("techniques", lambda t: F.length(t).between(1, 32)),
        "scored": F.col("score_delta") == 0,
        **{c: F.col(c) == F.col(f"due_{c}") for c in parts},
    }
    return rows.withColumn("violations", violations(rules))


def sorted_unique(c: str) -> Column:
    return F.array_sort(F.array_distinct(c)) == F.col(c)


def evaluation_rules() -> dict[str, Column]:
    """What holds of every evaluation."""
    return {
        "release": F.col("release_eligible") == (F.col("decision") == "ALLOW"),
        "hard_block": (F.size("hard_block_reasons") == 0) | (F.col("decision") == "BLOCK"),
        "complete": (F.col("decision") != "ALLOW") | F.col("complete"),
        "score": F.col("score").between(0, 100),
        "sorted": sorted_unique("hard_block_reasons") & sorted_unique("mandatory_reasons") & sorted_unique("reasons"),
    }


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unresolved(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is set but not found."""
    return df.where(F.col(column).isNotNull()).join(other.select(F.col(key).alias(column)), column, "left_anti")


def registry_faults(findings: DataFrame, compounds: DataFrame, codes: DataFrame) -> DataFrame:
    """rule, subject: what is wrong within a policy (findings and compounds), and between it and the registry's codes."""
    row = lambda df, rule, c: df.select(F.lit(rule).alias("rule"), F.col(c).alias("subject"))
    refs = compounds.select("name", F.explode("required").alias("code"))
    own, registered = findings.select("code").distinct().withColumn("own", F.lit(True)), codes.select("code").distinct().withColumn("registered", F.lit(True))
    both = own.join(registered, "code", "full_outer")
    return (
        row(repeated(findings, "code"), "repeated_code", "code")
        .unionAll(row(findings.where("points NOT BETWEEN 0 AND 100").distinct(), "points", "code"))
        .unionAll(row(findings.where("floor = 'ALLOW'").distinct(), "floor", "code"))
        .unionAll(row(findings.where("hard_block <> coalesce(floor = 'BLOCK', false)").distinct(), "hard_block", "code"))
        .unionAll(row(refs.join(own, "code", "left_anti").select("name").distinct(), "unknown_reference", "name"))
        .unionAll(row(compounds.where("floor IN ('ALLOW', 'BLOCK')"), "compound_floor", "name"))
        .unionAll(row(both.where("own IS NULL"), "without_policy", "code"))
        .unionAll(row(both.where("registered IS NULL"), "unregistered", "code"))
    )


def fingerprint(dim: DataFrame, key: str) -> DataFrame:
    """One digest of a table's rows, whatever their order: of each part of the keys first, then of the 256 parts.

    A row counts as JSON with its fields in order of their names.
    """
    text = F.to_json(F.struct(*sorted(dim.columns)), {"ignoreNullFields": "false"})
    parts = dim.groupBy(F.substring(F.md5(F.col(key).cast("binary")), 1, 2).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), ","), 256).alias("digest"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda p: p["digest"]), ","), 256).alias("fingerprint"))


def failure_code() -> Column:
    """Why an analysis attempt failed, the first that fits, or null: from available, timed_out, output_over, exit_code, well_formed and status."""
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return (
        F.when(off("available"), "isolation_unavailable").when(F.col("timed_out"), "timeout").when(F.col("output_over"), "output_limit_exceeded").when(~F.col("exit_code").eqNullSafe(F.lit(0)), "non_zero_exit")
        .when(off("well_formed"), "malformed_output").when(F.col("status") == "UNSUPPORTED", "unsupported").when(~F.col("status").eqNullSafe(F.lit("SUCCESS")), "worker_failed")
    )


#: Analyzer families with the start of their event and the counters that are logged. Fixed values.
LOGGED = {
    "pdf": ("pdf_analysis", ("page_count",)),
    "office": ("office_analysis", ("vba_project_count", "external_relationship_count", "embedded_object_count")),
    "archive": ("archive_analysis", ("entry_count", "nested_archive_count", "actual_decompressed_bytes")),
    "yara": ("yara_scan", ("matched_rule_count",)),
}


def run_log(results: DataFrame) -> DataFrame:
    """scan_id, family, event, parser_status, counters: one event for each family that a result's metadata (JSON) tells of.

    The event is completed, partial or failed by the parser's status; one that isn't text is UNKNOWN. Counters
    are JSON; one that isn't a whole number is null. The page family is told of PDF results only.
    """
    told = []
    for family, (event, counters) in LOGGED.items():
        own = F.try_variant_get("_v", f"$.{family}", "variant")
        there = F.startswith(F.schema_of_variant(own), F.lit("OBJECT"))
        if family == "pdf":
            there = there & (F.col("detected_type") == "PDF")
        of = lambda name, kind, family=family: F.when(F.schema_of_variant(F.try_variant_get("_v", f"$.{family}.{name}", "variant")) == kind, F.try_variant_get("_v", f"$.{family}.{name}", "string" if kind == "STRING" else "bigint"))
        state = of("parser_status", "STRING")
        ending = F.when(state == "COMPLETE", "completed").when(state == "PARTIAL", "partial").otherwise("failed")
        numbers = F.to_json(F.struct(*[of(c, "BIGINT").alias(c) for c in sorted(counters)]), {"ignoreNullFields": "false"})
        told.append(F.when(F.coalesce(there, F.lit(False)), F.struct(F.lit(family).alias("family"), F.concat(F.lit(f"{event}_"), ending).alias("event"), F.coalesce(state, F.lit("UNKNOWN")).alias("parser_status"), numbers.alias("counters"))))
    rows = results.withColumn("_v", F.try_parse_json("metadata"))
    return rows.select("scan_id", F.explode(F.array_compact(F.array(*told))).alias("e")).select("scan_id", "e.*")


#: What the columns of the catalog and the audit log may hold.
DOMAINS = {
    "state": ("STORED", "ANALYZING", "COMPLETED", "QUARANTINED", "FAILED"),
    "decision": ("ALLOW", "REVIEW", "QUARANTINE", "BLOCK"),
    "origin": ("UPLOAD", "CDR_DERIVED"),
    "actor_type": ("SYSTEM", "OPERATOR", "ANONYMOUS"),
    "outcome": ("SUCCESS", "FAILURE", "DENIED"),
    "event_type": (
        "AUTH_LOGIN_SUCCESS", "AUTH_LOGIN_FAILURE", "AUTH_LOGOUT", "SCAN_UPLOAD_REQUESTED", "CDR_REQUESTED", "ARTIFACT_DOWNLOADED", "ARTIFACT_DOWNLOAD_DENIED", "CDR_ELIGIBILITY_CHECKED", "CDR_STARTED",
        "CDR_RENDER_COMPLETED", "CDR_RENDER_FAILED", "CDR_DERIVED_SCAN_CREATED", "CDR_RESCAN_COMPLETED", "CDR_APPROVED", "CDR_REJECTED", "CDR_PROMOTION_FAILED", "RECOVERY_STALE_SCAN_DETECTED",
        "RECOVERY_STALE_SCAN_QUARANTINED", "STORAGE_ORPHAN_DETECTED", "ARTIFACT_INTEGRITY_FAILURE", "TEMP_OBJECT_CLEANED",
    ),
}


def domain_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """domain, value, n, outside: how often each value of the columns occurs, and whether its domain lacks it. Nulls don't count."""
    pairs = F.array(*[F.struct(F.lit(c).alias("domain"), F.col(c).alias("value")) for c in columns])
    outside = F.lit(False)
    for c in columns:
        outside = F.when(F.col("domain") == c, ~F.col("value").isin(*DOMAINS[c])).otherwise(outside)
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").groupBy("domain", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("outside", outside)


_MATCH = "rule_id string, rule_title string, rule_explanation string, rule_category string, confidence_class string, rule_pack_version string, rule_pack_sha256 string, scope string, match_count bigint, string_ids array<string>, offsets array<bigint>"
#: Bounds of a match's evidence, and the reasons of a partial scan.
MOST_COUNT, MOST_IDS, MOST_ID, MOST_OFFSETS = 4096, 16, 128, 16
PARTIAL_REASONS = ("engine_match_warning", "engine_warning", "internal_timeout", "match_instance_limit", "matched_rule_limit", "metadata_limit", "offset_limit", "scanner_error", "string_identifier_limit")


def _same_keys(text: str, names: list[str]) -> Column:
    return F.array_sort(F.json_object_keys(text)) == F.array(*map(F.lit, sorted(names)))


def match_conformance(matches: DataFrame, definitions: DataFrame, version: str, sha256: str) -> DataFrame:
    """Rule findings (code, metadata as JSON) with what is wrong: keys, rule, registry, code, count, strings, offsets.

    Definitions have rule_id, title, explanation, category, confidence, code. A list that holds anything but text, or
    whole numbers, breaks its rule.
    """
    known = definitions.select("rule_id", *[F.col(c).alias(f"due_{c}") for c in ("title", "explanation", "category", "confidence", "code")])
    rows = matches.withColumn("_m", F.from_json("metadata", _MATCH)).withColumn("rule_id", F.col("_m.rule_id")).join(F.broadcast(known), "rule_id", "left")
    m = lambda c: F.col(f"_m.{c}")
    ordered = lambda xs: xs == F.array_sort(F.array_distinct(xs))
    kinds = lambda name, kind: F.forall(F.coalesce(F.try_variant_get(F.try_parse_json("metadata"), f"$.{name}", "array<variant>"), F.array(F.try_parse_json(F.lit("null")))), lambda x: F.schema_of_variant(x) == kind)
    rules = {
        "keys": _same_keys("metadata", [c.split()[0] for c in _MATCH.split(", ")]),
        "rule": F.col("due_title").isNotNull(),
        "registry": (m("rule_title") == F.col("due_title")) & (m("rule_explanation") == F.col("due_explanation")) & (m("rule_category") == F.col("due_category")) & (m("confidence_class") == F.col("due_confidence")) & (m("rule_pack_version") == version) & (m("rule_pack_sha256") == sha256) & (m("scope") == "TOP_LEVEL"),
        "code": F.col("code") == F.col("due_code"),
        "count": m("match_count").between(1, MOST_COUNT),
        "strings": kinds("string_ids", "STRING") & (F.size(m("string_ids")) <= MOST_IDS) & F.forall(m("string_ids"), lambda s: F.startswith(s, F.lit("$")) & (F.length(s) <= MOST_ID)) & ordered(m("string_ids")),
        "offsets": kinds("offsets", "BIGINT") & (F.size(m("offsets")) <= MOST_OFFSETS) & F.forall(m("offsets"), lambda o: o >= 0) & ordered(m("offsets")),
    }
    return rows.withColumn("violations", violations(rules)).drop("_m", *[c for c in rows.columns if c.startswith("due_")])


def partial_conformance(partials: DataFrame, version: str, sha256: str) -> DataFrame:
    """Findings of partial scans (metadata as JSON) with what is wrong: keys, pack, empty, unknown, order."""
    rows = partials.withColumn("_m", F.from_json("metadata", "reasons array<string>, rule_pack_version string, rule_pack_sha256 string"))
    reasons = F.col("_m.reasons")
    rules = {
        "keys": _same_keys("metadata", ["reasons", "rule_pack_version", "rule_pack_sha256"]),
        "pack": (F.col("_m.rule_pack_version") == version) & (F.col("_m.rule_pack_sha256") == sha256),
        "empty": F.size(reasons) > 0,
        "unknown": F.size(F.array_except(reasons, F.array(*map(F.lit, PARTIAL_REASONS)))) == 0,
        "order": reasons == F.array_sort(F.array_distinct(reasons)),
    }
    return rows.withColumn("violations", violations(rules)).drop("_m")


def envelope_rules(version: str, most_findings: int = 256, most_bytes: int = 32 << 10) -> dict[str, Column]:
    """What holds of a worker's result."""
    return {"version": F.col("schema_version") == version, "times": F.col("completed_at") >= F.col("started_at"), "findings": F.col("findings") <= most_findings, "metadata": F.col("metadata_bytes") <= most_bytes}
