"""Catalog against storage: issues as joins, one row for each, their report, and what to do about stale scans.

Scans: scan_id, state, updated_at, parent_scan_id, storage_key, sha, size_bytes. Artifacts: artifact_id,
storage_key, sha, size_bytes. Listing: area, name, kind, links, mode, size_bytes, sha, modified_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of temporaries of uploads and of rendering, areas, and modes of private files.
UPLOAD_TEMPORARY, RENDER_TEMPORARY = r"^\.[0-9a-f]{32}\.[0-9a-f]{16}\.part$", r"^\.cdr-[0-9a-f]{32}\.part$"
QUARANTINE, SANITIZED, TEMPORARY_AREAS = "quarantine", "sanitized", ("incoming", "work")
PRIVATE, PRIVATE_TEMPORARY = 0o400, (0o400, 0o600)


def _regular(c: str = "") -> Column:
    return (F.col(f"{c}kind") == "file") & (F.col(f"{c}links") == 1)


def held(rows: DataFrame, listing: DataFrame, area: str) -> DataFrame:
    """Rows with a storage_key, sha and size_bytes, and `whole`: their object is a private regular file of that size and digest."""
    stored = listing.where(F.col("area") == area).select(F.col("name").alias("storage_key"), *[F.col(c).alias(f"_{c}") for c in ("kind", "links", "mode", "size_bytes", "sha")])
    whole = _regular("_") & (F.col("_mode") == PRIVATE) & (F.col("_size_bytes") == F.col("size_bytes")) & (F.col("_sha") == F.col("sha"))
    return rows.join(stored, "storage_key", "left").withColumn("whole", F.coalesce(whole, F.lit(False))).drop("_kind", "_links", "_mode", "_size_bytes", "_sha")


def stale(now: int, stale_after: int) -> Column:
    return (F.col("state") == "ANALYZING") & (F.col("updated_at") <= now - stale_after)


def temporaries(listing: DataFrame, cutoff: int) -> DataFrame:
    """Temporaries that may be removed: of a known name, private, regular, without other links, and old."""
    known = F.regexp_like("name", F.lit(UPLOAD_TEMPORARY)) | F.regexp_like("name", F.lit(RENDER_TEMPORARY))
    return listing.where(F.col("area").isin(*TEMPORARY_AREAS) & known & _regular() & F.col("mode").isin(*PRIVATE_TEMPORARY) & (F.col("modified_at") <= cutoff))


def issues(scans: DataFrame, artifacts: DataFrame, listing: DataFrame, now: int, stale_after: int) -> DataFrame:
    """code, subject of everything that doesn't fit: stale scans, objects and artifacts missing or altered, broken parents, orphans of two areas, stale temporaries."""
    row = lambda df, code, subject: df.select(F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject"))
    parents = scans.where("parent_scan_id IS NOT NULL").join(scans.select(F.col("scan_id").alias("parent_scan_id")), "parent_scan_id", "left_anti")
    orphans = lambda area, rows: listing.where((F.col("area") == area) & ~F.startswith("name", F.lit("."))).join(rows.select(F.col("storage_key").alias("name")), "name", "left_anti")
    return (
        row(scans.where(stale(now, stale_after)), "STALE_ANALYZING_SCAN", "scan_id")
        .unionAll(row(held(scans, listing, QUARANTINE).where("NOT whole"), "SCAN_OBJECT_MISSING_OR_INVALID", "scan_id"))
        .unionAll(row(parents, "DERIVED_PARENT_LINEAGE_BROKEN", "scan_id"))
        .unionAll(row(held(artifacts, listing, SANITIZED).where("NOT whole"), "ARTIFACT_INTEGRITY_FAILURE", "artifact_id"))
        .unionAll(row(orphans(QUARANTINE, scans), "QUARANTINE_ORPHAN", "name"))
        .unionAll(row(orphans(SANITIZED, artifacts), "SANITIZED_ORPHAN", "name"))
        .unionAll(row(temporaries(listing, now - stale_after), "STALE_TEMP_OBJECT", "name"))
    )


def report(found: DataFrame, scans: DataFrame, artifacts: DataFrame, listing: DataFrame, most: int) -> DataFrame:
    """One row: what was inspected, the issues by code, whether an area has more files than `most`, and whether all is well."""
    named = listing.where(F.col("area").isin(QUARANTINE, SANITIZED) & ~F.startswith("name", F.lit(".")))
    files = named.groupBy("area").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("inspected_files"), F.coalesce(F.max("n") > most, F.lit(False)).alias("truncated"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    by = found.groupBy("code").agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.concat_ws("=", "code", "n"))).alias("issues"))
    # one row each, put together by an aggregate
    rows = count(scans, "inspected_scans")
    for more in (count(artifacts, "inspected_artifacts"), files, by):
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    return rows.withColumn("passed", F.size("issues") == 0)


def quarantine(scans: DataFrame, now: int, stale_after: int) -> DataFrame:
    """What becomes of stale scans: the columns to set."""
    return scans.where(stale(now, stale_after)).select(
        "scan_id", F.lit("QUARANTINED").alias("state"), F.lit("FAILED").alias("worker_status"), F.lit("recovery_stale_analysis").alias("error_code"), F.lit("QUARANTINE").alias("decision"), F.lit(False).alias("release_eligible"), F.lit(now).cast("long").alias("updated_at"),
    )


def quarantine_audit(now: int) -> list[Column]:
    """The audit columns of a quarantined scan."""
    return [F.col("scan_id"), F.lit("RECOVERY_STALE_SCAN_QUARANTINED").alias("event_type"), F.lit("SUCCESS").alias("outcome"), F.lit("SYSTEM").alias("actor_type"), F.lit("RECOVERY_STALE_ANALYSIS").alias("reason_code"), F.lit(now).cast("long").alias("created_at")]


def bounded_batch(df: DataFrame, key: str, most: int) -> tuple[DataFrame, bool]:
    """The first rows by key, and whether there are more."""
    rows = df.orderBy(key).limit(most + 1)
    return rows.orderBy(key).limit(most), rows.count() > most
