"""Listings of real files, reconciliation with what they show, and updates of the catalog table."""

import glob
import hashlib
import os
import time

from pyspark.sql import functions as F

from sluicebox.operators import reconcile
from sluicebox.sources import catalog_table, listing


def store(tmp_path):
    for area in ("quarantine", "sanitized", "incoming", "work"):
        (tmp_path / area).mkdir()
    for area, name, content, mode in [("quarantine", "d1", b"one", 0o400), ("quarantine", "d2", b"two", 0o440), ("quarantine", "d3", b"other", 0o400), ("quarantine", "lost", b"x", 0o400), ("quarantine", ".hidden", b"x", 0o400), ("sanitized", "a1", b"clean", 0o400), ("sanitized", "a9", b"x", 0o400)]:
        (tmp_path / area / name).write_bytes(content)
        os.chmod(tmp_path / area / name, mode)
    old = time.time() - 10_000
    for area, name, mode in [("incoming", "." + "a" * 32 + "." + "b" * 16 + ".part", 0o600), ("work", ".cdr-" + "c" * 32 + ".part", 0o400), ("work", ".cdr-" + "d" * 32 + ".part", 0o644), ("incoming", ".cdr-" + "e" * 31 + ".part", 0o600), ("work", ".cdr-" + "f" * 32 + ".part", 0o600)]:
        (tmp_path / area / name).write_bytes(b"t")
        os.chmod(tmp_path / area / name, mode)
        os.utime(tmp_path / area / name, (old, old))
    os.utime(tmp_path / "work" / (".cdr-" + "f" * 32 + ".part"))
    os.symlink(tmp_path / "quarantine" / "d1", tmp_path / "quarantine" / "d4")
    os.link(tmp_path / "quarantine" / "lost", tmp_path / "quarantine" / "d5")


def test_listing_reads_no_contents(spark, tmp_path):
    store(tmp_path)
    rows = listing.listed(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "binaryFile" in line)
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in scan
    got = {(r["area"], r["name"]): r["size_bytes"] for r in rows.collect()}
    assert got["quarantine", "d3"] == 5 and ("quarantine", ".hidden") not in got and ("sanitized", "a9") in got
    digests = {(r["area"], r["name"]): r["sha"] for r in listing.digested(spark, str(tmp_path)).collect()}
    assert digests["sanitized", "a1"] == hashlib.sha256(b"clean").hexdigest()


def test_reconciliation_of_real_files(spark, tmp_path):
    store(tmp_path)
    folders = spark.createDataFrame([(str(tmp_path / a),) for a in ("quarantine", "sanitized", "incoming", "work", "missing")], "path string")
    entries = listing.attributes(folders)
    own = {(r["area"], r["name"]): r for r in entries.collect()}
    assert own["quarantine", "d4"]["kind"] == "link" and own["quarantine", "d5"]["links"] == 2 and own["quarantine", "d2"]["mode"] == 0o440 and own["quarantine", ".hidden"]["kind"] == "file"
    whole = entries.join(listing.digested(spark, str(tmp_path)), ["area", "name"], "left")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    scans = [(1, "COMPLETED", 0, None, "d1", sha(b"one"), 3), (2, "ANALYZING", 100, 7, "d2", sha(b"two"), 3), (3, "ANALYZING", 9_950, 1, "d3", sha(b"three"), 5), (4, "STORED", 0, None, "d4", sha(b"one"), 3), (5, "STORED", 0, None, "d5", sha(b"x"), 1), (6, "STORED", 0, None, "d6", "", 0)]
    catalog = spark.createDataFrame(scans, "scan_id long, state string, updated_at long, parent_scan_id long, storage_key string, sha string, size_bytes long")
    artifacts = spark.createDataFrame([(1, "a1", sha(b"clean"), 5), (2, "a2", "", 1)], "artifact_id long, storage_key string, sha string, size_bytes long")
    now = int(time.time())
    found = reconcile.issues(catalog, artifacts, whole, now, 900)
    got = sorted(map(tuple, found.where("code <> 'STALE_ANALYZING_SCAN'").collect()))
    assert got == sorted([("ARTIFACT_INTEGRITY_FAILURE", "2"), ("DERIVED_PARENT_LINEAGE_BROKEN", "2"), ("QUARANTINE_ORPHAN", "lost"), ("SANITIZED_ORPHAN", "a9"), *[("SCAN_OBJECT_MISSING_OR_INVALID", str(k)) for k in (2, 3, 4, 5, 6)], ("STALE_TEMP_OBJECT", ".cdr-" + "c" * 32 + ".part"), ("STALE_TEMP_OBJECT", "." + "a" * 32 + "." + "b" * 16 + ".part")])
    assert {r["subject"] for r in reconcile.issues(catalog, artifacts, whole, 10_000, 900).where("code = 'STALE_ANALYZING_SCAN'").collect()} == {"2"}
    report = reconcile.report(found, catalog, artifacts, whole, 5).first()
    assert (report["inspected_scans"], report["inspected_artifacts"], report["inspected_files"], report["truncated"], report["passed"]) == (6, 2, 8, True, False)
    none = reconcile.report(found.limit(0), catalog.limit(0), artifacts.limit(0), whole.limit(0), 5).first()
    assert (none["inspected_files"], none["truncated"], none["passed"], none["issues"]) == (0, False, True, [])


def test_updates_rewrite_changed_parts_only(spark, tmp_path):
    path, log = str(tmp_path / "catalog"), str(tmp_path / "log")
    rows = spark.range(200).select(F.col("id").alias("scan_id"), F.when(F.col("id") < 6, "ANALYZING").otherwise("STORED").alias("state"), F.lit(0).cast("long").alias("updated_at"))
    catalog_table.create(rows, path, parts=16)
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/part=*/*.parquet")}
    changes = spark.createDataFrame([(0, "DONE"), (1, "DONE"), (100, "DONE"), (999, "DONE")], "scan_id long, state string")
    audit = [F.col("scan_id"), F.col("state").alias("old_state")]
    still = F.col("state") == "ANALYZING"
    assert catalog_table.update(spark, path, changes, still, log, audit) == 2
    table = {r["scan_id"]: r["state"] for r in catalog_table.read(spark, path).collect()}
    assert len(table) == 200 and [table[k] for k in (0, 1, 2, 100)] == ["DONE", "DONE", "ANALYZING", "STORED"]
    parts = {r["part"] for r in catalog_table.read(spark, path).where("scan_id < 2").select("part").collect()}
    same = {p for p in glob.glob(f"{path}/part=*/*.parquet") if before.get(p) == os.stat(p).st_mtime_ns}
    assert {int(p.split("part=")[1].split("/")[0]) for p in before if p not in same} == parts
    assert sorted(map(tuple, spark.read.parquet(log).select("scan_id", "old_state").collect())) == [(0, "ANALYZING"), (1, "ANALYZING")]
    after = set(glob.glob(f"{path}/part=*/*.parquet"))
    assert catalog_table.update(spark, path, changes, still, log, audit) == 0 and set(glob.glob(f"{path}/part=*/*.parquet")) == after
    assert spark.read.parquet(log).count() == 2
