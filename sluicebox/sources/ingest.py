"""Ingest of documents and loading of case manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 25 << 20
CASES = "case_id string, category string, case_class string, expected_findings array<string>, acceptable_decisions array<string>, fail_secure boolean"


def ingest(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Digest, size and storage key of each content, and why it is rejected (null if it isn't)."""
    rows = files.withColumns({"size": F.octet_length("content").cast("long"), "sha": F.sha2("content", 256)})
    reason = F.when(F.col("size") == 0, "EMPTY").when(F.col("size") > most_bytes, "TOO_LARGE")
    return rows.withColumns({"reject_reason": reason, "storage_key": F.substring("sha", 1, 32)})


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as rows of path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read_manifest(spark: SparkSession, path: str, array: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cases of a manifest, and the records (_bad) that are no case: not JSON, of another shape, or without an id.

    A manifest is JSON lines, which are read in parallel; with `array` its files are JSON arrays, each read whole.
    """
    rows = spark.read.schema(CASES + ", _bad string").option("multiLine", array).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = F.col("_bad").isNull() & F.col("case_id").isNotNull()
    return rows.where(good).drop("_bad"), rows.where(~good)


def manifest_faults(cases: DataFrame) -> DataFrame:
    """fault, case_id: ids that several cases have, and cases that must fail securely but may be allowed."""
    repeated = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated_id").alias("fault"), "case_id")
    open_ = cases.where(F.col("fail_secure") & F.array_contains("acceptable_decisions", "ALLOW")).select(F.lit("fail_secure_allow").alias("fault"), "case_id")
    return repeated.unionAll(open_)


def write_manifest(cases: DataFrame, path: str) -> DataFrame:
    """Write the cases without faults as JSON lines in order of their ids; the faults come back."""
    faults = manifest_faults(cases)
    cases.join(faults.select("case_id").distinct(), "case_id", "left_anti").orderBy("case_id").write.mode("overwrite").json(path)
    return faults
