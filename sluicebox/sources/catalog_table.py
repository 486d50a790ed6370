"""The catalog as a partitioned table: conditional updates that rewrite the partitions they change, with audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import saved

PARTS = 64


def create(rows: DataFrame, path: str, key: str = "scan_id", parts: int = PARTS) -> None:
    """Write a catalog in parts by a hash of its key; a row's part never changes."""
    rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).repartition("part").write.partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def update(spark: SparkSession, path: str, changes: DataFrame, still: Column, audit_path: str, audit: list[Column], key: str = "scan_id") -> int:
    """Apply changes (key and the columns to set) to the rows for which `still` holds now; how many rows changed.

    The condition is checked against the table as it is, not as it was when the changes were made up. Rows that
    already are as asked don't count, so a second run changes nothing and writes nothing. Only parts with a changed row
    are written again, by a dynamic overwrite. The audit columns of each changed row go to a folder of the log
    that is named by the changed rows, before the table does: a run that is lost in between is run again, and writes the same
    folder. One writer at a time.
    """
    table = read(spark, path)
    columns = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    hits = saved(table.join(new, key).where(F.coalesce(still, F.lit(False)) & differs))
    row = hits.agg(F.count(F.lit(1)), F.hex(F.bit_xor(F.xxhash64(*hits.columns)))).first()
    if not row[0]:
        return 0
    hits.select(*audit).write.mode("overwrite").parquet(f"{audit_path}/run={row[1]}")
    parts = hits.select("part").distinct()  # at most as many rows as the table has parts
    rows = table.join(F.broadcast(parts), "part", "left_semi").join(hits.select(key, F.lit(True).alias("_hit"), *[f"_new_{c}" for c in columns]), key, "left")
    rows = rows.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).select(*table.columns)
    # what is read must not be what is overwritten
    saved(rows).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return row[0]
