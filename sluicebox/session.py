"""Session settings that the jobs expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sluicebox", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; RocksDB holds streaming state."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=settings).getOrCreate()
