"""Tables that jobs write between rounds, in a folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one in the warehouse.

    A warehouse on a local disk is no shared folder on a cluster, so that is refused there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_written"
        local = at.startswith(("/", "file:"))
        if local and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return at.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write a table and read it: its lineage ends there, and lost executors don't bring it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
