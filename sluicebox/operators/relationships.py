"""Relationships of office packages: limits in reading order and the main document's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .documents import MAIN_PARTS


def within_limits(relationships: DataFrame, most: int = 2048, most_external: int = 256) -> DataFrame:
    """doc_id, kept, external, reason: how many relationships of a package are read before a limit stops it.

    The root's (source_part '') come first, then those of the parts by name; only parts' external ones count as
    such. `reason` is null where all were read.
    """
    order = Window.partitionBy("doc_id").orderBy("source_part", "ordinal")
    external = ((F.lower("target_mode") == "external") & (F.col("source_part") != "")).cast("int")
    rows = relationships.withColumns({"_nth": F.row_number().over(order), "_external": F.sum(external).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_is": external})
    reason = F.when(F.col("_nth") > most, "relationship_limit").when(F.col("_external") > most_external, "external_relationship_limit")
    rows = rows.withColumn("_reason", reason)
    read = F.col("_reason").isNull()
    return rows.groupBy("doc_id").agg(F.count_if(read).alias("kept"), F.count_if(read & (F.col("_is") == 1)).alias("external"), F.min_by("_reason", F.when(~read, F.col("_nth"))).alias("reason"))


def without_main_part(packages: DataFrame, relationships: DataFrame) -> DataFrame:
    """Packages (doc_id, application) of a known application whose root has no relationship to its main part."""
    main = F.element_at(F.create_map(*[F.lit(x) for app, part, _ in MAIN_PARTS for x in (app, part)]), F.col("application"))
    due = packages.where(F.col("application") != "unknown").select("doc_id", "application", main.alias("part"))
    # A path without empty and `.` parts.
    path = F.array_join(F.filter(F.split("target", "/"), lambda p: ~p.isin("", ".")), "/")
    root = relationships.where((F.col("source_part") == "") & F.endswith(F.lower("rel_type"), F.lit("/officedocument")))
    return due.join(root.select("doc_id", F.when(F.startswith("target", F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path).alias("part")), ["doc_id", "part"], "left_anti").select("doc_id", "application")
