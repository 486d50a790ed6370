"""Sinks: result files, report tables, the audit log, and a check of what leaves."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shared_folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share."""
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


def csv_rows(results: DataFrame) -> DataFrame:
    """Arrays joined by `|`, booleans as text, nulls empty."""
    out = []
    for f in results.schema:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append((F.array_join(c, "|") if kind.startswith("array") else c if kind in ("bigint", "int") else F.coalesce(c.cast("string"), F.lit(""))).alias(f.name))
    return results.select(*out)


def write_csv(results: DataFrame, path: str) -> None:
    csv_rows(results).orderBy(results.columns[0]).write.mode("overwrite").option("header", True).csv(path)


def write_results(results: DataFrame, path: str, key: str = "case_id", **metadata: str) -> None:
    """Results in order of their ids as JSON lines, and one line of the run's metadata, with their number, beside them."""
    results.orderBy(key).write.mode("overwrite").json(f"{path}/results")
    results.agg(F.count(F.lit(1)).alias("results")).select(*[F.lit(v).alias(k) for k, v in sorted(metadata.items())], "results").write.mode("overwrite").json(f"{path}/metadata")


def metrics_document(metrics: DataFrame, latency: DataFrame, **metadata: str) -> DataFrame:
    """One row of JSON with the metrics, latency among them, and what is said about the run; fields by name."""
    one = metrics.withColumn("_k", F.lit(1)).join(latency.select(F.lit(1).alias("_k"), F.struct(*sorted(latency.columns)).alias("latency")), "_k").drop("_k")
    about = F.struct(*[F.lit(v).alias(k) for k, v in sorted(metadata.items())])
    return one.select(F.to_json(F.struct(about.alias("metadata"), F.struct(*sorted(one.columns)).alias("metrics")), {"ignoreNullFields": "false"}).alias("json"))


def report_lines(cases: DataFrame, matched: DataFrame, results: DataFrame, rates: tuple[str, ...]) -> DataFrame:
    """table, line, value of a report: cases by category, findings' recall by category, results by completeness, latency, rates."""
    from ..operators import evaluate

    hits = F.size(F.array_intersect("expected", "actual"))
    found = matched.groupBy("category").agg(F.sum(hits).alias("n"), F.sum(F.size("expected")).alias("d"))
    recall = cases.select("category").distinct().join(found, "category", "left").select(F.lit("recall").alias("table"), F.col("category").alias("line"), rate_text(F.coalesce("n", F.lit(0)), F.coalesce("d", F.lit(0))).alias("value"))
    row = lambda df, table, line: df.select(F.lit(table).alias("table"), F.col(line).alias("line"), F.col("n").cast("string").alias("value"))
    latency = evaluate.latency(results).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("count", "low", "high", "p95", "mean"))), F.array(F.col("n").cast("string"), F.col("low").cast("string"), F.col("high").cast("string"), F.col("p95").cast("string"), F.format_string("%.1f", "mean")))).alias("line", "value"))
    told = evaluate.metrics(matched).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rates)), F.array(*[rate_text(F.col(f"{r}_n"), F.col(f"{r}_d")) for r in rates]))).alias("line", "value"))
    return (
        row(cases.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "categories", "category").unionAll(recall).unionAll(row(evaluate.completeness_counts(results), "completeness", "bucket"))
        .unionAll(latency.select(F.lit("latency"), "line", "value")).unionAll(told.select(F.lit("metrics"), "line", "value"))
    )


def rate_text(n: Column, d: Column) -> Column:
    return F.when(d > 0, F.format_string("%.1f%% (%d/%d)", F.bround(100.0 * n / d, 1), n, d)).otherwise("not applicable")


def leak(text: Column, markers: list[str]) -> Column:
    """The first of some markers that a text contains."""
    return F.get(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m)), F.lit(0))


def append_audit(events: DataFrame, path: str) -> None:
    """Add events to the log; nothing in it is changed."""
    events.write.mode("append").parquet(path)
