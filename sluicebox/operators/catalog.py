"""Operator questions on the catalog: listings, counts, reports and page budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTAINED = ("REVIEW", "QUARANTINE", "BLOCK")
MOST_PAGE = 100


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page of a total order; deep pages sort all before them."""
    size = min(size, MOST_PAGE)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def listing(scans: DataFrame, decision: str | None = None, state: str | None = None, contained_only: bool = False) -> DataFrame:
    rows = scans.where(F.col("decision").isin(*CONTAINED)) if contained_only else scans.where(F.col("decision") == decision) if decision else scans
    return rows.where(F.col("state") == state) if state else rows


def with_defaults(scans: DataFrame) -> DataFrame:
    """What is shown of scans that have no evaluation."""
    message = F.element_at(F.create_map(*[F.lit(x) for x in ("ALLOW", "may be released", "REVIEW", "needs a look", "QUARANTINE", "is held", "BLOCK", "is refused")]), F.coalesce("decision", F.lit("QUARANTINE")))
    return scans.withColumns({"message": message, "decision": F.coalesce("decision", F.lit("QUARANTINE")), "score": F.coalesce("score", F.lit(0)), "band": F.coalesce("band", F.lit("LOW"))})


def approved(artifacts: DataFrame, derived: DataFrame) -> DataFrame:
    """Cleaned artifacts whose derived scan may be released."""
    ok = derived.where((F.col("decision") == "ALLOW") & F.col("release_eligible")).select(F.col("scan_id").alias("derived_scan_id"), F.col("score").alias("derived_score"))
    return artifacts.where("artifact_type = 'CLEANED'").join(ok, "derived_scan_id")


def page_budget(pages: DataFrame, dpi: int, most_page: int, most_total: int) -> DataFrame:
    """Pixels of each document's pages and the first page that breaks a limit."""
    size = lambda c: F.ceil(F.col(c) * dpi / 72)
    order = Window.partitionBy("doc_id").orderBy("page_no")
    rows = pages.withColumn("pixels", (size("width") * size("height")).cast("long")).withColumn("running", F.sum("pixels").over(order))
    breach = (F.col("pixels") > most_page) | (F.col("running") > most_total)
    out = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.min(F.when(breach, F.col("page_no"))).alias("breach_page"), F.sum("pixels").alias("pixels"))
    return out.withColumn("verdict", F.when(~F.col("pages").between(1, 100), "page_limit").when(F.col("breach_page").isNotNull(), "pixel_limit").otherwise("ok"))
