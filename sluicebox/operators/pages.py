"""Page documents as a whole: attachment names, findings in order and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..plans import dims


def attachment_name(v: Column, most: int = 128) -> Column:
    """A composed, printable name without separators, trimmed and cut; `unnamed-attachment` if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(names.composed(v), f"[\\p{{C}}{dims.BIDI}]", ""), "[/\\\\]", "_")
    kept = F.regexp_replace(kept, "^\\s+|\\s+$", "")
    return F.substring(F.coalesce(F.nullif(kept, F.lit("")), F.lit("unnamed-attachment")), 1, most)


def attachment_names(attachments: DataFrame, most: int = 32) -> DataFrame:
    """doc_id, names, capped: the first `most` different names of a document's attachments (ordinal, display_name).

    Names are made distinct before they are ordered, so a document is ordered by its names only. `names` is sorted;
    `capped` tells that there were more.
    """
    distinct = attachments.groupBy("doc_id", attachment_name(F.col("display_name")).alias("name")).agg(F.min("ordinal").alias("at"))
    order = Window.partitionBy("doc_id").orderBy("at", "name")
    rows = distinct.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most + 1)
    kept = F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.col("name"))))
    return rows.groupBy("doc_id").agg(kept.alias("names"), (F.max("nth") > most).alias("capped"))


def result(evidence: DataFrame) -> DataFrame:
    """doc_id, findings (in the order of the contract) and status of a document's evidence.

    Columns of `evidence`: scripts, additional, launches, embedded, links, external_forms (counts); open_action,
    acroform, xfa, encrypted, malformed, fallback (flags); reasons (array). Nulls count as absent.
    """
    n = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    partial = F.coalesce(F.size("reasons") > 0, F.lit(False))
    rules = [
        ("PDF_JAVASCRIPT", n("scripts")), ("PDF_OPEN_ACTION", flag("open_action")), ("PDF_ADDITIONAL_ACTION", n("additional")), ("PDF_LAUNCH_ACTION", n("launches")),
        ("PDF_EMBEDDED_FILE", n("embedded")), ("PDF_ACROFORM", flag("acroform")), ("PDF_XFA", flag("xfa")), ("PDF_EXTERNAL_URI", n("links")),
        ("PDF_EXTERNAL_SUBMISSION", n("external_forms")), ("PDF_ENCRYPTED", flag("encrypted")), ("PDF_MALFORMED", flag("malformed")), ("PDF_PARTIAL_ANALYSIS", partial),
        ("PDF_FALLBACK_INDICATOR", flag("fallback")),
    ]
    found = F.array_compact(F.array(*[F.when(c, code) for code, c in rules]))
    status = F.when(flag("malformed"), "MALFORMED").when(partial, "PARTIAL").otherwise("COMPLETE")
    return evidence.select("doc_id", found.alias("findings"), status.alias("status"))
