"""What a file is: its family by leading bytes, the analysis it is routed to, and the scan's status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Leading bytes of the families, in hex. Archives begin with a member, an empty directory or a span mark.
SIGNATURES = {
    "PDF": ["255044462D"],
    "OLE_COMPOUND": ["D0CF11E0A1B11AE1"],
    "ZIP": ["504B0304", "504B0506", "504B0708"],
    "WINDOWS_EXECUTABLE": ["4D5A"],
}
PACKAGED = ("ZIP", "OOXML_CANDIDATE", "OLE_COMPOUND")


def family_of_bytes(content: Column) -> Column:
    """The family of some content (binary) by its first bytes.

    Content with none of the signatures is TEXT if it holds no zero byte; empty and null content is UNKNOWN.
    """
    out = F.when(content.isNull() | (F.octet_length(content) == 0), "UNKNOWN")
    for family, prefixes in SIGNATURES.items():
        for p in prefixes:
            out = out.when(F.startswith(content, F.lit(bytearray.fromhex(p))), family)
    return out.when(F.contains(content, F.lit(bytearray(1))), "UNKNOWN").otherwise("TEXT")


def routed(files: DataFrame, packages: DataFrame, compounds: DataFrame) -> DataFrame:
    """Files (scan_id, family) with the type that their analysis found.

    `packages` and `compounds` (doc_id, application) are the results on packages and compound files. A known
    application overrides the family; an archive without one stays an archive, whichever family it came as, and a
    compound file without one keeps its family.
    """
    of = lambda df, name: df.select(F.col("doc_id").alias("scan_id"), F.when(F.col("application") != "unknown", F.upper("application")).alias(name))
    rows = files.join(of(packages, "_package"), "scan_id", "left").join(of(compounds, "_compound"), "scan_id", "left")
    package = F.when(F.col("family").isin("ZIP", "OOXML_CANDIDATE"), F.col("_package"))
    compound = F.when(F.col("family") == "OLE_COMPOUND", F.col("_compound"))
    kind = (
        F.when(package.isNotNull(), F.concat(F.lit("OFFICE_"), package, F.lit("_OOXML")))
        .when(compound.isNotNull(), F.concat(F.lit("OFFICE_"), compound, F.lit("_OLE")))
        .when(F.col("family") == "OOXML_CANDIDATE", "ZIP")
        .otherwise(F.col("family"))
    )
    return rows.withColumn("detected_type", kind).drop("_package", "_compound")


def scan_status(family: Column, page_complete: Column, package_complete: Column, rules_complete: Column) -> Column:
    """SUCCESS, or UNSUPPORTED for an unknown family; an analysis that ran and wasn't complete makes it FAILED.

    A null flag means that the analysis did not run.
    """
    broken = lambda ran, complete: ran & ~F.coalesce(complete, F.lit(True))
    failed = broken(family == "PDF", page_complete) | broken(family.isin(*PACKAGED), package_complete) | broken(F.lit(True), rules_complete)
    return F.when(failed, "FAILED").when(family == "UNKNOWN", "UNSUPPORTED").otherwise("SUCCESS")
