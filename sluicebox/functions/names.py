"""Column functions on file names, paths, MIME types, link targets and keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.dims import BIDI, BUSINESS, DANGEROUS

_ODD = "[\\p{C}" + BIDI + "]"


def basename(v: Column) -> Column:
    """The last component of a path in either slash style; trailing slashes don't count."""
    return F.substring_index(F.rtrim(F.replace(v, F.lit("\\"), F.lit("/")), F.lit("/")), "/", -1)


def segments(v: Column) -> Column:
    return F.split(F.lower(basename(v)), "\\.")


def final_extension(v: Column) -> Column:
    """The part after the last dot, null without a dot; a dot file has one."""
    base = basename(v)
    return F.when(F.contains(base, F.lit(".")), F.lower(F.substring_index(base, ".", -1)))


def double_extension(v: Column) -> Column:
    """A dangerous last extension behind a document extension that isn't the first part."""
    s = segments(v)
    middle = F.slice(s, 2, F.greatest(F.size(s) - 2, F.lit(0)))
    return final_extension(v).isin(*DANGEROUS) & (F.size(s) >= 3) & F.arrays_overlap(middle, F.array(*map(F.lit, BUSINESS)))


def bidi_marks(v: Column, most: int = 16) -> Column:
    """Direction marks in order, as U+XXXX, the first `most`."""
    return F.slice(F.transform(F.regexp_extract_all(v, F.lit(f"([{BIDI}])"), F.lit(1)), lambda c: F.concat(F.lit("U+"), F.lpad(_point(c), 4, "0"))), 1, most)


def has_bidi_marks(v: Column) -> Column:
    return (F.octet_length(v) > F.length(v)) & F.regexp_like(v, F.lit(f"[{BIDI}]"))


def _point(c: Column) -> Column:
    """The hex code point of a character of two UTF-16 bytes."""
    return F.hex(F.encode(c, "UTF-16BE"))


def catalog_extension(v: Column) -> Column:
    """The suffix of the base name, null for dot files and beyond 32 characters."""
    found = F.regexp_extract(basename(v), "^.*[^.].*\\.([^.]+)$|^[^.]+\\.([^.]+)$", 0)
    ext = F.lower(F.element_at(F.split(found, "\\."), -1))
    return F.when((found != "") & (F.length(ext) <= 32), ext)


def mime_type(v: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.substring_index(v, ";", 1))), F.lit(""))


def content_type(v: Column, most: int = 255) -> Column:
    return F.nullif(F.substring(F.trim(v), 1, most), F.lit(""))


def beyond_ascii(v: Column) -> Column:
    return F.coalesce(F.octet_length(v) > F.length(v), F.lit(False))


def collision_key(v: Column) -> Column:
    """A composed member name without empty and `.` parts; case and `..` stay.

    Composed by ICU, which comes with Spark: rows that went through Python would lose where they have been dealt to, and be shuffled again.
    """
    composed_here = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), v, F.lit(False))
    return portable(F.when(beyond_ascii(v), composed_here).otherwise(v))


def portable(v: Column) -> Column:
    """A name without empty and `.` parts."""
    n = F.replace(v, F.lit("\\"), F.lit("/"))
    parts = F.concat(F.when(F.startswith(n, F.lit("/")), "/").otherwise(""), F.array_join(F.filter(F.split(n, "/"), lambda p: ~p.isin("", ".")), "/"))
    has, ends = lambda x: F.contains(n, F.lit(x)), lambda x: F.endswith(n, F.lit(x))
    return F.when(has("//") | has("/./") | F.startswith(n, F.lit("./")) | ends("/") | ends("/.") | (n == "."), parts).otherwise(n)


def bounded(v: Column, most: int) -> Column:
    """Without control and direction characters, cut."""
    return F.substring(F.regexp_replace(v, _ODD, ""), 1, most)


def _escaped(v: Column) -> Column:
    chars = F.transform(F.split(v, ""), lambda c: F.when(F.regexp_like(c, F.lit(_ODD)), F.concat(F.lit("\\u"), F.lower(F.lpad(_point(c), 4, "0")))).otherwise(c))
    return F.array_join(chars, "")


def escaped_member(v: Column, most: int = 256, default: str = "unnamed") -> Column:
    """Control and direction characters as \\uXXXX, cut; empty names get a default."""
    return F.coalesce(F.nullif(F.substring(_escaped(v), 1, most), F.lit("")), F.lit(default))


def escaped_cut(v: Column, most: int = 256) -> Column:
    """Whether an escaped name was longer."""
    return F.coalesce(F.length(_escaped(v)) > most, F.lit(False))


@F.pandas_udf(StringType())
def _nfc(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed(v: Column) -> Column:
    """Canonically composed. The batches of all rows go through Python, names of ASCII as nulls: measured at 600,000 names, that takes less than reading the rows twice to keep those out."""
    beyond = beyond_ascii(v)
    return F.when(beyond, _nfc(F.when(beyond, v))).otherwise(v)


def display_name(v: Column, most: int = 255, default: str = "document") -> Column:
    """A composed, printable name without path separators. Only names beyond ASCII go through Python."""
    n = composed(v)
    n = F.trim(F.regexp_replace(n, "[\\x00-\\x1F\\x7F]", ""))
    n = F.regexp_replace(F.regexp_replace(n, f"[{BIDI}]", ""), "[/\\\\]", "_")
    return F.substring(F.when(n.isin("", ".", ".."), default).otherwise(n), 1, most)


def link_scheme(v: Column) -> Column:
    s = F.when(F.startswith(v, F.lit("\\\\")) | F.startswith(v, F.lit("//")), "unc").otherwise(F.lower(F.regexp_extract(v, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)))
    return F.substring(F.nullif(s, F.lit("")), 1, 32)


def link_host(v: Column) -> Column:
    """The host of a link or UNC path, lower case, without credentials and port."""
    unc = F.regexp_extract(F.replace(v, F.lit("\\"), F.lit("/")), "^//([^/]+)", 1)
    url = F.regexp_extract(v, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.substring(F.nullif(F.lower(F.when(link_scheme(v) == "unc", unc).otherwise(url)), F.lit("")), 1, 128)


def link_status(v: Column) -> Column:
    return F.when(v.isNull() | (F.trim(v) == ""), "missing").when(link_scheme(v).isNull(), "invalid").otherwise("parsed")


def link_summary(v: Column, rel_type: Column, most: int = 256, longest: int = 2048) -> Column:
    """What is kept of a link: scheme, hostname and parse_status of its first characters, the last part of its relationship's type, its length, and whether that is over the limit."""
    short = F.substring(v, 1, most)
    return F.struct(link_scheme(short).alias("scheme"), link_host(short).alias("hostname"), link_status(short).alias("parse_status"), F.substring_index(rel_type, "/", -1).alias("relationship"), F.length(v).cast("long").alias("target_length"), (F.length(v) > longest).alias("truncated"))


def storage_key_ok(v: Column) -> Column:
    return F.coalesce(F.regexp_like(v, F.lit("^[0-9a-f]{32}$")), F.lit(False))


def username(v: Column) -> Column:
    n = F.lower(F.trim(v))
    return F.when(F.regexp_like(n, F.lit("^[a-z0-9._#-]{3,64}$")), n)


def keyed_digest(kind: str, v: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.sha2(v, 256))


def family(mime: Column, description: Column) -> Column:
    """The file family from a MIME type and a description; the first rule that fits."""
    m, d = F.lower(mime), F.lower(description)
    return (
        F.when((m == "application/pdf") | F.contains(d, F.lit("pdf document")), "PDF")
        .when(m.isin("application/vnd.microsoft.portable-executable", "application/x-dosexec") | F.regexp_like(d, F.lit("^(pe32|pe |ms-dos executable)")), "WINDOWS_EXECUTABLE")
        .when(m.isin("application/msword", "application/encrypted", "application/vnd.ms-excel", "application/vnd.ms-powerpoint", "application/x-ole-storage") | F.regexp_like(d, F.lit("composite document file|cdfv2 ")), "OLE_COMPOUND")
        .when(F.contains(m, F.lit("officedocument")) | F.regexp_like(d, F.lit("microsoft (word|excel|powerpoint) 2007\\+")), "OOXML_CANDIDATE")
        .when(m.isin("application/zip", "application/x-zip") | F.contains(d, F.lit("zip archive")), "ZIP")
        .when(F.startswith(m, F.lit("text/")) | F.endswith(d, F.lit(" text")), "TEXT")
        .otherwise("UNKNOWN")
    )
