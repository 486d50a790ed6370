"""Objects of a store as rows: what a folder holds, without reading it; digests where they are asked for."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, root: str) -> DataFrame:
    parts = F.split("path", "/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.withColumns({"area": F.element_at(parts, -2), "name": F.element_at(parts, -1)})


def listed(spark: SparkSession, root: str) -> DataFrame:
    """area, name, size_bytes, modified_at (seconds) of the files of a store's areas. Contents aren't read; names with a dot first are left out."""
    return _files(spark, root).select("area", "name", F.col("length").alias("size_bytes"), F.unix_seconds("modificationTime").alias("modified_at")).where(~F.startswith("name", F.lit(".")))


def digested(spark: SparkSession, root: str) -> DataFrame:
    """area, name, sha of the same files; this reads them."""
    return _files(spark, root).select("area", "name", F.sha2("content", 256).alias("sha")).where(~F.startswith("name", F.lit(".")))


def attributes(folders: DataFrame) -> DataFrame:
    """area, name, kind (file, link, folder, other), links, mode, size_bytes, modified_at of all entries of folders (path) of a mounted store.

    Tasks list a folder each, entry by entry, hidden ones too; links aren't followed. Entries that vanish meanwhile and folders that aren't
    there give no rows.
    """
    names = ("area", "name", "kind", "links", "mode", "size_bytes", "modified_at")
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                try:
                    entries = os.scandir(path)
                except OSError:
                    continue
                with entries:
                    for entry in entries:
                        try:
                            s = entry.stat(follow_symlinks=False)
                        except OSError:
                            continue
                        kind = "link" if stat.S_ISLNK(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "folder" if stat.S_ISDIR(s.st_mode) else "other"
                        rows.append((os.path.basename(path.rstrip("/")), entry.name, kind, s.st_nlink, stat.S_IMODE(s.st_mode), s.st_size, int(s.st_mtime)))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))

    return folders.select("path").mapInArrow(scan, "area string, name string, kind string, links long, mode long, size_bytes long, modified_at long")
