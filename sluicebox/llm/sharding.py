"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt by a hash into parts. How many rows of each part go to each cell (a piece of a shard,
of a bounded number of rows) is drawn exactly, as if all rows had been permuted. A part permutes its
rows and sends them in those counts; a cell permutes what arrives. So every permutation is equally
likely, shard sizes differ by one at most, and no task holds more than a part or a cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import draws, shared

#: Rows and text bytes for which a part or cell is made.
CELL_ROWS, CELL_BYTES = 50_000, 16 << 20


def _cells(total: int, shards: int, per_shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell: its shard, its rows, and its first slot."""
    size = np.full(shards, total // shards, np.int64)
    size[: total % shards] += 1
    rows = np.repeat(size // per_shard, per_shard).reshape(shards, per_shard)
    rows += np.arange(per_shard) < (size % per_shard)[:, None]
    slot = np.cumsum(rows, axis=1) - rows
    return np.repeat(np.arange(shards), per_shard), rows.ravel(), slot.ravel()


def _sorted(table: pa.Table, keys: tuple[str, ...]) -> pa.Table:
    return table.take(np.lexsort([table.column(k).to_numpy() for k in keys]))


def _deal(seed: int, counts: np.ndarray, cells: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("_part")[0].as_py()
        table = _sorted(table, ("_key2", "_key"))
        table = table.take(draws.generator(seed, 1, part).permutation(len(table)))
        cell = np.repeat(np.arange(len(cells)), draws.row_of_matrix(seed, counts, cells, part))
        return table.append_column("_cell", pa.array(cell, pa.int32())).append_column("_place", pa.array(np.arange(len(table)), pa.int32()))

    return run


def _settle(seed: int, shard: np.ndarray, slot: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        cell = table.column("_cell")[0].as_py()
        table = _sorted(table, ("_place", "_part"))
        table = table.take(draws.generator(seed, 2, cell).permutation(len(table))).drop_columns(["_part", "_key", "_key2", "_cell", "_place"])
        table = table.append_column("shard", pa.array(np.full(len(table), shard[cell]), pa.int32()))
        return table.append_column("slot", pa.array(slot[cell] + np.arange(len(table)), pa.int64()))

    return run


def shard_rows(df: DataFrame, shards: int, seed: int = 17, cell_rows: int = CELL_ROWS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in each shard); columns so named are replaced.

    The order is a function of the rows and the seed: it doesn't depend on how df is partitioned, and
    reruns agree. Equal rows are interchangeable. Nulls, empty and long texts are rows like others;
    an empty df stays empty, and shards that get no row don't show.
    """
    rows = df.drop("shard", "slot")
    names = rows.columns
    spark = df.sparkSession
    lengths = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in rows.schema if f.dataType.simpleString() in ("string", "binary")]
    weight = sum(lengths, F.lit(0).cast("long"))
    columns = [F.col(f"`{c}`") for c in names]
    keyed = rows.withColumns({"_key": F.xxhash64(*columns), "_key2": F.xxhash64(F.lit(seed), *columns[::-1])})
    total, size = rows.agg(F.count(F.lit(1)), F.sum(weight)).first()
    if not total:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    parts = max(shared.shuffle_partitions(spark), -(-total // cell_rows), -(-(size or 0) // cell_bytes))
    per_shard = max(1, -(-total // (shards * cell_rows)), -(-(size or 0) // (shards * cell_bytes)))
    dealt = keyed.withColumn("_part", F.pmod(F.col("_key2"), F.lit(parts)).cast("int"))
    found = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.array([found.get(p, 0) for p in range(parts)], np.int64)
    shard, cells, slot = _cells(total, shards, per_shard)
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    sent = dealt.groupBy("_part").applyInArrow(_deal(seed, counts, cells), f"{base}, `_cell` int, `_place` int")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return sent.groupBy("_cell").applyInArrow(_settle(seed, shard, slot), f"{own}, `shard` int, `slot` long")
