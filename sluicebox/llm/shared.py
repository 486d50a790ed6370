"""What the operators of this subpackage share: written tables, id ranges, checked joins, components."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id sets of up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows and bytes of an Arrow batch that a task hands to Python.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one in the session's warehouse where none is set.

    Driver and executors read both. Tables written there are left to whoever clears that folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    return (at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_written").rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it: a cut lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow_batches(spark: SparkSession) -> None:
    """Hand Python at most 1000 rows and about 8 MB at a time; fewer rows where the session asks for that."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(ids: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast a narrow table, after a count has shown that it has at most `most` rows."""
    rows = ids.count() if rows is None else rows
    return F.broadcast(ids) if rows <= most else ids


def range_bounds(df: DataFrame, column: str, n: int) -> list:
    """n - 1 or fewer ascending inner bounds that split a long column into about equal numbers of rows."""
    if n < 2:
        return []
    found = df.select(column).where(F.col(column).isNotNull()).approxQuantile(column, [k / n for k in range(1, n)], 0.25 / n)
    return sorted({int(x) for x in found})


def byte_bounds(df: DataFrame, column: str, size: Column, n: int, fine: int = 8) -> list:
    """Ascending inner bounds that split a long column into about n ranges of about equal sums of `size`.

    Finer ranges of equal numbers of rows are joined until they hold a range's part, so long rows that stand
    together don't make a range much larger than its part.
    """
    bounds = range_bounds(df, column, n * fine)
    if not bounds:
        return []
    found = {r["b"]: r["s"] for r in df.where(F.col(column).isNotNull()).groupBy(range_block(F.col(column), bounds).alias("b")).agg(F.sum(size).alias("s")).collect()}
    part, held, out = sum(found.values()) / n, 0, []
    for k, bound in enumerate(bounds):
        held += found.get(k, 0)
        if held and held + found.get(k + 1, 0) / 2 >= part:
            out.append(bound)
            held = 0
    return out


def range_block(column: Column, bounds: list) -> Column:
    """The number of bounds at or below a value: 0 to len(bounds); nulls come after all.

    The bounds are searched in two levels, each of about the square root of their number.
    """
    if not bounds:
        return F.when(column.isNull(), F.lit(1)).otherwise(F.lit(0))
    step = max(1, math.isqrt(len(bounds)))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(r[0]).cast("long") for r in rows])
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in r]) for r in rows])
    at = F.size(F.filter(heads, lambda x: x <= column))
    within = F.size(F.filter(F.element_at(table, F.greatest(at, F.lit(1))), lambda x: x <= column))
    return F.when(column.isNull(), F.lit(len(bounds) + 1)).when(at == 0, F.lit(0)).otherwise((at - 1) * step + within)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (id, component), component the smallest id reachable.

    In a round every node takes the smallest of itself and its neighbours as label, follows that label
    once, and links are drawn between labels instead of nodes; those within one label go. So links
    shrink from round to round; each is a written table. Empty links give no rows; repeated links and
    links of a node to itself change nothing.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long"))
    both = saved(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    named = both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id"))
    both = both.where("a <> b")
    while both.limit(1).count():
        low = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
        ends = low.select(F.col("node").alias("label"), F.col("label").alias("end"))
        step = saved(low.join(ends, "label", "left").select("node", F.least("label", F.coalesce("end", "label")).alias("label")))
        named = saved(named.join(step.withColumnRenamed("node", "component"), "component", "left").select("id", F.coalesce("label", "component").alias("component")))
        moved = both.join(step.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        both = saved(moved.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    return saved(named)
