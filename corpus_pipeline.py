"""The corpus pipeline: toxic documents out, near duplicates out, benchmark passages out, mixed, sharded.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.llm import decontaminate, mixing, near_dedup, sharding, shared, toxicity

SHARDS = 24


def _set_aside(docs: DataFrame) -> DataFrame:
    """Documents with their other columns under names that no operator uses; `_own` gives them back."""
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c not in ("doc_id", "text", "source")})


def _own(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`" if c in ("doc_id", "text", "source") else f"`_own_{c}`").alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the model is fitted to the labelled ones among them.

    Null and empty texts score the least and stay, as do rows that repeat; without labels the built-in
    model scores.
    """
    shared.narrow_batches(spark)
    model = toxicity.fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _own(toxicity.score(_set_aside(docs), model).where("predicted = 0"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of the smallest id, without an id last. Five words, a similarity of 0.8.

    Rows are linked and dropped by a number of their own, so ids may repeat or be null; rows of one id
    are ordered by a hash of all columns.
    """
    shared.narrow_batches(spark)
    keyed = shared.saved(docs.withColumns({"_row": F.monotonically_increasing_id(), "_hash": F.xxhash64(*docs.columns)}))
    near = near_dedup.near_duplicates(keyed, id_column="_row", shingle=5, similarity=0.8)
    found = shared.saved(near.select(F.col("doc_id").alias("_row"), "component_id", "kept"))
    # groups are named by their smallest number; where another row has the smallest id, that is kept instead
    first = F.min_by("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_hash", "_row"))
    moved = shared.saved(found.join(keyed.select("_row", "doc_id", "_hash"), "_row").groupBy("component_id").agg(first.alias("best")).where("best <> component_id"))
    dropped = found.where("NOT kept").select("_row").unionAll(moved.select(F.col("component_id").alias("_row")))
    dropped = shared.saved(dropped.join(shared.small(moved.select(F.col("best").alias("_row"))), "_row", "left_anti"))
    return keyed.join(shared.small(dropped), "_row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is in benchmark passages.

    Each row is judged by its text, so rows may repeat; null and empty texts stay, and so does everything
    where the benchmark is empty.
    """
    shared.narrow_batches(spark)
    found = decontaminate.find_contamination(_set_aside(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _own(found.where("NOT contaminated"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, none included; the copies of an output shard together.

    Texts of null have no words and are taken as often as their source's whole copies; a source without
    words gives nothing. Equal rows are taken each by itself; an empty table stays empty.
    """
    shared.narrow_batches(spark)
    own = _set_aside(docs)
    return _own(mixing.shuffled(mixing.copies(mixing.mix(own), own.columns)), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot, which replace columns so named; nulls and repeated rows are rows like others."""
    return sharding.shard_rows(docs, SHARDS)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard)]

#: Fitted models and similarity groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else shared.saved(docs), sf_dir)
    return docs
