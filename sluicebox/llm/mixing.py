"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's quota of words is its target. Whole multiples of its size are whole copies of its rows;
the rest is drawn. The source's blocks (rows by hash, of bounded rows and bytes) are halved again and
again: at each node the words drawn are split hypergeometrically between the halves, and the node's
quotas for the output shards by a multivariate hypergeometric draw. So every block has an exact quota
for every shard, and a source's blocks give each shard its even part of the target. Trees have two
storeys, groups of blocks and the blocks of a group, so no task holds all blocks of a source. A block
permutes its rows, takes what its quota holds, cuts the run of taken rows at the shards' quotas, so
that shards draw disjoint rows, and every shard is shuffled locally.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import draws, shared

#: Rows and bytes for which a source has one more block.
BLOCK_ROWS, BLOCK_BYTES = 2048, 4 << 20
#: Output shards between which every quota is split.
SHARDS = 24
WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Rows (source, words, ...) with order and target: the words each source is to give.

    Shares of all words by weight, at most `most` times its own. Weights repeat along the sources in
    code-point order, null last. What a source can't take is shared anew by weight among those below
    their bound, until none is above: rounds of sums over the table, of which only sums are collected.
    """
    ranges = shared.saved(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()))
    before, at = 0, {}
    for r in ranges.groupBy("_range").count().orderBy("_range").collect():  # a row for each range of the sort
        at[r["_range"]], before = before, before + r["count"]
    if not at:
        return ranges.drop("_range").withColumns({"order": F.lit(0).cast("long"), "target": F.lit(0.0)})
    first = F.broadcast(ranges.sparkSession.createDataFrame(sorted(at.items()), "_range int, _before long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last()))
    ordered = ranges.withColumn("_place", place).join(first, "_range").withColumn("order", F.col("_before") + F.col("_place") - 1)
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("order") % len(weights) + 1).cast("int"))
    weighed = shared.saved(ordered.drop("_range", "_place", "_before").withColumns({"_weight": share, "_bound": F.col("words") * F.lit(float(most))}))
    level, known = 0.0, -1
    while True:
        # words for each unit of weight: those that it lifts over their bound keep the bound
        full = F.col("_weight") * F.lit(level) > F.col("_bound")
        total, capped, free, n_free = weighed.agg(F.sum("words"), F.sum(F.when(full, F.col("words"))), F.sum(F.when(~full, F.col("_weight"))), F.count_if(~full)).first()
        if n_free in (known, 0):  # no source was added to the full ones
            break
        level, known = (float(total or 0) - float(most) * float(capped or 0)) / free, n_free
    return weighed.withColumn("target", F.least(F.col("_weight") * F.lit(level), F.col("_bound"))).drop("_weight", "_bound")


def _even(n: int, shards: int) -> np.ndarray:
    out = np.full(shards, n // shards, np.int64)
    out[: n % shards] += 1
    return out


def _groups_share(seed: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one source: what each of its groups of blocks gives, and to which shards."""
        table = table.sort_by("_group")
        words = table.column("_words").to_numpy()
        size, target = int(words.sum()), table.column("target")[0].as_py()
        whole = int(target // size) if size else 0
        rest = min(size, max(0, round(target - whole * size)))
        quotas = draws.splitting_tree(seed + table.column("_order")[0].as_py(), words, whole, rest, _even(whole * size + rest, shards))
        return _quota_table(table.select(["_order", "_group"]), quotas, whole, size)

    return run


def _blocks_share(seed: int):
    def run(key: tuple, blocks: pa.Table, quota: pa.Table) -> pa.Table:
        """Of one group: what each of its blocks gives, and to which shards."""
        blocks = blocks.sort_by("_block")
        words = blocks.column("_words").to_numpy()
        whole, own = quota.column("_whole")[0].as_py(), np.array(quota.column("_quotas")[0].as_py(), np.int64)
        rest = int(own.sum()) - whole * int(words.sum())
        quotas = draws.splitting_tree(seed + 7919 * key[0].as_py() + 104729 * key[1].as_py(), words, whole, rest, own)
        return _quota_table(blocks.select(["_order", "_block"]), quotas, whole, quota.column("source_size")[0].as_py())

    return run


def _quota_table(table: pa.Table, quotas: np.ndarray, whole: int, size: int) -> pa.Table:
    n, shards = quotas.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * shards, pa.int32()), pa.array(quotas.ravel()))
    return table.append_column("_whole", pa.array(np.full(n, whole), pa.int64())).append_column("_quotas", lists).append_column("source_size", pa.array(np.full(n, size), pa.int64()))


def _fill(words: np.ndarray, quota: int, turns: int) -> np.ndarray:
    """How often to take rows, in their order: each that still fits, again in further turns where only longer
    rows are left; the last gap goes to the row that halves it best."""
    taken = np.zeros(len(words), np.int64)
    left = int(quota)
    for turn in range(turns):
        run = int(np.searchsorted(np.cumsum(words), left, "right"))
        taken[:run] += 1
        left -= int(words[:run].sum())
        for k in range(run, len(words)):
            if words[k] <= left:
                taken[k] += 1
                left -= int(words[k])
        if turn == 0 and left:
            gap = np.where(taken > 0, np.iinfo(np.int64).max, np.abs(words - left))
            if len(gap) and gap.min() < min(left, int(words.min(initial=left, where=words > 0))):
                taken[int(gap.argmin())] = 1
                return taken
        if not left:
            return taken
    gap = np.where(taken >= turns, np.iinfo(np.int64).max, np.abs(words - left))
    if len(gap) and gap.min() < left:
        taken[int(gap.argmin())] += 1
    return taken


def _draw(seed: int, most: int):
    def run(key: tuple, rows: pa.Table, plan: pa.Table) -> pa.Table:
        source, block = key[0].as_py(), key[1].as_py()
        whole, quotas = plan.column("_whole")[0].as_py(), np.array(plan.column("_quotas")[0].as_py(), np.int64)
        rows = rows.take(np.lexsort([rows.column(c).to_numpy() for c in ("_key2", "_key")]))
        words = rows.column("size").to_numpy()
        order = draws.generator(seed, 3, source, block).permutation(len(words))
        copies = np.full(len(words), whole, np.int64)
        copies[order] += _fill(words[order], int(quotas.sum()) - whole * int(words.sum()), max(1, most - whole))
        # copies in permuted order, one round of the rows after the other, cut at the shards' quotas
        turn = np.concatenate([order[copies[order] > c] for c in range(int(copies.max(initial=0)))] or [np.zeros(0, np.int64)])
        middle = np.cumsum(words[turn]) - (words[turn] + 1) // 2
        shard = np.minimum(np.searchsorted(np.cumsum(quotas), middle, "right"), len(quotas) - 1)
        by_row = np.argsort(turn, kind="stable")
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(copies)]), pa.int32()), pa.array(shard[by_row], pa.int32()))
        n = len(words)
        out = rows.drop_columns(["_order", "_block", "_key", "_key2"])
        for name, value in (("source_size", np.full(n, plan.column("source_size")[0].as_py(), np.int64)), ("target", np.full(n, plan.column("target")[0].as_py(), np.float64)), ("copies", copies), ("taken", copies * words)):
            out = out.append_column(name, pa.array(value))
        return out.append_column("mix_shards", lists)

    return run


_NEW = ("size", "source_size", "target", "copies", "taken", "mix_shards")


def mix(df: DataFrame, source_column: str = "source", text_column: str = "text", size_column: str | None = None, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, shards: int = SHARDS, seed: int = 29) -> DataFrame:
    """df with size, source_size, target, copies, taken and mix_shards (the output shard of each copy).

    size is the number of words of the text (null: 0), or size_column if given. A source's targets are
    those of `source_targets`; its taken words differ from its target by about one row's size at most for each
    of its blocks, mostly much less, and so do the words that a shard gets of it from an even part of
    the target. copies is the whole part of target / source_size or one more, and up to `most` only where
    the rows that are left are too long for what is left.
    Rows without a source are a source, the last. Sources without words have target and copies 0.
    Equal rows are told apart by nothing, so which of them is taken once more doesn't matter. Columns
    with these names are replaced; an empty df stays empty. Reruns agree for any partitioning.
    """
    size = F.col(f"`{size_column}`") if size_column else F.coalesce(F.regexp_count(F.col(f"`{text_column}`"), F.lit(WORDS)), F.lit(0))
    columns = [c for c in df.columns if c not in _NEW]
    rows = df.select(*[F.col(f"`{c}`") for c in columns], size.cast("long").alias("size"))
    keys = [F.col(f"`{c}`") for c in columns]
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.select(*keys).schema if f.dataType.simpleString() in ("string", "binary")]
    source = F.col(f"`{source_column}`").cast("string")
    keyed = rows.withColumns({"_key": F.xxhash64(*keys), "_key2": F.xxhash64(F.lit(seed), *keys[::-1])})
    # texts are read once for sizes and once to be dealt; all planning is on this narrow table
    narrow = shared.saved(keyed.select(source.alias("source"), F.col("size"), F.col("_key2"), sum(wide, F.lit(0).cast("long")).alias("bytes")))
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    goal = source_targets(sizes, weights, most)
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES))
    plan = shared.saved(goal.select(F.col("source").alias("_source"), F.col("order").alias("_order"), "target", blocks.cast("long").alias("_blocks")).withColumn("_groups", F.ceil(F.sqrt("_blocks")).cast("long")))
    small = shared.small(plan)
    place = lambda t, name: t.join(small, F.col(name).cast("string").eqNullSafe(F.col("_source"))).withColumn("_block", F.pmod(F.col("_key2"), F.col("_blocks")))
    stats = shared.saved(place(narrow, "source").groupBy("_order", "_block").agg(F.sum("size").alias("_words"), F.first("target").alias("target"), F.first("_groups").alias("_groups")).withColumn("_group", F.pmod(F.col("_block"), F.col("_groups"))))
    per_group = stats.groupBy("_order", "_group").agg(F.sum("_words").alias("_words"), F.first("target").alias("target"))
    quota = "_whole long, _quotas array<long>, source_size long"
    groups = per_group.groupBy("_order").applyInArrow(_groups_share(seed, shards), f"_order long, _group long, {quota}")
    quotas = stats.select("_order", "_group", "_block", "_words").groupBy("_order", "_group").cogroup(groups.groupBy("_order", "_group")).applyInArrow(_blocks_share(seed), f"_order long, _block long, {quota}")
    quotas = quotas.join(shared.small(plan.select("_order", "target")), "_order")
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = place(keyed, f"`{source_column}`").select(*[F.col(f"`{c}`") for c in rows.columns], "_key", "_key2", "_order", "_block")
    return placed.groupBy("_order", "_block").cogroup(quotas.groupBy("_order", "_block")).applyInArrow(_draw(seed, int(most)), f"{base}, source_size long, target double, copies long, taken long, mix_shards array<int>")


def copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each copy that the mix takes, with its output shard as mix_shard."""
    return mixed.select(*[F.col(f"`{c}`") for c in columns], F.explode("mix_shards").alias("mix_shard"))


def shuffled(taken: DataFrame, seed: int = 31) -> DataFrame:
    """The rows of `copies`, a shard's together and in a random order of their own.

    A shard lies in as many partitions as its part of spark.sql.shuffle.partitions. The order is by a hash
    of the row, so reruns agree; equal rows stand together in their partition.
    """
    pieces = -(-shared.shuffle_partitions(taken.sparkSession) // SHARDS)
    order = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in taken.columns])
    return taken.withColumn("_order", order).repartition("mix_shard", F.pmod(F.col("_order"), F.lit(pieces))).sortWithinPartitions("mix_shard", "_order").drop("_order")
