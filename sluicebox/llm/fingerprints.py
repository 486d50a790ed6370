"""Document fingerprints from statistically improbable features.

Every byte window has an entropy. Windows whose entropy is rare in the corpus come first: the rank
of an entropy is its place among all entropies by their count. A window that is the rarest of many
neighbourhoods in a row is a feature. Features go, in text order, into Bloom filters of a fixed size;
a full filter is followed by another. Two fingerprints are alike by the bits that their filters share
beyond what filters so full share by chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .text import U64, buffers, byte_hashes, mix, pieces

#: Window bytes; shorter texts have smaller windows, see `window_bytes`.
WINDOW = 32
#: Windows of a neighbourhood, and how many neighbourhoods a feature leads.
NEIGHBOURS, LEADS = 32, 8
#: Filter bits, features a filter takes, and bits a feature sets.
BITS, FILTER_FEATURES, FEATURE_BITS = 2048, 128, 5
#: Text bytes of a range of ids that one task pairs.
RANGE_BYTES = 16 << 20
#: Entropy classes; the lowest tenth (runs, patterns) makes no features.
CLASSES = 1000
LOWEST_CLASS = CLASSES // 10


def window_bytes(n: int) -> int:
    """32 from 128 bytes on, else the largest power of two at most a quarter of the text; 1 at least."""
    return WINDOW if n >= 4 * WINDOW else max(1, 1 << max(0, n // 4).bit_length() - 1) if n >= 4 else 1


def _entropies(data: np.ndarray, w: int) -> np.ndarray:
    """The entropy class of the window at each byte (w bytes; len(data) - w + 1 of them).

    Sums of count * log(count) are carried from window to window: one byte leaves, one enters, and
    how often each occurs in its window is counted by comparing the bytes w - 1 times with shifted ones.
    """
    n = len(data)
    if w == 1:
        return np.full(n, CLASSES - 1, np.int64)
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for d in range(1, w):
        same = (data[d:] == data[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    c = np.arange(w + 1, dtype=np.float64)
    f = np.zeros(w + 1)
    f[1:] = c[1:] * np.log2(c[1:])
    gain = np.zeros(w + 1, np.int64)  # scaled to whole numbers: sums are the same on any path
    gain[1:] = np.rint((f[1:] - f[:-1]) * 2**20)
    head = np.sort(data[:w])
    counts = np.unique(head, return_counts=True)[1]
    total = np.empty(n - w + 1, np.int64)
    total[0] = sum(int(gain[1 : k + 1].sum()) for k in counts)
    total[1:] = gain[behind[w:]] - gain[ahead[: n - w]]
    total = np.cumsum(total)
    most = w * np.log2(w) * 2**20
    return np.clip(((1 - total / most) * (CLASSES - 1)).astype(np.int64), 0, CLASSES - 1)


def _leaders(rank: np.ndarray, span: int) -> np.ndarray:
    """Of each run of `span` consecutive windows, the leftmost of the rarest."""
    key = (rank.astype(np.int64) << 40) | np.arange(len(rank))
    low, size = key, 1
    while size < span:
        step = min(size, span - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    return low & ((1 << 40) - 1)


def _inside(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of some disjoint ranges."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps)[:n] > 0


def _picks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: int, ranks: np.ndarray) -> np.ndarray:
    """The first bytes of the features of some texts of a buffer that share the window size w."""
    classes = _entropies(data, w)
    rank = np.where(classes < LOWEST_CLASS, CLASSES + 1, ranks[classes])
    span = int(min(NEIGHBOURS, (ends - starts).min() - w + 1))
    led = _leaders(rank, span)
    led = led[_inside(len(led), starts, ends - w - span + 2)]
    leads = np.bincount(led, minlength=len(rank))
    picked = np.flatnonzero((leads >= max(1, min(LEADS, span // 4))) & (rank <= CLASSES))
    # a flat text has none: its first window stands for it
    none = np.searchsorted(picked, starts) == np.searchsorted(picked, ends)
    return np.sort(np.concatenate([picked, starts[none]])) if none.any() else picked


def fingerprint_rows(data: np.ndarray, offs: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    """The chained Bloom filters (filters x bytes) of each text of a buffer."""
    out: list[np.ndarray] = []
    for i, j in pieces(offs, 256 << 10):
        part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        lengths = np.diff(at)
        sizes = np.array([window_bytes(int(n)) for n in lengths])
        row, h = [], []
        for w in np.unique(sizes[lengths > 0]):
            for some in [np.flatnonzero((sizes == w) & (lengths > 0))] if w == WINDOW else np.flatnonzero((sizes == w) & (lengths > 0))[:, None]:
                first, last = (0, len(part)) if w == WINDOW else (at[some[0]], at[some[0] + 1])
                picked = _picks(part[first:last], at[some] - first, at[some + 1] - first, int(w), ranks)
                row.append(np.searchsorted(at, picked + first, "right") - 1)
                h.append(mix(byte_hashes(part[first:last], picked, picked + w)))
        out += _filters(np.concatenate(row), np.concatenate(h), j - i) if row else [np.zeros((0, BITS // 8), np.uint8)] * (j - i)
    return out


def _filters(row: np.ndarray, h: np.ndarray, rows: int) -> list[np.ndarray]:
    """The filter chains of features given in text order by row."""
    order = np.lexsort((np.arange(len(h)), h, row))
    again = np.zeros(len(h), bool)
    again[1:] = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    keep = np.sort(order[~again])
    row, h = row[keep], h[keep]
    by_row = np.argsort(row, kind="stable")
    row, h = row[by_row], h[by_row]
    n = np.bincount(row, minlength=rows)
    chains = -(-n // FILTER_FEATURES)
    ends = np.concatenate([[0], np.cumsum(chains)])
    place = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    which = ends[row] + place // FILTER_FEATURES
    bits = np.zeros((int(ends[-1]), BITS), bool)
    for k in range(FEATURE_BITS):
        bits[which, ((h >> U64(11 * k)) & U64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[ends[r] : ends[r + 1]] for r in range(rows)]


def fingerprint(text: str, ranks: np.ndarray) -> np.ndarray:
    """The filter chain of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return fingerprint_rows(raw, np.array([0, len(raw)]), ranks)[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain takes its best partner's share of common bits beyond chance."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total, weight = 0.0, 0.0
    for x, n in zip(a, na, strict=True):
        common = np.bitwise_count(b & x).sum(axis=1, dtype=np.int64)
        chance = n * nb / BITS
        total += float(n * max(0.0, ((common - chance) / np.maximum(np.maximum(n, nb) - chance, 1e-9)).max()))
    weight = max(int(na.sum()), int(nb.sum()))
    return min(1.0, total / weight)


def encode(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def _count_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CLASSES, np.int64)
    for batch in batches:
        data, offs = buffers(batch.column(0))
        for i, j in pieces(offs, 256 << 10):
            part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            if len(part) < WINDOW:
                continue
            classes = _entropies(part, WINDOW)  # windows across two texts are left out
            ok = np.diff(at) >= WINDOW
            counts += np.bincount(classes[_inside(len(classes), at[:-1][ok], at[1:][ok] - WINDOW + 1)], minlength=CLASSES)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(counts)], names=["class", "n"])


def entropy_ranks(texts: DataFrame) -> np.ndarray:
    """The rank of each entropy class, rarest first, by all windows of all texts of a one-column table."""
    rows = texts.mapInArrow(_count_classes, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(CLASSES, np.int64)
    for r in rows:  # as many as there are classes
        n[r["class"]] = r["n"]
    ranks = np.empty(CLASSES, np.int64)
    ranks[np.lexsort((np.arange(CLASSES), n))] = np.arange(CLASSES)
    return ranks


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id and fingerprint (base64 of the filter chain) of each row of df.

    Null and empty texts have the empty fingerprint. Equal texts have equal ones, given the same
    ranks; without ranks those of df's texts are taken. Other columns don't matter.
    """
    docs = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    ranks = entropy_ranks(docs.select("text")) if ranks is None else ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(1))
            out = [encode(chain) for chain in fingerprint_rows(data, offs, ranks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


_EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(text: str, after: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def edit_likeness(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row against an edited text of its own and against the next row.

    Rows are taken by descending id, rows without an id last, rows that repeat an id by descending
    text. The edited text is the row's, its last third (in code points, rounded down) replaced by as
    many code points of the next row's, or all; the next of the last row is the first. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; nulls are empty texts.

    Texts travel once, to ranges of ids; the greatest row of each range is also sent to the range
    above it, whose last row it follows. These extra rows are as many as there are ranges.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ranks = entropy_ranks(docs.select("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(shared.shuffle_partitions(spark), -(-size // RANGE_BYTES))
    bounds = shared.byte_bounds(docs, "doc_id", F.octet_length("text") + 16, n)
    # descending: nulls are below all ids, so they come first of all ranges when ascending
    block = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(shared.range_block(F.col("doc_id"), bounds) + 1).cast("int")
    placed = docs.withColumn("block", block)
    tops = sorted((r["block"], r["top"], r["n"]) for r in placed.groupBy("block").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")).collect())
    above = {b: tops[(k + 1) % len(tops)][0] for k, (b, _, _) in enumerate(tops)}
    if not tops:
        return spark.createDataFrame([], _EDITS)
    # one row for each range: its top row also goes to the range above, the last one's to the first
    tops_df = spark.createDataFrame([(b, t, above[b]) for b, t, _ in tops], "block int, top long, also int")
    placed = placed.join(F.broadcast(tops_df), (placed["block"] == tops_df["block"]) & placed["doc_id"].eqNullSafe(tops_df["top"]), "left").select(placed["block"], "doc_id", "text", "also")
    own = F.struct(F.col("block").alias("to"), F.lit(0).alias("extra"))
    sent = F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("also").alias("to"), F.lit(1).alias("extra"))))
    rows = placed.select(F.explode(sent).alias("s"), "doc_id", "text").select("s.to", "s.extra", "doc_id", "text")
    dealt = rows.repartition(len(bounds) + 2, "to").sortWithinPartitions("to", "extra", F.desc_nulls_last("doc_id"), F.desc("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, id, text, filters) of a row to be paired with the one that follows
        for batch in batches:
            data, offs = buffers(batch.column(3))
            for i, j in pieces(offs):
                to, extra, ids, texts = (batch.column(c).slice(i, j - i).to_pylist() for c in range(4))
                chains = fingerprint_rows(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ranks)
                pairs, changed = [], []
                for row in zip(to, extra, ids, texts, chains, strict=True):
                    if last is not None and last[0] == row[0]:
                        pairs.append((last, row[4]))
                        changed.append(_edited(last[2], row[3]).encode())
                    last = None if row[1] else (row[0], *row[2:])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in changed])]).astype(np.int64)
                others = fingerprint_rows(np.frombuffer(b"".join(changed), np.uint8), ends, ranks)
                out = [(own[1], len(own[2]), hashlib.sha256(raw).hexdigest(), encode(own[3]), encode(other), likeness(own[3], other), likeness(own[3], following)) for (own, following), raw, other in zip(pairs, changed, others, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    return dealt.mapInArrow(run, _EDITS)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
