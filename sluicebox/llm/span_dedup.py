"""Substring dedup by relative Lempel-Ziv parsing against all reference blocks.

The corpus, in document order, is cut into blocks of whole documents; every block is a reference.
The index of a block holds a hash of each of its windows (runs of `window` words) and where it is first.
The indexes of all blocks meet bucket by bucket, where each window learns the earliest block that holds
it, and the word of that block at which it begins. A block then parses its own documents: from a word on,
a factor takes in as many further words as go on word by word in one reference block (an earlier one, or
the part of this block before), and where it ends the next one starts. Windows across a factor's boundary
are looked up too, so a factor of at least one window is found wherever it starts. Factors are the
duplicate spans, each with its block and its first word there; all is judged on the input.

Blocks travel once by their number, as text; what travels besides are window hashes and places in packed
form (about 10 bytes a window, once for each block that has it) and the matched places. Blocks and
buckets grow in number with the input, and no empty part of an index is sent, so rows are never more than
windows. A passage that is in very many documents is one entry for each block.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .text import U64, Words, buffers, whole_window, windows

#: Text bytes of a block, at about which more blocks are made; there is a bucket for two blocks.
BLOCK_BYTES = 8 << 20
_KEY_BITS = 56
#: Bytes of a place in a block; a block of more words, that is with one text of over 32 MB, has wider places.
_PLACE_BYTES = 3


class _Index:
    """A block's documents in order, and its distinct windows in the order of their keys."""

    def __init__(self, table: pa.Table, window: int):
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.texts, offs = buffers(self.table.column("text"))
        self.offs = offs
        self.words = Words(self.texts, offs)
        h = self.words.hashes()
        g = windows(h, window)
        self.at = np.flatnonzero(whole_window(self.words, np.arange(len(g)), window)) if len(g) else np.zeros(0, np.int64)
        g = g[self.at]
        key = g >> U64(64 - _KEY_BITS)
        self.keys, self.earliest, self.entry = np.unique(key, return_index=True, return_inverse=True)
        self.check = (windows(h, window, seed=1)[self.at][self.earliest] & U64(0xFFFF)).astype(np.uint16)

    def buckets(self, n: int) -> np.ndarray:
        """Entry offsets of n buckets of equal key ranges."""
        edges = [-(-(b << _KEY_BITS) // n) for b in range(1, n)]
        return np.concatenate([[0], np.searchsorted(self.keys, np.array(edges, np.uint64)), [len(self.keys)]])


def _pack(keys: np.ndarray) -> tuple[int, int, bytes]:
    """The first key, the bytes of a step, and the steps between sorted keys."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return int(keys[0]), width, steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _narrow(x: np.ndarray) -> bytes:
    width = _PLACE_BYTES if not len(x) or int(x.max()) < 1 << (8 * _PLACE_BYTES) else 4
    return np.ascontiguousarray(x.astype(np.uint32)).view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    """n places of equal width."""
    out = np.zeros((n, 4), np.uint8)
    if n:
        out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(n, -1)
    return out.view(np.uint32).ravel()


def _unpack(first: int, width: int, steps: bytes) -> np.ndarray:
    raw = np.frombuffer(steps, np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw) + 1, 8), np.uint8)
    wide[1:, :width] = raw
    keys = wide.view(np.uint64).ravel()
    keys[0] = first
    return np.cumsum(keys, dtype=np.uint64)


def _index(window: int, n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        index = _Index(table, window)
        cuts = index.buckets(n_buckets)
        first = index.at[index.earliest]
        rows = []
        for b in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[b], cuts[b + 1])
            rows.append((int(b), block, *_pack(index.keys[own]), index.check[own].tobytes(), _narrow(first[own])))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "block", "first", "width", "steps", "checks", "places"])

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block, which of its entries an earlier block has, the earliest such block, and where."""
    table = table.sort_by("block")
    blocks = table.column("block").to_numpy()
    parts = [_unpack(f.as_py(), w.as_py(), s.as_py()) for f, w, s in zip(table.column("first"), table.column("width"), table.column("steps"), strict=True)]
    check = np.concatenate([np.frombuffer(c.as_py(), np.uint16) for c in table.column("checks")])
    place = np.concatenate([_wide(c.as_py(), len(p)) for c, p in zip(table.column("places"), parts, strict=True)])
    ends = np.cumsum([len(p) for p in parts])
    keys, owner = np.concatenate(parts), np.repeat(blocks, [len(p) for p in parts])
    order = np.argsort(keys, kind="stable")  # blocks ascend within equal keys
    keys = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    lead = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    source, there = np.full(len(keys), -1, np.int32), np.zeros(len(keys), np.uint32)
    source[order] = np.where(~fresh & (check[lead] == check[order]), owner[lead], -1)
    there[order] = place[lead]
    hits = source >= 0
    rows = []
    for k, block in enumerate(blocks):
        part = slice(ends[k] - len(parts[k]), ends[k])
        if hits[part].any():
            rows.append((int(block), int(table.column("bucket")[0].as_py()), np.packbits(hits[part]).tobytes(), source[part][hits[part]].tobytes(), _narrow(there[part][hits[part]])))
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "bucket", "hits", "sources", "places"])


def _factors(dup: np.ndarray, source: np.ndarray, place: np.ndarray, at: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Greedy factors of a window or more, from the matched windows in text order: first word, end word, block, word there.

    A factor goes on as long as its next window begins one word further in the same reference block.
    """
    where = np.flatnonzero(dup)
    if not len(where):
        return where, where, where, where
    start, block, there, doc = at[where], source[where], place[where], row[at[where]]
    begins = np.ones(len(where), bool)
    begins[1:] = (start[1:] != start[:-1] + 1) | (block[1:] != block[:-1]) | (there[1:] != there[:-1] + 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(where)) - 1
    return start[first], start[last] + window, block[first], there[first]


def _parse(window: int, n_buckets: int):
    def run(key: tuple, docs: pa.Table, matches: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _result([], [], [], [], [])
        block = key[0].as_py()
        index = _Index(docs, window)
        cuts = index.buckets(n_buckets)
        source, place = np.full(len(index.keys), -1, np.int64), index.at[index.earliest].astype(np.int64)
        for b, hits, found, places in zip(*(matches.column(c).to_pylist() for c in ("bucket", "hits", "sources", "places")), strict=True):
            mask = np.unpackbits(np.frombuffer(hits, np.uint8), count=int(cuts[b + 1] - cuts[b])).astype(bool)
            source[cuts[b] : cuts[b + 1]][mask] = np.frombuffer(found, np.int32)
            place[cuts[b] : cuts[b + 1]][mask] = _wide(places, int(mask.sum()))
        of_window, there = source[index.entry], place[index.entry]
        again = np.ones(len(index.at), bool)
        again[index.earliest] = False  # all but a window's first place in this block
        dup = again | (of_window >= 0)
        of_window = np.where(of_window >= 0, of_window, block)
        words = index.words
        first, end, ref, ref_word = _factors(dup, of_window, there, index.at, words.row, window)
        gone = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(gone, first, 1)
        np.add.at(gone, end, -1)
        keep = np.cumsum(gone[:-1]) == 0
        removed = np.concatenate([[0], np.cumsum(~keep)])
        n_removed = removed[words.first[1:]] - removed[words.first[:-1]]
        texts = index.table.column("text").to_pylist()
        kept = []
        for r, text in enumerate(texts):
            of_row = (text or "").encode().split()  # bytes.split() cuts at the same six bytes
            kept.append(b" ".join(compress(of_row, keep[words.first[r] : words.first[r + 1]]) if n_removed[r] else of_row).decode())
        per_row = np.bincount(words.row[first], minlength=len(texts)) if len(first) else np.zeros(len(texts), np.int64)
        base = words.first[words.row[first]] if len(first) else first
        spans = pa.StructArray.from_arrays([pa.array(first - base, pa.int64()), pa.array(end - base, pa.int64()), pa.array(ref, pa.int64()), pa.array(ref_word, pa.int64())], names=["start", "end", "block", "block_word"])
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()), spans)
        return _result(index.table.column("doc_id"), words.counts, n_removed, kept, spans)

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("block", pa.int64()), ("block_word", pa.int64())]))


def _result(doc_id, n_words, n_removed, kept, spans) -> pa.Table:
    doc_id = doc_id.combine_chunks() if isinstance(doc_id, pa.ChunkedArray) else pa.array(doc_id, pa.int64())
    return pa.table({"doc_id": doc_id, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string()), "spans": spans if isinstance(spans, pa.Array) else pa.array(spans, _SPANS)})


def remove_repeated_spans(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of df: doc_id, n_words, n_removed, kept_text, spans.

    A word goes if a window that covers it has the same words as one that starts earlier: in a
    document of smaller id, or earlier in the same. Rows that repeat an id come in the order of
    their texts, equal rows one after the other; rows without an id come last. kept_text is the
    other words joined by one blank; spans are the factors as word numbers, with the reference block and
    the word of that block that they begin at (words of a block are counted in document order).
    Null texts have no words; texts shorter than a window lose none; an empty df stays empty. Other columns
    don't matter.
    """
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = shared.shuffle_partitions(df.sparkSession)
    n, n_buckets = max(partitions, -(-size // block_bytes)), max(partitions, -(-size // (2 * block_bytes)))
    bounds = shared.byte_bounds(docs, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 16, n)
    dealt = docs.withColumn("block", shared.range_block(F.col("doc_id"), bounds).cast("int")).repartition(n, "block")
    index = dealt.groupBy("block").applyInArrow(_index(window, n_buckets), "bucket int, block int, first long, width int, steps binary, checks binary, places binary")
    matches = index.groupBy("bucket").applyInArrow(_meet, "block int, bucket int, hits binary, sources binary, places binary")
    return dealt.groupBy("block").cogroup(matches.groupBy("block")).applyInArrow(_parse(window, n_buckets), "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long,block:long,block_word:long>>")
