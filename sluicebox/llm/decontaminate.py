"""Benchmark decontamination with suffix arrays of the training documents.

Every task is a shard: it sorts the suffixes of its documents' word sequences into a suffix array
(by rank tripling over word hashes, to 27 words, more than a window has) and looks up every test
suffix by binary search, all at a time. A test suffix is a place of a benchmark item from which a
whole window follows, or an item shorter than that. The ranges found are all verbatim matches with
their places; matches that go on from place to place in document and item alike are one longest match,
which is reported with where it lies in both. Documents don't move.

The benchmark is handed to the tasks in blocks of a checked size, as arrays that are broadcast once; a
benchmark of several blocks is searched one block after the other over the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .text import ALNUM, U64, Words, buffers, pieces

#: Words of a window.
WINDOW = 13
#: Text bytes of one shard's suffix array, and of one block of the benchmark.
SHARD_BYTES = 4 << 20
BENCHMARK_BYTES = 16 << 20
#: Words by which suffixes are ordered.
_DEPTH = 27


def _symbols(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes with a zero after each row, and the number of each symbol's word."""
    h = words.hashes() | U64(1)
    at = np.arange(len(h)) + words.row
    s = np.zeros(len(h) + words.rows, np.uint64)
    s[at] = h
    number = np.full(len(s), -1, np.int64)
    number[at] = np.arange(len(h))
    return s, number


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The places of s in the order of the up to 27 symbols that follow."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.uint64)
    width, order = 1, None
    while width < _DEPTH:
        bits = int(rank.max()).bit_length() + 1 if len(rank) else 1
        if 3 * bits <= 64:
            take = 3
        else:
            take = 2
        key = np.zeros(len(rank), np.uint64)
        for k in range(take):
            part = np.zeros(len(rank), np.uint64)
            if k * width < len(rank):
                part[: len(rank) - k * width] = rank[k * width :] + U64(1)
            key = (key << U64(bits)) | part
        order = np.argsort(key)
        ranked = key[order]
        steps = np.ones(len(ranked), np.uint64)
        steps[1:] = ranked[1:] != ranked[:-1]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(steps) - U64(1)
        width *= take
    return order


def _search(s: np.ndarray, order: np.ndarray, tests: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each test (`length` symbols of `tests` from `start` on) the range of the suffix array that begins with it."""
    padded = np.concatenate([s, np.zeros(length, np.uint64)])
    ends = []
    for after in (False, True):
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
        if after:
            low = ends[0].copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            place = order[mid]
            less, same = np.zeros(len(open_), bool), np.arange(len(open_))
            for c in range(length):  # symbol by symbol, for those equal so far
                a, b = padded[place[same] + c], tests[start[open_[same]] + c]
                less[same[a < b]] = True
                same = same[a == b]
                if not len(same):
                    break
            if after:
                less[same] = True
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        ends.append(low)
    return ends[0], ends[1]


class Tests:
    """All test suffixes of some benchmark items: the distinct windows, and where in which items they are."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.names = [name for name, _ in items]
        words = Words(*buffers(pa.array([text for _, text in items], pa.string())), ALNUM, lower=True)
        self.symbols, number = _symbols(words)
        size = np.minimum(words.counts, window)
        at = np.flatnonzero(number >= 0)
        item = words.row[number[at]]
        place = number[at] - words.first[item]
        ok = place + size[item] <= words.counts[item]
        at, item, place = at[ok], item[ok], place[ok]
        length = size[item]
        rank = np.empty(len(self.symbols), np.int64)
        rank[suffix_array(self.symbols) if len(self.symbols) else np.zeros(0, np.int64)] = np.arange(len(self.symbols))
        by = np.lexsort((rank[at], length))
        at, length, self.item, self.place = at[by], length[by], item[by], place[by]
        # neighbours in the order of suffixes that agree in all symbols are one window
        fresh = np.ones(len(at), bool)
        fresh[1:] = length[1:] != length[:-1]
        for c in range(window):
            here = np.flatnonzero(~fresh & (length > c))
            fresh[here[self.symbols[at[here] + c] != self.symbols[at[here - 1] + c]]] = True
        first = np.flatnonzero(fresh)
        self.first = np.append(first, len(at))  # occurrences of each window
        self.start, self.lengths = at[first], length[first]

    def matches(self, s: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (place, test) at which a test occurs, by place."""
        places, tests = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in np.unique(self.lengths):
            which = np.flatnonzero(self.lengths == n)
            low, high = _search(s, order, self.symbols, self.start[which], int(n))
            count = high - low
            hit = np.flatnonzero(count)
            run = np.arange(count[hit].sum()) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
            places.append(order[np.repeat(low[hit], count[hit]) + run])
            tests.append(np.repeat(which[hit], count[hit]))
        place, test = np.concatenate(places), np.concatenate(tests)
        at = np.lexsort((test, place))
        return place[at], test[at]

    def longest(self, word: np.ndarray, row: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, ...]:
        """The longest verbatim matches among windows at some words: row, first word, item, item's word, words.

        Windows at consecutive words of a row and of an item are one match.
        """
        n = self.first[test + 1] - self.first[test]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[test], n)
        word, row, length = np.repeat(word, n), np.repeat(row, n), np.repeat(self.lengths[test], n)
        item, place = self.item[at], self.place[at]
        by = np.lexsort((word, word - place, item, row))
        word, row, item, place, length = word[by], row[by], item[by], place[by], length[by]
        fresh = np.ones(len(word), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (word[1:] - place[1:] != word[:-1] - place[:-1]) | (word[1:] != word[:-1] + 1)
        first = np.flatnonzero(fresh)
        steps = np.diff(np.append(first, len(word)))
        return row[first], word[first], item[first], place[first], steps - 1 + length[first]


_NEW = ("n_words", "n_hit", "n_items", "items", "matches", "longest_match", "contaminated")
_MERGED = ("_hit", "_items", "_matches")
_MATCH = pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("words", pa.int64())])


def _shards(batches: Iterator[pa.RecordBatch], text_at: int, shard_bytes: int) -> Iterator[pa.Table]:
    """Batches together, up to the bytes of a shard."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text_at).nbytes
        if size >= shard_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _scan(shared_tests, text_at: int, columns: list[str], merge: bool, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared_tests.value
        names = np.array([*tests.names, None], dtype=object)
        for table in _shards(batches, text_at, shard_bytes):
            data, offs = buffers(table.column(text_at))
            for i, j in pieces(offs, shard_bytes):
                rows = j - i
                words = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ALNUM, lower=True)
                s, number = _symbols(words)
                order = suffix_array(s) if len(s) else np.zeros(0, np.int64)
                place, test = tests.matches(s, order)
                word = number[place]
                steps = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(steps, word, 1)
                np.add.at(steps, word + tests.lengths[test], -1)
                hit = np.cumsum(steps[:-1]) > 0
                row, at, item, item_at, length = tests.longest(word, words.row[word], test)
                found: list[set] = [set() for _ in range(rows)]
                matches: list[list] = [[] for _ in range(rows)]
                for r, w, name, k, n in zip(row.tolist(), (at - words.first[row]).tolist(), names[item], item_at.tolist(), length.tolist(), strict=True):
                    matches[r].append({"item": name, "item_word": k, "word": w, "words": n})
                    if name is not None:
                        found[r].add(name)
                part = table.slice(i, rows)
                if merge:
                    old, old_items, old_matches = (part.column(c).to_pylist() for c in _MERGED)
                    for r in range(rows):
                        found[r].update(old_items[r])
                        matches[r] += old_matches[r]
                        own = slice(words.first[r], words.first[r + 1])
                        hit[own] |= np.unpackbits(np.frombuffer(old[r], np.uint8), count=int(words.counts[r])).astype(bool)
                for x in matches:
                    x.sort(key=lambda m: (m["word"], -m["words"], m["item"] is None, m["item"] or "", m["item_word"]))
                bits = [np.packbits(hit[words.first[r] : words.first[r + 1]]).tobytes() for r in range(rows)]
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
                out = {c: part.column(c) for c in columns}
                out |= {"_n": pa.array(words.counts), "_n_hit": pa.array(n_hit), "_hit": pa.array(bits, pa.binary()), "_items": pa.array([sorted(x) for x in found], pa.list_(pa.string())), "_matches": pa.array(matches, pa.list_(_MATCH))}
                yield from pa.table(out).combine_chunks().to_batches()

    return run


def find_contamination(df: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW, percent: int = 5, keep: list[str] | None = None, shard_bytes: int = SHARD_BYTES, benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """The rows of df (the columns in `keep`, all if None) with what of the benchmark they hold.

    Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z in
    lower case. n_words and n_hit count a text's words and those in an occurrence of a window of
    some item; n_items and items (sorted as strings) tell which items. matches lists the verbatim matches,
    each as long as it goes: the item and its word, the text's word, the number of words; longest_match
    is the greatest of those numbers, 0 without one. contaminated: n_hit > 0 and at least `percent` % of
    the words. Null and empty texts, and items without words, match nothing; an empty benchmark leaves
    all documents clean, an empty df stays empty. Columns of df with these names are replaced; items with
    equal ids count once. Items without an id are searched like others: their words count as hit, but
    n_items and items leave them out. A window has at most 27 words.
    """
    if not 0 < window <= _DEPTH:
        raise ValueError(f"a window has 1 to {_DEPTH} words")
    columns = [c for c in (keep if keep is not None else df.columns) if c not in _NEW and c not in _MERGED]
    text = F.col(f"`{text_column}`")
    # a text that is kept anyway isn't carried twice
    own = text_column if text_column in columns else "_text"
    rows = df.select(*[F.col(f"`{c}`") for c in columns], *([] if own in columns else [text.alias("_text")]))
    bench = benchmark.select(F.col(item_column).cast("string").alias("name"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    bench = shared.saved(bench.where("text <> ''").distinct())  # repeated rows would all land in one part
    size = bench.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("name"), F.lit(0)))).first()[0] or 0
    count = max(1, -(-size // benchmark_bytes))
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[F.col(f"`{c}`") for c in columns]).schema)
    tail = "`_n` long, `_n_hit` long, `_hit` binary, `_items` array<string>, `_matches` array<struct<item:string,item_word:long,word:long,words:long>>"
    for k in range(count):
        part = bench if count == 1 else bench.where(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == k)
        items = sorted(((r["name"], r["text"]) for r in part.collect()), key=lambda x: (x[0] or "", x[1]))  # at most about benchmark_bytes
        tests = df.sparkSession.sparkContext.broadcast(Tests(items, window))
        last = k == count - 1
        extra = [] if own in columns else ["_text"]
        out = [*columns, *([] if last else extra)]
        schema = ", ".join(x for x in (base, "`_text` string" if "_text" in out else "", tail) if x)
        source = [*columns, *extra, *(_MERGED if k else ())]
        rows = rows.select(*[F.col(f"`{c}`") for c in source]).mapInArrow(_scan(tests, source.index(own), out, bool(k), shard_bytes), schema)
    longest = F.coalesce(F.array_max(F.transform("_matches", lambda m: m["words"])), F.lit(0))
    result = [F.col("_n").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.col("_items").alias("items"), F.col("_matches").alias("matches"), longest.cast("long").alias("longest_match")]
    return rows.select(*[F.col(f"`{c}`") for c in columns], *result, ((F.col("_n_hit") > 0) & (F.col("_n_hit") * 100 >= F.col("_n") * percent)).alias("contaminated"))
