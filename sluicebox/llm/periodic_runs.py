"""Runs of periodic words: stretches that repeat their first words several times over.

A suffix automaton takes the words one by one. Its suffix links form a tree, kept in a link-cut tree
whose preferred paths have the colour of their last access, that is the last place where their strings
ended. Appending a word accesses its new state: every path segment on the way to the root tells the
longest suffix that ended last at the segment's colour. If that end lies no further back than the suffix is long,
both are a square, whose period is the distance; it is extended to the run of that period.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grammar import _spread
from .text import PLAIN, Words, buffers, pieces

#: Text whose words are looked at together; a longer text is looked at by itself.
_TEXT_BYTES = 4 << 20
_SLOT_BITS = 22


class Run(NamedTuple):
    start: int
    length: int
    period: int


def find_runs(words: list[int], exponent: int = 2, least: int = 2) -> list[Run]:
    """All runs of a sequence of numbers with a length of at least `least` and exponent * period, by start and period.

    A sequence of n words takes about n log n steps and some 30 numbers of memory for each word.
    """
    n = len(words)
    # the automaton: state 1 is the root; most states have one transition, held apart from the others
    length, link, label, target, more = [0, 0], [0, 0], [-1, -1], [0, 0], {}
    # the link-cut tree over the suffix links: children within a path, parent there or of the path, colour at a path's top
    left, right, up, colour = [0, 0], [0, 0], [0, 0], [0, 0]
    last, ends, found = 1, {}, []

    def splay(x: int) -> None:
        tint, p = 0, up[x]
        if not (left[p] == x or right[p] == x) or not p:
            return
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                break
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                y, tint = (p if (left[g] == p) == (left[p] == x) else x), colour[g]
            else:
                y, tint = 0, colour[p]
            for z in (y, x) if y else (x,):
                q = up[z]
                h = up[q]
                if left[q] == z:
                    b = left[q] = right[z]
                    right[z] = q
                else:
                    b = right[q] = left[z]
                    left[z] = q
                if b:
                    up[b] = q
                up[q] = z
                up[z] = h
                if h:
                    if left[h] == q:
                        left[h] = z
                    elif right[h] == q:
                        right[h] = z
        colour[x] = tint

    for i, word in enumerate(words):
        # append the word to the automaton
        now = len(length)
        length.append(i + 1)
        link.append(1)
        label.append(-1)
        target.append(0)
        left.append(0)
        right.append(0)
        up.append(0)
        colour.append(0)
        p, q = last, 0
        while p:
            if label[p] == word:
                q = target[p]
                break
            if label[p] < 0:
                label[p], target[p] = word, now
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {word: now}
                elif word in others:
                    q = others[word]
                    break
                else:
                    others[word] = now
            p = link[p]
        if q:
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = now + 1
                length.append(length[p] + 1)
                link.append(link[q])
                label.append(label[q])
                target.append(target[q])
                if q in more:
                    more[copy] = more[q].copy()
                # into q's path, right above q, so with its colour
                splay(q)
                above = left[q]
                left.append(above)
                right.append(0)
                up.append(q)
                colour.append(0)
                if above:
                    up[above] = copy
                left[q] = copy
                while p:
                    if label[p] == word:
                        if target[p] != q:
                            break
                        target[p] = copy
                    elif more.get(p, {}).get(word) == q:
                        more[p][word] = copy
                    else:
                        break
                    p = link[p]
                link[q] = link[now] = copy
        up[now] = link[now]
        last = now
        # access its state: one step for each colour on the way to the root
        x, below = up[now], now
        while x:
            splay(x)
            tint = colour[x]
            if tint:
                period = i + 1 - tint
                if period <= length[x] and ends.get(period, -1) < i:
                    start, end = tint - length[x], i + 1
                    while end < n and words[end] == words[end - period]:
                        end += 1
                    ends[period] = end - 1
                    if end - start >= least and end - start >= exponent * period:
                        found.append(Run(start, end - start, period))
            if right[x]:
                colour[right[x]] = tint
            right[x] = below
            below, x = x, up[x]
        colour[below] = i + 1
    return sorted(found, key=lambda r: (r.start, r.period))


def _gram(exponent: int, least: int) -> int:
    """Words of a k-gram that recurs a period before or after wherever it stands in a run: runs are 2 * period + k - 1 long at least."""
    return min(3, 1 + min(max(least, exponent * q) - 2 * q for q in range(1, least + 2)))


def _stretches(words: np.ndarray, first: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of words outside of which there are no runs; most texts have none.

    In a run every k-gram stands again within a part of the run's length, so words whose k-grams
    don't recur so near are in no run.
    """
    k, n = _gram(exponent, least), len(words)
    m = n - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    code = row[:m].astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            code = code * np.uint64(0x9E3779B97F4A7C15) + words[j : j + m].astype(np.uint64)
            code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
    slot = (code >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
    at = np.flatnonzero((row[:m] == row[k - 1 :]) & (np.bincount(slot, minlength=1 << _SLOT_BITS) > 1)[slot])
    # the nearest other place of the same k-gram, by sorting those that may have one
    order = at[np.argsort(code[at], kind="stable")]
    gap = np.diff(order)
    gap[code[order[1:]] != code[order[:-1]]] = n
    near = np.full(m, n)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    at = at[near[at] < n]
    while len(at):
        heads = np.concatenate([[True], (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])])
        number = np.cumsum(heads) - 1
        size = np.bincount(number) + k - 1
        good = (near[at] * exponent <= size[number]) & (size[number] >= least)
        if good.all():
            start = at[heads]
            return start, start + size
        at = at[good]
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batch(column: pa.Array, exponent: int, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_words, runs and kept_text of some texts."""
    data, offs = buffers(column)
    parts = [_some(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], exponent, least) for i, j in pieces(offs, _TEXT_BYTES)]
    return tuple(pa.concat_arrays(x) for x in zip(*parts)) if parts else (pa.array([], pa.int64()), pa.array([], pa.list_(_RUN)), pa.array([], pa.large_string()))


def _some(data: np.ndarray, offs: np.ndarray, exponent: int, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    words = Words(data, offs, PLAIN)
    n, first = len(words.start), words.first
    ends = np.concatenate([[0], np.cumsum(words.end - words.start)])
    names = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends), pa.py_buffer(data[PLAIN[data]])])
    numbers = names.dictionary_encode().indices.to_numpy(zero_copy_only=False) if n else np.zeros(0, np.int32)
    gone = np.zeros(n + 1, np.int64)
    rows, runs = [], []
    for a, b in zip(*_stretches(numbers, first, exponent, least)):
        row = int(words.row[a])
        for r in find_runs(numbers[a:b].tolist(), exponent, least):
            rows.append(row)
            runs.append({"start": int(a - first[row]) + r.start, "length": r.length, "period": r.period})
            gone[a + r.start + r.period] += 1
            gone[a + r.start + r.length] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[first]
    if not kept.all():
        names = names.filter(pa.array(kept))
    lists = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), names)
    counts = np.bincount(np.array(rows, np.int64), minlength=words.rows)
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    found = pa.ListArray.from_arrays(pa.array(bounds), pa.array(runs, _RUN))
    return pa.array(words.counts, pa.int64()), found, pa.compute.binary_join(lists, pa.scalar(" ", pa.large_string()))


def collapse_runs(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """One row for each row of df: doc_id, n_words, runs, kept_text.

    A run is a stretch of words with smallest period q, of `least` words and exponent * q words or more, that no
    neighbouring word extends keeping that period; runs are (start, length, period) by start, then
    period, and may overlap. kept_text has the words that no run holds after its first q words, joined
    by one blank. exponent is 2 or more. Null and empty texts have no words and no runs; rows are judged one by
    one, so ids may repeat or be null; a text is looked at whole, however long; other columns don't matter.
    """

    def judge(batches):
        for batch in batches:
            n_words, runs, kept = _batch(batch.column(1), exponent, least)
            yield pa.RecordBatch.from_arrays([batch.column(0), n_words, runs, kept.cast(pa.string())], names=["doc_id", "n_words", "runs", "kept_text"])

    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return docs.mapInArrow(judge, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string")


def greatest_run(runs: Column) -> Column:
    """The run of greatest length / period; of equal ones the first by start, then period; null without runs."""
    better = lambda a, b: F.struct(b["length"] * a["period"] - a["length"] * b["period"], a["start"] - b["start"], a["period"] - b["period"])
    sign = lambda d: F.when(d["col1"] != 0, F.signum(d["col1"])).when(d["col2"] != 0, F.signum(d["col2"])).otherwise(F.signum(d["col3"])).cast("int")
    return F.get(F.array_sort(runs, lambda a, b: sign(better(a, b))), F.lit(0))
