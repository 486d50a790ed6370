"""Ranked lexical search of items over documents by dual trees.

A document's coordinates are the saturated frequencies of the items' terms, an item's coordinates are its
terms' weights, and a score is their inner product, in whole numbers. Documents are written as blocks
of postings, in an order that brings documents with the same rare terms together; over a block, and over the
items, stand trees whose nodes hold the greatest value of every coordinate. The inner product of two nodes' maxima
bounds all scores between them; pairs of nodes that stay below the items' weakest kth scores are left out
with all that is below them. Sums stay under 2^53, so floating-point products of them are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import shared
from .grammar import _spread
from .text import ALNUM, Words, buffers, pieces

#: Items that are searched at a time, in bytes; more take further passes.
BENCHMARK_BYTES = 16 << 20
_TEXT_BYTES = 4 << 20
_LAST = 2**63 - 1


class Shape(NamedTuple):
    """Sizes of blocks and trees; results don't depend on them."""

    block_docs: int = 4096
    block_postings: int = 1 << 20
    leaf_docs: int = 16
    doc_fan: int = 8
    leaf_items: int = 8
    item_fan: int = 4
    #: Different terms of the items below a root.
    root_terms: int = 4096
    #: One block in so many is searched first, to give all others the items' kth scores to beat.
    first_blocks: int = 16


_INDEX = "n_docs long, n_terms long, df_terms array<int>, df array<int>, ids binary, no_id binary, n binary, first binary, terms binary, counts binary"


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[Words, pa.Array]:
    """The terms of some texts: runs of ASCII letters and digits and of other characters, A-Z in lower case."""
    words = Words(data, offs, ALNUM, lower=True)
    ends = np.concatenate([[0], np.cumsum(words.end - words.start)])
    return words, pa.Array.from_buffers(pa.large_string(), len(words.start), [None, pa.py_buffer(ends), pa.py_buffer(words.data[ALNUM[data]])])


# ---- documents as blocks of postings


class _Blocks:
    """Gathers documents with some of the terms, and writes blocks of them."""

    def __init__(self, vocabulary: int, shape: Shape):
        self.vocabulary, self.shape = vocabulary, shape
        self._clear()

    def _clear(self) -> None:
        self.n_docs = self.n_terms = self.docs = self.postings = 0
        self.held: list[tuple] = []

    def add(self, ids: np.ndarray, no_id: np.ndarray, n: np.ndarray, row: np.ndarray, term: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Documents with n terms each, and the (row, term) of the terms that are asked for, by row."""
        self.n_docs += int((n > 0).sum())
        self.n_terms += int(n.sum())
        key, count = np.unique(row * self.vocabulary + term, return_counts=True)
        row, term = key // self.vocabulary, key % self.vocabulary
        rows, size = np.unique(row, return_counts=True)
        at, ends = 0, np.cumsum(size)
        while at < len(rows):
            done = int(ends[at - 1]) if at else 0
            stop = int(np.searchsorted(ends, done + self.shape.block_postings - self.postings, "left")) + 1
            stop = min(len(rows), stop, at + self.shape.block_docs - self.docs)
            own = slice(done, int(ends[stop - 1]))
            r = rows[at:stop]
            self.held.append((ids[r], no_id[r], n[r], size[at:stop], term[own], count[own]))
            self.docs += stop - at
            self.postings += own.stop - own.start
            at = stop
            if self.docs >= self.shape.block_docs or self.postings >= self.shape.block_postings:
                yield self.close()

    def close(self) -> pa.RecordBatch:
        empty = [np.zeros(0, np.int64)] * 6
        ids, no_id, n, size, term, count = (np.concatenate(x) for x in zip(*self.held)) if self.held else empty
        df = np.bincount(term, minlength=self.vocabulary) if len(term) else np.zeros(0, np.int64)
        df_terms = np.flatnonzero(df)
        first = np.concatenate([[0], np.cumsum(size)])
        if len(ids):
            # side by side: documents with the same rarest term of this block, short ones before long ones
            rarest = np.minimum.reduceat(df[term] * self.vocabulary + term, first[:-1])
            order = np.lexsort((n, rarest))
            places = _spread(first[:-1][order], size[order])
            ids, no_id, n, size, term, count = ids[order], no_id[order], n[order], size[order], term[places], count[places]
            first = np.concatenate([[0], np.cumsum(size)])
        raw = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        whole = lambda x: pa.array([x], pa.int64())
        ints = lambda x: pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
        columns = [whole(self.n_docs), whole(self.n_terms), ints(df_terms), ints(df[df_terms]), raw(ids, "<i8"), raw(no_id, "?"), raw(n, "<i8"), raw(first, "<i8"), raw(term, "<i4"), raw(count, "<i8")]
        self._clear()
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _INDEX.split(", ")])


def _index(docs: DataFrame, terms: pa.Array, shape: Shape) -> DataFrame:
    """Blocks of documents (doc_id, text) with the terms, and counts of all documents and terms, as a written table."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(terms)

    def gather(batches):
        known = vocabulary.value
        blocks = _Blocks(len(known), shape)
        for batch in batches:
            column = batch.column(0)
            ids, no_id = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
            data, offs = buffers(batch.column(1))
            for i, j in pieces(offs, _TEXT_BYTES):
                words, names = _terms(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                found = pc.index_in(names, known)
                at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                yield from blocks.add(ids[i:j], no_id[i:j], words.counts, words.row[at].astype(np.int64), found.drop_null().to_numpy().astype(np.int64))
        if blocks.n_docs or blocks.docs:
            yield blocks.close()

    return shared.saved(docs.mapInArrow(gather, _INDEX))


# ---- trees


class _Root:
    """A tree over some items: levels of nodes from the root down, each with its parents and coordinate maxima."""

    def __init__(self, items: list[int], terms: list[np.ndarray], weights: list[np.ndarray], shape: Shape):
        self.items = np.array(items)
        self.terms = np.unique(np.concatenate([terms[k] for k in items])) if items else np.zeros(0, np.int64)
        self.points = np.zeros((len(items), len(self.terms)))
        for r, k in enumerate(items):
            self.points[r, np.searchsorted(self.terms, terms[k])] = weights[k]
        groups = [np.arange(0, len(items), shape.leaf_items)]
        levels = [np.maximum.reduceat(self.points, groups[0], axis=0)]
        parents = []
        while len(levels[0]) > 1:
            heads = np.arange(0, len(levels[0]), shape.item_fan)
            parents.insert(0, np.arange(len(levels[0])) // shape.item_fan)
            levels.insert(0, np.maximum.reduceat(levels[0], heads, axis=0))
        self.levels, self.parents, self.leaves = levels, [None, *parents], groups[0]
        #: Terms of a leaf, and its items' weights of them.
        self.own = []
        for k, low in enumerate(self.leaves):
            columns = np.flatnonzero(levels[-1][k])
            self.own.append((columns, self.points[low : low + shape.leaf_items][:, columns].T.copy()))


def _roots(terms: list[np.ndarray], weights: list[np.ndarray], shape: Shape) -> list[_Root]:
    """Trees over all items, of at most root_terms terms each (one item's where it has more).

    Items whose most common terms are the same are neighbours, which keeps languages and subjects apart.
    """
    common = [tuple(t[np.lexsort((t, w))][:6].tolist()) for t, w in zip(terms, weights)]
    roots, held, known = [], [], set()
    for k in sorted(range(len(terms)), key=lambda k: common[k]):
        own = set(terms[k].tolist())
        if held and len(known | own) > shape.root_terms:
            roots.append(_Root(held, terms, weights, shape))
            held, known = [], set()
        held.append(k)
        known |= own
    return roots + ([_Root(held, terms, weights, shape)] if held else [])


class _Block:
    """Some documents' coordinates of a root's terms, and the maxima of the nodes over them."""

    def __init__(self, first: np.ndarray, terms: np.ndarray, values: np.ndarray, wanted: np.ndarray, place: np.ndarray, shape: Shape):
        at = place[terms]
        keep = at >= 0
        n = len(first) - 1
        self.first = np.concatenate([[0], np.cumsum(keep)])[first]
        self.terms, self.values = at[keep], values[keep]
        doc = np.repeat(np.arange(n), np.diff(self.first))
        leaves = -(-n // shape.leaf_docs)
        key = doc // shape.leaf_docs * len(wanted) + self.terms
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        maxima = np.zeros(leaves * len(wanted))
        if len(heads):
            maxima[key[heads]] = np.maximum.reduceat(self.values[order], heads)
        self.levels, self.parents = [maxima.reshape(leaves, len(wanted))], []
        while len(self.levels[0]) > 1:
            level = self.levels[0]
            self.parents.insert(0, np.arange(len(level)) // shape.doc_fan)
            self.levels.insert(0, np.maximum.reduceat(level, np.arange(0, len(level), shape.doc_fan), axis=0))
        self.parents.insert(0, None)

    def scores(self, docs: np.ndarray, columns: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
        """Scores of documents for the items of a leaf."""
        size = self.first[docs + 1] - self.first[docs]
        at = _spread(self.first[docs], size)
        place = np.full(width, -1)
        place[columns] = np.arange(len(columns))
        column, row = place[self.terms[at]], np.repeat(np.arange(len(docs)), size)
        keep = column >= 0
        points = np.zeros((len(docs), len(columns)))
        points[row[keep], column[keep]] = self.values[at[keep]]
        return np.rint(points @ weights).astype(np.int64)


class _Search:
    """The best documents of each item so far, as sorted (-score, no id, id)."""

    def __init__(self, roots: list[_Root], k: int, floors: np.ndarray, vocabulary: int, n_docs: int, n_terms: int, shape: Shape):
        self.shape = shape
        self.roots, self.k, self.floors, self.n_docs, self.n_terms = roots, k, floors, n_docs, n_terms
        self.best: list[list[tuple]] = [[] for _ in floors]
        self.places = []
        for root in roots:
            place = np.full(vocabulary, -1)
            place[root.terms] = np.arange(len(root.terms))
            self.places.append(place)

    def _weakest(self, item: int) -> tuple[int, int]:
        """The score that a document must reach, and the id that it must be below if it has just that score."""
        best = self.best[item]
        if len(best) < self.k or -best[-1][0] < self.floors[item]:
            return max(1, int(self.floors[item])), _LAST
        return -best[-1][0], _LAST if best[-1][1] else best[-1][2]

    def block(self, row: dict) -> None:
        ids, no_id, n, first, terms, counts = (np.frombuffer(row[c], t) for c, t in (("ids", "<i8"), ("no_id", "?"), ("n", "<i8"), ("first", "<i8"), ("terms", "<i4"), ("counts", "<i8")))
        if not len(ids):
            return
        length = 90 * n.astype(object) * self.n_docs if int(n.max()) * 90 * self.n_docs > _LAST else 90 * n * self.n_docs
        m = 10 + (length // self.n_terms).astype(np.int64)
        values = (1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(m, np.diff(first)))).astype(float)
        order = np.where(no_id, _LAST, ids)
        lowest = np.minimum.reduceat(order, np.arange(0, len(ids), self.shape.leaf_docs))
        for root, place in zip(self.roots, self.places):
            docs = _Block(first, terms, values, root.terms, place, self.shape)
            for leaf, leaves, bounds in self._pairs(root, docs):
                self._leaf(root, leaf, docs, leaves, bounds, lowest, ids, no_id, order)

    def _pairs(self, root: _Root, docs: _Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Item leaves with the document leaves that aren't ruled out, going down both trees together."""
        weakest = np.array([self._weakest(k)[0] for k in root.items])
        least = [np.minimum.reduceat(weakest, root.leaves)]
        for parents in root.parents[:0:-1]:
            least.insert(0, np.minimum.reduceat(least[0], np.flatnonzero(np.diff(parents, prepend=-1))))
        depth = max(len(root.levels), len(docs.levels))
        alive = np.ones((1, 1), bool)
        bounds = alive
        for step in range(depth):
            i, d = len(root.levels) - depth + step, len(docs.levels) - depth + step
            if step and i > 0:
                alive = alive[root.parents[i]]
            if step and d > 0:
                alive = alive[:, docs.parents[d]]
            i, d = max(i, 0), max(d, 0)
            rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if not len(rows):
                return
            bounds = np.zeros(alive.shape)
            bounds[np.ix_(rows, columns)] = root.levels[i][rows] @ docs.levels[d][columns].T
            alive = alive & (np.rint(bounds) >= least[i][:, None])
        for leaf in np.flatnonzero(alive.any(1)):
            leaves = np.flatnonzero(alive[leaf])
            order = np.argsort(-bounds[leaf, leaves], kind="stable")
            yield int(leaf), leaves[order], np.rint(bounds[leaf, leaves[order]]).astype(np.int64)

    def _leaf(self, root: _Root, leaf: int, docs: _Block, leaves: np.ndarray, bounds: np.ndarray, lowest: np.ndarray, ids: np.ndarray, no_id: np.ndarray, order: np.ndarray) -> None:
        """Score the documents of leaves, best bounds first, until no bound reaches the items' weakest kth score."""
        columns, weights = root.own[leaf]
        items = root.items[root.leaves[leaf] : root.leaves[leaf] + self.shape.leaf_items]
        at = 0
        while at < len(leaves):
            weakest = [self._weakest(k) for k in items]
            least = min(weakest)[0]
            # of the items that just `least` would enter, the greatest id that does
            last = max(x[1] for x in weakest if x[0] == least)
            part, bound = leaves[at : at + 8], bounds[at : at + 8]
            if bound[0] < least:
                return
            at += 8
            part = part[(bound > least) | ((bound == least) & (lowest[part] <= last))]
            if not len(part):
                continue
            rows = (part[:, None] * self.shape.leaf_docs + np.arange(self.shape.leaf_docs)).ravel()
            rows = rows[rows < len(ids)]
            found = docs.scores(rows, columns, weights, len(root.terms))
            for c, item in enumerate(items):
                score, last = weakest[c]
                good = np.flatnonzero((found[:, c] > score) | ((found[:, c] == score) & (order[rows] <= last)))
                if len(good):
                    if len(good) > self.k:
                        good = good[np.lexsort((order[rows[good]], -found[good, c]))[: self.k]]
                    new = [(-int(found[g, c]), bool(no_id[rows[g]]), int(ids[rows[g]])) for g in good]
                    self.best[item] = sorted(self.best[item] + new)[: self.k]


def _search(index: DataFrame, shared_roots, k: int, floors, n_docs: int, n_terms: int, vocabulary: int, shape: Shape) -> DataFrame:
    """The best k documents of each item within each part of the index: item, doc_id, score."""

    def run(batches):
        search = _Search(shared_roots.value, k, floors.value, vocabulary, n_docs, n_terms, shape)
        for batch in batches:
            for r in range(batch.num_rows):
                search.block(batch.slice(r, 1).to_pylist()[0])
        rows = [(item, None if none else i, -score) for item, best in enumerate(search.best) for score, none, i in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc_id", "score"])

    return index.select("ids", "no_id", "n", "first", "terms", "counts").mapInArrow(run, "item int, doc_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank; Spark keeps the k best of each task before it shuffles."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", benchmark_bytes: int = BENCHMARK_BYTES, shape: Shape = Shape()) -> DataFrame:
    """The k best documents of each item: item_id, rank from 1, doc_id, score; equal scores by ascending doc_id.

    A term's weight is w = floor(1000 ln((2N + 2) / (2 df + 1))), a document's score the sum of
    w * ((10^9 tf) div (1000 tf + 8 m)) over the item's different terms, with m = 10 + (90 n N) div L: N documents
    have terms, L of them together and n each; df and tf count a term's documents and places. Only scores above 0
    count. Null and empty texts have no terms, and items without terms no documents. Rows that
    repeat an id are ranked one by one, rows without an id after others of their score. Items are the
    different (item_id, text): equal rows are one item, one id with two texts is two. An empty table on either
    side gives no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    asked = shared.saved(items.select(F.col(item_column).alias("item_id"), F.col(item_text).alias("text")).where("text <> ''").distinct())
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kind = asked.schema["item_id"].dataType
    schema = StructType([StructField("item", LongType()), StructField("item_id", kind)])
    passes, out = max(1, -(-size // benchmark_bytes)), []
    for p in range(passes):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p) if passes > 1 else asked
        own = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (str(r[0]), r[1]))  # at most about benchmark_bytes
        words, names = _terms(*buffers(pa.array([t for _, t in own], pa.string())))
        coded = names.dictionary_encode()
        vocabulary = coded.dictionary
        numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(names) else np.zeros(0, np.int64)
        terms = [np.unique(numbers[words.first[r] : words.first[r + 1]]) for r in range(len(own))]
        found = _ranked(rows, terms, vocabulary, k, shape) if len(vocabulary) else spark.createDataFrame([], "item int, doc_id long, score long, rank int")
        named = spark.createDataFrame([(i, r[0]) for i, r in enumerate(own)], schema)
        out.append(found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
    result = out[0]
    for more in out[1:]:
        result = result.unionAll(more)
    return result


def _ranked(docs: DataFrame, terms: list[np.ndarray], vocabulary: pa.Array, k: int, shape: Shape) -> DataFrame:
    context = docs.sparkSession.sparkContext
    index = _index(docs, vocabulary, shape)
    n_docs, n_terms = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    # as many rows as the items have terms
    pairs = index.select(F.explode(F.arrays_zip("df_terms", "df")).alias("x")).groupBy("x.df_terms").agg(F.sum("x.df").alias("df")).collect()
    df = np.zeros(len(vocabulary), np.int64)
    for r in pairs:
        df[r["df_terms"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    held = [t[df[t] > 0] for t in terms]
    shared_roots = context.broadcast(_roots(held, [weight[t] for t in held], shape))
    # an item's kth score among some blocks is one that its kth score among all reaches
    first = F.pmod(F.xxhash64("ids"), F.lit(shape.first_blocks)) == 0
    low = context.broadcast(np.zeros(len(terms), np.int64))
    begun = shared.saved(_best(_search(index.where(first), shared_roots, k, low, n_docs, n_terms, len(vocabulary), shape), k))
    floors = np.zeros(len(terms), np.int64)
    for r in begun.where(F.col("rank") == k).collect():
        floors[r["item"]] = r["score"]
    rest = _search(index.where(~first), shared_roots, k, context.broadcast(floors), n_docs, n_terms, len(vocabulary), shape)
    return _best(begun.select("item", "doc_id", "score").unionAll(rest), k)
