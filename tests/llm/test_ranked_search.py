"""Dual-tree search against all scores; its query against SQL is in test_contracts."""

import collections
import math
import random
import re

import pytest

from sluicebox.llm import ranked_search

PATTERN = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def terms(text):
    return re.findall(PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for doc, c, n in counts:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return out


def some(n, rng, words=60):
    w = [f"w{k}" for k in range(words)]
    return [(k, " ".join(rng.choices(w, [1 / (x + 1) for x in range(words)], k=rng.choice([0, 1, 5, 40, 300])))) for k in range(n)]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (str(r[0]), r[1], -r[3], r[2] is None, r[2] or 0))


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_scores(spark, seed):
    # small nodes, so that trees are deep and blocks are many
    shape = ranked_search.Shape(30, 1000, 2, 2, 2, 2, 40, 3)
    rng = random.Random(seed)
    docs = some(300, rng)
    docs += [(1000 + k, docs[7][1]) for k in range(60)]
    items = some(40, rng) + [(500, "w1 w1 nowhere"), (501, "nowhere"), (502, docs[7][1])]
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k=4, shape=shape)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert order(got.collect()) == order(brute(docs, items, 4))
    passes = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=4, benchmark_bytes=3000, shape=shape)
    assert order(passes.collect()) == order(brute(docs, items, 4))


def test_pairs_are_left_out():
    """Where a few documents fit best, most leaves aren't scored."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n, width, shape = 2000, 200, ranked_search.Shape(leaf_items=2)
    rows = np.repeat(np.arange(n), 5)
    column = (rows // 100 * 10 + rng.integers(0, 10, len(rows))).astype(np.int64)
    blocks = ranked_search._Blocks(width, shape)
    list(blocks.add(np.arange(n), np.zeros(n, bool), np.full(n, 5), rows, column))
    row = pa.Table.from_batches([blocks.close()]).to_pylist()[0]
    items = [np.arange(10 * k, 10 * k + 10) for k in range(20)]
    search = ranked_search._Search(ranked_search._roots(items, [np.full(10, 1000)] * 20, shape), 3, np.zeros(20, np.int64), width, n, 5 * n, shape)
    scored = []
    scores = ranked_search._Block.scores
    try:
        ranked_search._Block.scores = lambda self, docs, *a: scored.append(len(docs)) or scores(self, docs, *a)
        search.block(row)
    finally:
        ranked_search._Block.scores = scores
    assert all(len(b) == 3 for b in search.best)
    assert sum(scored) * shape.leaf_items < 0.2 * n * 20


def test_odd_rows(spark):
    docs = [(5, "Alpha beta"), (5, "alpha beta"), (None, "ALPHA beta"), (2, "alpha"), (3, None), (4, ""), (6, "\n ,."), (7, "gamma " * 60_000 + "alpha"), (-1, "été alpha")]
    items = [(1, "alpha beta"), (1, "alpha beta"), (1, "gamma"), (None, "été"), (2, None), (3, ""), (4, "?!"), (9, "zeta")]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item int, score string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    want = brute(docs, [r for r in items if r[1]], 10)
    assert order(ranked_search.search(d, i).collect()) == order(want)
    assert ranked_search.search(d.limit(0), i).collect() == [] == ranked_search.search(d, i.limit(0)).collect()
    assert ranked_search.search(spark.createDataFrame([(1, None)], "doc_id long, text string"), i).collect() == []
