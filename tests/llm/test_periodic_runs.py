"""Runs by the suffix automaton against all stretches compared word by word."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from sluicebox.llm import periodic_runs, queries

FOLDER = "/root/testdata/sf0.001"


def brute(w, exponent, least):
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q) and not any(w[i : i + size - d] == w[i + d : i + size] for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {x for start, size, q in runs for x in range(start + q, start + size)}
    return " ".join(str(x) for i, x in enumerate(w) if i not in gone)


def sequences(n, rng):
    for _ in range(n):
        size = rng.randint(0, 70)
        w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(size)]
        if size and rng.random() < 0.5:
            a = rng.randrange(size)
            p = rng.randint(1, max(1, (size - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(size)]
        yield w


@pytest.mark.parametrize("exponent, least", [(2, 2), (2, 5), (3, 3), (4, 6)])
def test_runs_equal_brute_force(exponent, least):
    for w in sequences(400, random.Random(exponent)):
        want = brute(w, exponent, least)
        assert [tuple(r) for r in periodic_runs.find_runs(w, exponent, least)] == want
        texts = [" ".join(map(str, w)), None, "", "\t".join(map(str, w)) + " ", "1 1"]
        n_words, runs, kept = periodic_runs._batch(pa.array(texts), exponent, least)
        assert n_words.to_pylist() == [len(w), 0, 0, len(w), 2]
        for k in (0, 3):
            assert [tuple(r.values()) for r in runs[k].as_py()] == want and kept[k].as_py() == collapsed(w, want)
        assert (runs[1].as_py(), kept[1].as_py(), kept[2].as_py()) == ([], "", "")


def test_one_word_a_long_time():
    assert periodic_runs.find_runs([5] * 30_000, 4, 6) == [(0, 30_000, 1)]


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w, 4, 6)
    best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[0] if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(collapsed(w, runs)))


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_periodic_runs(spark, FOLDER)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(contract(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] > 0 for r in rows) > 5


def test_odd_rows(spark, tmp_path):
    texts = [None, "", " \n ", "a a a a a", "a a a a a a", "x y z " * 4 + "x y " * 4, "go " * 60_000, "a a a a a a b c d e f b c d e f b c d e f b c d e f"]
    rows = [(k if k != 3 else None, x, "src", 0) for k, x in enumerate(texts)] + [(4, texts[5], None, 1)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    quick = {i: t for i, t, *_ in rows if i != 6}
    assert sorted((tuple(r) for r in got if r["doc_id"] != 6), key=key) == sorted((contract(i, t) for i, t, *_ in rows if i != 6), key=key) and quick
    long = next(r for r in got if r["doc_id"] == 6)
    assert (long["n_runs"], long["start"], long["length"], long["period"], long["exponent_milli"]) == (1, 0, 60_000, 1, 60_000_000)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.collapse_runs(empty).collect() == []
