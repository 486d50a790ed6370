"""Token files: ids against the tokenizers library text by text, grammars by round trip, ranges against the whole."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluicebox.llm import grammar, queries, token_files

FOLDER = "/root/testdata/sf0.001"
SIGNS = ["a", "B", "é", "É", "İ", "×", "÷", "'", "s", "t", " ", "\n", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "<", "1", "23", "²", "½", ".", ",", "—", "日", "́", "ǅ", "ȿ", "K", "ll", "'re", "don't", "\t", "ﬁ", "😀", "\x00", "\x7f", "_", "ı", "ß", "ŀ", "'S", "ſ", "C3"]


def definition(name="word_bpe_49k.json"):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def test_grammars_give_their_ids_back():
    rng = np.random.default_rng(5)
    for k in range(300):
        ids = rng.integers(0, rng.integers(1, 9), rng.integers(0, 500)).astype(np.uint32)
        g = grammar.compress(ids, 10, 2 + k % 4)
        e = grammar.Expander(g)
        assert e.expand(g.symbols).tolist() == ids.tolist()
        assert all(x < 10 + r for r, pair in enumerate(g.rules) for x in pair)
        assert g.lengths.tolist() == [len(e.expand(np.array([10 + r], np.uint32))) for r in range(len(g.rules))]
        low, high = sorted(rng.integers(0, len(ids) + 1, 2))
        assert e.slice(low, high).tolist() == ids[low:high].tolist()


def test_repeats_become_rules():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    g = grammar.compress(ids, 50)
    assert len(g.symbols) + 2 * len(g.rules) < 300
    assert len(grammar.compress(np.full(1 << 16, 3, np.uint32), 50).symbols) < 20
    once = np.arange(1000, dtype=np.uint32)
    assert grammar.compress(once, 1000).symbols.tolist() == once.tolist()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    library, own = Tokenizer.from_str(definition(name)), token_files.Encoder(definition(name), 1)
    assert own.by_pieces == name.startswith("word")
    rng = random.Random(7)
    for _ in range(300):
        texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 25))) for _ in range(6)] + [None, ""]
        found = list(own.encode(pa.array(texts)))
        want = [library.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]
        assert np.concatenate([ids for ids, _ in found]).tolist() == [x for w in want for x in w]
        assert np.concatenate([counts for _, counts in found]).tolist() == [len(w) for w in want]


def test_encoder_forgets_pieces(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_PIECES", 3)
    library, own = Tokenizer.from_str(definition()), token_files.Encoder(definition(), 1)
    for text in ("one two three four", "five six", "one two"):
        assert [x for ids, _ in own.encode(pa.array([text])) for x in ids] == library.encode(text, add_special_tokens=False).ids + [1]


def want_rows(rows):
    library, start, out = Tokenizer.from_str(definition()), 0, []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, queries.op13_token_files(spark, FOLDER).collect())) == want_rows(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(3, "again"), (3, "again"), (None, "no id"), (1, None), (2, ""), (-5, "x " * 3000), (9, "Grüße, wie geht's?")]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, part int, ids string")
    token_files.write_tokens(df, str(tmp_path / "t"), definition(), shard_ids=64)
    got = token_files.read_tokens(spark, str(tmp_path / "t")).select("doc_id", "start", "n_tokens", F.crc32("ids")).orderBy("start").collect()
    assert [tuple(r) for r in got] == want_rows(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))
    assert spark.read.parquet(str(tmp_path / "t")).selectExpr("max(size(grammars))").first()[0] > 1
    token_files.write_tokens(df.limit(0), str(tmp_path / "none"), definition())
    assert token_files.read_tokens(spark, str(tmp_path / "none")).collect() == []


def test_ranges(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    path = str(tmp_path / "t")
    token_files.write_tokens(docs, path, definition(), shard_ids=500)
    whole = b"".join(r["ids"] for r in token_files.read_tokens(spark, path).orderBy("start").collect())
    n = len(whole) // 4
    rng = random.Random(2)
    asked = [(k, rng.randrange(n), rng.choice([1, 7, 700, 3000])) for k in range(20)] + [(20, n - 2, 100), (21, n, 5), (22, None, 3), (23, 5, 0)]
    got = {}
    for r in token_files.read_ranges(spark, path, spark.createDataFrame(asked, "range_id long, start long, n_tokens long")).orderBy("range_id", "start").collect():
        got[r["range_id"]] = got.get(r["range_id"], b"") + r["ids"]
    assert got == {k: whole[4 * s : 4 * (s + m)] for k, s, m in asked if s is not None and m and s < n}
