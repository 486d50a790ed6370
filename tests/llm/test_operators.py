"""The training-data operators against brute force, on small fixtures with odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluicebox.llm import decontaminate, draws, fingerprints, mixing, near_dedup, private_data, secrets, shared, sharding, span_dedup, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(x):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), x or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)] + ["Über", "naïve", "x.y", "A"]
    out = [None, "", "   \n", "one", "one", "a b", "A b"]
    for _ in range(60):
        out.append(" ".join(rng.choices(words, k=rng.choice([3, 12, 30, 80]))))
    base = out[-1] + " " + out[-2] + " " + " ".join(rng.choices(words, k=60))
    for k in range(25):
        own = base.split(" ")
        for _ in range(k // 3):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    out += [base, base, " ".join(["again"] * 3000), " ".join(rng.choices(words, k=5000)) + " " + base]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "x", f"s{k % 3}" if k % 7 else None, k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, source string, kept long").repartition(5)


def test_span_dedup(docs, texts):
    got = {r["doc_id"]: r for r in span_dedup.remove_repeated_spans(docs, window=8, block_bytes=3000).collect()}
    seen = set()
    for k, t in enumerate(texts):
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for i in range(len(w) - 7):
            key = tuple(w[i : i + 8])
            if key in seen:
                keep[i : i + 8] = [False] * 8
            seen.add(key)
        assert got[k]["kept_text"] == " ".join(x for x, y in zip(w, keep, strict=True) if y)
        assert (got[k]["n_words"], got[k]["n_removed"]) == (len(w), len(w) - sum(keep))
        covered = {i for s in got[k]["spans"] for i in range(s["start"], s["end"])}
        assert covered == {i for i, y in enumerate(keep) if not y}
    # every factor is in its reference block, word by word, at the word that it names
    blocks, longest = [], 0
    bounds = shared.byte_bounds(docs, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 16, max(4, -(-sum(len((t or "").encode()) for t in texts) // 3000)))
    for r in docs.select("doc_id", "text", shared.range_block(F.col("doc_id"), bounds).alias("b")).orderBy("doc_id").collect():
        blocks += [[] for _ in range(r["b"] + 1 - len(blocks))]
        blocks[r["b"]] += WORD.findall(r["text"] or "")
    for k, t in enumerate(texts):
        for s in got[k]["spans"]:
            n = s["end"] - s["start"]
            assert n >= 8 and WORD.findall(t)[s["start"] : s["end"]] == blocks[s["block"]][s["block_word"] : s["block_word"] + n]
            longest = max(longest, n)
    assert len(blocks) > 3 and longest > 40


def components(texts, k):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, [find(a) for a in range(len(sets))]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, texts, k):
    sets, root = components(texts, k)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, shingle=k).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), root[i], root[i] == i) for i in range(len(texts))}


def test_near_duplicates_broadcast_no_more_for_more_documents(spark, monkeypatch):
    # three texts, two of them linked and all in common buckets, many times; and a large group in buckets of its own
    word = lambda *a: "w" + "x".join(map(str, a))
    changed = lambda words, at, of: " ".join(word(of, i) if i in at else w for i, w in enumerate(words))
    texts = []
    for g in range(100):
        base = [word("g", g, i) for i in range(60)]
        texts += [" ".join(base), changed(base, {30}, f"a{g}"), changed(base, {5, 15, 25, 35, 45, 55}, f"b{g}")]
    core = [word("core", i) for i in range(60)]
    texts += [changed(core, {k % 60, (k + 20) % 60, (k + 40) % 60}, f"c{k}") for k in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "a b c"), (None, texts[0])], "doc_id long, text string")
    sent, put = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: (sent.append(df.count()), put(df))[1])
    monkeypatch.setattr(near_dedup, "HOT_BUCKETS", 64, raising=False)
    monkeypatch.setattr(near_dedup, "FILTER_BITS", 4096, raising=False)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, shingle=2).where("doc_id IS NOT NULL").collect()}
    sets, root = components(texts, 2)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), root[i], root[i] == i) for i in range(len(texts))}
    assert 1 < max(sent) <= 64, sent


def test_super_min_hash_estimates_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    row = np.repeat([0, 1], [800, 800])
    sig = near_dedup.signatures(row, np.concatenate([h[:800], h[200:]]), 2)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.12
    assert (near_dedup.signatures(np.array([0]), h[:1], 1) < 2**64 - 1).all()  # even one element fills all slots


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 100), (7, 7), (200, 200)], "a long, b long")
    got = {r["id"]: r["component"] for r in shared.components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 100: 90, 200: 200}


def test_decontamination(spark, docs, texts):
    items = [(1, " ".join((texts[20] or "").split()[:25])), (2, "one"), (3, None), (4, texts[-1][-200:]), (10, "nowhere to be found at all"), (1, "w1 w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    for limits in ({}, {"shard_bytes": 2000, "benchmark_bytes": 100}):
        got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, bench, **limits).collect()}
        for d, t in enumerate(texts):
            w = ALNUM.findall(lower(t))
            hit, found = set(), set()
            for key, ids in windows.items():
                for k in range(len(w) - len(key) + 1):
                    if tuple(w[k : k + len(key)]) == key:
                        hit |= set(range(k, k + len(key)))
                        found |= ids
            r = got[d]
            assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    none = decontaminate.find_contamination(docs, bench.limit(0)).where("contaminated").count()
    assert none == 0


def test_fingerprints(docs, texts):
    got = {r["doc_id"]: r for r in fingerprints.edit_likeness(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        own, after = t or "", texts[(k - 1) % len(texts)] or ""
        n = len(own) // 3
        assert got[k]["edited_sha256"] == hashlib.sha256((own[: len(own) - n] + after[:n]).encode()).hexdigest()
        assert got[k]["n_chars"] == len(own) and 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1
    by_text = collections.defaultdict(set)
    for k, t in enumerate(texts):
        by_text[t or ""].add(got[k]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    a = fingerprints.fingerprint(texts[-1], np.arange(fingerprints.CLASSES))
    assert fingerprints.likeness(a, a) == 1.0


def test_sharding(docs, texts):
    rows = sharding.shard_rows(docs, 7, cell_rows=3).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard_rows(docs.repartition(2), 7, cell_rows=3).collect()
    # rows that are equal but for their id keep their places too, as the id is part of a row
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    assert sharding.shard_rows(docs.limit(0), 7).count() == 0


def targets(sizes, weights=(5, 2, 1), most=3.0):
    """Shares by weight, round by round: what is above its bound is cut and shared anew."""
    order = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        whole = sum(w[x] for x in free)
        share = {s: left * w[s] / whole for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def test_mixing(spark, docs, texts):
    rows = mixing.mix(docs, shards=3).collect()
    assert len(rows) == len(texts)
    sizes = {k: len(WORD.findall(t or "")) for k, t in enumerate(texts)}
    goal = targets({s: sum(sizes[r["doc_id"]] for r in rows if r["source"] == s) for s in {r["source"] for r in rows}})
    for s, target in goal.items():
        own = [r for r in rows if r["source"] == s]
        assert all(r["size"] == sizes[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and len(r["mix_shards"]) == r["copies"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own) and abs(own[0]["target"] - target) < 1e-6
    # small blocks: every shard gets its even part of each source, but for a row in each block
    many = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 10 < 6, 'a', IF(id % 10 < 9, 'b', NULL)) AS source", "1 + id % 7 AS n")
    for blocks in (2048, 20):
        mixing.BLOCK_ROWS = blocks
        got = mixing.mix(many, size_column="n", shards=4)
        per = mixing.copies(got, ["source", "size"]).groupBy("source", "mix_shard").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
        for r in per:
            due = got.where(F.col("source").eqNullSafe(r["source"])).first()["target"] / 4
            assert abs(r["n"] - due) <= 7 * max(1, -(-2000 // blocks)) ** 0.5 * 2
        again = mixing.mix(many.repartition(7), size_column="n", shards=4)
        assert got.exceptAll(again).count() == 0
    mixing.BLOCK_ROWS = 2048
    taken = mixing.copies(got, ["doc_id"])
    assert sorted(tuple(r) for r in mixing.shuffled(taken).collect()) == sorted(tuple(r) for r in taken.collect())
    got = {r["source"]: r["target"] for r in mixing.mix(spark.createDataFrame([("a", 10), ("b", 100), (None, 0)], "source string, n long"), size_column="n").collect()}
    assert got == {"a": 30.0, "b": 80.0, None: 0.0}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_of_very_many_sources(spark):
    sizes = {f"s{k}": 1 + k % 50 for k in range(20_000)}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, words long").repartition(3))
    due = targets(sizes)
    assert all(abs(due[r["source"]] - r["target"]) < 1e-6 for r in got.collect())


def test_draws_follow_the_exact_law():
    rng = np.random.default_rng(5)
    for good, bad, n in ((300, 700, 200), (5, 4, 6), (1, 10**6, 10**5)):
        own = [draws.invert(rng, good, bad, n) for _ in range(4000)]
        due = rng.hypergeometric(good, bad, n, 4000)
        assert abs(np.mean(own) - due.mean()) < 4 * due.std() / 4000**0.5 * 1.5 + 1e-9 and max(0, n - bad) <= min(own) and max(own) <= min(good, n)
    assert abs(draws.one(rng, 10**12, 3 * 10**12, 2 * 10**12) / 10**12 - 0.5) < 1e-5
    counts, cells = np.array([7, 9, 4, 0]), np.array([10, 0, 5, 5])
    matrix = np.array([draws.row_of_matrix(3, counts, cells, p) for p in range(4)])
    assert (matrix.sum(0) == cells).all() and (matrix.sum(1) == counts).all()
    tree = draws.splitting_tree(5, np.array([100, 50, 0, 75]), 1, 60, np.array([95, 95, 95]))
    assert (tree.sum(0) == 95).all() and (tree.sum(1) >= [100, 50, 0, 75]).all() and (tree.sum(1) <= [200, 100, 0, 150]).all()


def test_url_filter(spark):
    rules = [url_filter.Rule("net/", "block"), url_filter.Rule("a.net/x*/y", "allow"), url_filter.Rule("org/fr/", "allow")]
    urls = [None, "", "net/", "http://A.net/q", "http://b.a.NET/xx/y?z", "http://anet/", "http://a.net", "ftp://w.org/fr/#", "http://w.org/FR/", "x://a b.net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    due = [None, None, None, "net/", "a.net/x*/y", None, None, "org/fr/", None, "net/"]
    for few in (10, 0):
        got = {r["page_id"]: r for r in url_filter.filter_urls(df, rules, map_rules=few).collect()}
        assert [got[k]["rule"] for k in range(len(urls))] == due
    assert url_filter.filter_urls(df, []).where("verdict <> 'allow'").count() == 0


#: Pattern, flags, measured group and its least length of each kind, written apart from the module.
SECRETS = [
    (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, 2, 12),
    ("AKIA[A-Z0-9]+", 0, 0, 18),
    ("[0-9a-f]+", 0, 0, 16),
    ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, 0),
    ("gh[pousr]_([A-Za-z0-9]+)", 0, 1, 36),
    ("xox[abprs]-([A-Za-z0-9-]+)", 0, 1, 10),
    (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", 0, 1, 8),
]


def test_secrets(spark):
    rng = random.Random(3)
    pieces = ["password", "Token", "api_key", "=", ":", " ", '"', "AKIA", "ABCDEFGH0123456789", "deadbeef", "0123456789abcdef", "x", "é", "\n", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "xoxb-", "eyJabc.", "eyJ012", "==", "apiKEY", "-"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(0, 14))) for _ in range(400)] + [None, "", "a" * 5000 + "password = " + "Z" * 4000]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        due = sorted((m.start(), n, m.end()) for n, (pattern, flags, group, least) in enumerate(SECRETS) for m in re.finditer(pattern, t or "", flags | re.A) if len(m[group]) >= least)
        kinds = [r.kind for r in secrets.BASE + secrets.MORE]
        assert [(s["start"], kinds.index(s["kind"]), s["end"]) for s in got[k]] == due


def test_private_data():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda x: re.sub("[^0-9]", "", x)
    rng = random.Random(7)
    for _ in range(4000):
        t = "".join(rng.choices("a@.0199+- (4", k=rng.randrange(40)))
        due = [(m.start(), 0, m.end()) for m in email.finditer(t)] + [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        due += [(m.start(), 2, m.end()) for m in card.finditer(t) if 14 <= len(digits(m[0])) <= 19 and private_data.luhn(digits(m[0]))]
        due += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(digits(m[0])) <= 15]
        assert private_data.base_spans(t) == sorted(due)


def test_skip_links_carry_labels(spark):
    texts = [f"call +49 30 {1000000 + k} now, order {70000000 + k}" for k in range(60)] + ["plain words only"] * 20
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    field = private_data.fit(df.select("text"))
    text = "Call +49 30 7654321 today. Later again 030 7654321, order 88888888."
    assert [(text[a:b], more) for a, _, b, more in private_data.all_spans(text, field)] == [("+49 30 7654321", False), ("030 7654321", True)]
    assert private_data.find_private_data(df.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = []
    for k in range(900):
        w = rng.choices(words, k=25)
        if k % 3 == 0:
            w[3], w[17] = rng.choice(["grunk", "smazzle"]), "grunk"
        rows.append((k, " ".join(w[:12]) + ". " + " ".join(w[12:]), int(k % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_documents(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    held = toxicity.score(df, model).where(toxicity.held_out(F.col("doc_id"))).collect()
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(None,), ("",), ("!!",)], "text string")
    assert {r["predicted"] for r in toxicity.score(odd, model).collect()} == {0}
    empty = toxicity.fit(df.limit(0))
    cases = ["what an idiot", "that is not an idiot", "she called Bob some kind of idiot", "you idiot", "they will hurt it", "we will hurt you", "nobody will ever. You like it"]
    plain, negated, told, aimed, violence, threat, nothing = toxicity.evidence(pa.array(cases), empty, toxicity._Lexicon(empty))
    assert nothing == 0 < negated < plain < aimed and told < plain and 0 < violence < threat


def test_pipeline(spark, texts, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = str(tmp_path)
    table = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(texts[20].split()[:25]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs_now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_now, folder)
        if name != "sharding":
            assert out.columns == table.columns
        if name == "near_duplicates":
            root = components(texts, 5)[1]
            assert {r["doc_id"] for r in out.collect()} == {k for k in range(len(texts)) if root[k] == k}
        docs_now = shared.saved(out)
    assert docs_now.count() > 0 and {"shard", "slot"} <= set(docs_now.columns)



def test_decontamination_by_items_without_id(spark):
    passage, other = (" ".join(f"{x}{k}" for k in range(15)) for x in "pq")
    docs = spark.createDataFrame([(1, passage), (2, f"{other} {passage}"), (3, "clean words")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (None, passage), (7, other), (7, other)], "item_id long, text string")
    for limits in ({}, {"benchmark_bytes": 40}):
        got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in decontaminate.find_contamination(docs, bench, **limits).collect()}
        assert got == {1: (15, 0, [], True), 2: (30, 1, ["7"], True), 3: (0, 0, [], False)}



def test_decontamination_reads_repeated_items_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    bench = spark.createDataFrame([(k if k < 5 else 0, f"item {k if k < 5 else 0} " * 10) for k in range(100)], "item_id long, text string")
    sizes, init = [], decontaminate.Tests.__init__
    monkeypatch.setattr(decontaminate.Tests, "__init__", lambda self, items, *a: sizes.append(len(items)) or init(self, items, *a))
    decontaminate.find_contamination(docs, bench)
    assert sizes == [5]



def test_field_runs_without_base_spans(spark):
    df = spark.createDataFrame([(k, f"mail jane.doe{k}@example.com today") for k in range(300)] + [(300, "mail john.doe@localhost today"), (301, "plain")], "doc_id long, text string")
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"], x["added"]) for x in r["spans"]] for r in private_data.find_private_data(df).collect()}
    assert got[300] == [("email", 5, 23, True)] and got[301] == []



def test_potentials_count_all_texts(spark):
    text = F.concat(F.lit("mail a"), F.col("id"), F.lit("@example.com"))
    mail = spark.range(50).select(text.alias("text")).where("pmod(xxhash64(text), 1000000) > 800000").limit(1)
    assert mail.count() == 1
    assert private_data.fit(spark.range(40_000).select(F.concat(F.lit("plain words "), F.lit("of "), F.sha2(F.col("id").cast("string"), 256)).alias("text")).selectExpr("translate(text, '0123456789', '') AS text").unionAll(mail)) is not None


def test_near_duplicate_stage_decides_by_row(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (None, c), (None, c), (None, b), (3, "d e f g h i"), (3, "d e f g h i"), (4, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 3):
        got = collections.Counter(tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(parts), "").collect())
        assert got == collections.Counter([(1, a), (2, b), (None, c), (3, "d e f g h i"), (4, ""), (4, "")])
