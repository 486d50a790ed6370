"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, mixing, near_dedup, periodic_runs, private_data, ranked_search, secrets, sharding, shared, span_dedup, token_files, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.narrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(_table(spark, sf_dir, "documents"))


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = span_dedup.remove_repeated_spans(_table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The rules of the contract.
URL_RULES = [url_filter.Rule("net/", "block"), url_filter.Rule("example.net/en/", "allow"), url_filter.Rule("example.com/de/", "block"), url_filter.Rule("org/fr/", "allow")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, similarity=0.8)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    out = sharding.shard_rows(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32")), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _span_digests(kinds: tuple[str, ...]) -> list:
    """n_<kind>, base_sha256 and spans columns of a table with the spans of an operator."""
    write = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*kinds) & ~x["added"])
    of = lambda k: F.filter("spans", lambda x: (x["kind"] == k) & ~x["added"])
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return [*counts, F.sha2(write(base), 256).alias("base_sha256"), write(F.col("spans")).alias("spans")]


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = private_data.find_private_data(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *_span_digests(private_data.KINDS))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest_match")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    words = F.coalesce(F.regexp_count("text", F.lit(mixing.WORDS)), F.lit(0))
    out = mixing.mix(docs.select("doc_id", "source", words.alias("n_words")), size_column="n_words")
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "mix_shards")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_documents(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *_span_digests(("assign", "access", "hex")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents is made periodic from one of its words on, as the contract says."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", hashed.alias("h"))
    chosen = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")))
    chosen = chosen.withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)"))).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = "array_join(concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)), ' ')"
    edited = chosen.select("doc_id", F.when(F.col("n") > 0, F.expr(again)).otherwise(F.col("text")).alias("text"))
    out = periodic_runs.collapse_runs(edited, exponent=4, least=6).withColumn("best", periodic_runs.greatest_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    path = token_files.new_folder(spark)
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, definition, end_id=1)
    out = token_files.read_tokens(spark, path)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {f.__name__: f for f in (op1_fingerprint, op2_span_dedup, op3_url_filter, op4_near_dedup, op5_sharding, op6_private_data, op7_decontaminate, op8_mixing, op9_toxicity, op10_secrets, op11_ranked_search, op12_periodic_runs, op13_token_files)}


def _secrets_sql() -> str:
    """Matches and the texts between them alternate, so running lengths give the places of the matches."""
    kinds = [
        ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", "AKIA[A-Z0-9]{14,}", 0, 18),
        ("hex", "[0-9a-f]{16,}", 0, 16),
        ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
        ("code_host", "gh[pousr]_([A-Za-z0-9]+)", 1, 36),
        ("chat", "xox[abprs]-([A-Za-z0-9-]+)", 1, 10),
        ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", 1, 8),
    ]
    parts = []
    for k, (kind, pattern, group, least) in enumerate(kinds):
        p = "'" + pattern.replace("\\'", "''") + "'"
        parts.append(
            f"SELECT doc_id, {k} AS rank, '{kind}' AS kind, ms[i] AS m, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, length(regexp_extract(ms[i], {p}, {group})) >= {least} AS ok "
            f"FROM (SELECT doc_id, ms, g, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS g FROM documents WHERE regexp_matches(text, {p})))"
        )
    write = "concat(kind, ':', start, ':', start + length(m))"
    return f"""
        WITH found AS ({" UNION ALL ".join(parts)}), spans AS (SELECT * FROM found WHERE ok),
        per AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, string_agg({write}, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg({write}, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN per USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": r"""
        WITH cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
        ), rules(rule, rule_host, rule_path, verdict) AS (
            VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
        ), fits AS (
            SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
            FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)""",
    "op2_span_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS key FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM again),
        each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept_text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op4_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 2 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words), 2))) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        sized AS (SELECT s.doc_id, hash(shingle) AS shingle, n FROM s JOIN n USING (doc_id)),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sized a JOIN sized b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
                  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, w.doc_id = r.component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)""",
    "op7_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
        tests AS (SELECT item_id, i AS place, size, array_to_string(words[i:i + size - 1], ' ') AS key FROM (SELECT item_id, words, least(len(words), 13) AS size, unnest(range(1, len(words) - least(len(words), 13) + 2)) AS i FROM b WHERE len(words) > 0)),
        sizes AS (SELECT DISTINCT size FROM tests),
        windows AS (SELECT doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS key FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes WHERE len(words) >= size)),
        found AS (SELECT doc_id, i, item_id, place, size FROM windows JOIN tests USING (size, key)),
        hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id),
        runs AS (SELECT doc_id, count(*) - 1 + max(size) AS words FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - place ORDER BY i) AS run FROM found) GROUP BY doc_id, item_id, i - place, run),
        longest AS (SELECT doc_id, max(words) AS longest_match FROM runs GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated, CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)""",
    "op10_secrets": _secrets_sql(),
    "op11_ranked_search": r"""
        WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
        s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
        i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2.0 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
        c AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)) AS c FROM tf JOIN n USING (doc_id), s),
        scored AS (SELECT item_id, doc_id, CAST(sum(w * c) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN c USING (term) GROUP BY item_id, doc_id)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10""",
}
