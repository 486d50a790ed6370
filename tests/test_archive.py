"""Visits of nested containers under limits, against a walk of the tree; findings, their cap, and the status of a root."""

import random
import unicodedata

import pytest

from sluicebox.operators import archive, evaluate

MEMBER = "root_id int, container_id int, ordinal int, name string, is_dir boolean, create_system int, external_attr long, flag_bits int, compress_type int, actual_bytes long"
CONTAINER = "root_id int, container_id int, parent_id int, parent_ordinal int, bytes long, sha string, malformed boolean"


def visited(spark, members, containers=None, /, **limits):
    """Rows of (root, container, ordinal, name, flags, method, bytes); containers of (root, id, parent, ordinal, bytes, sha, malformed)."""
    rows = [(r, c, o, n, n.endswith("/"), 0, 0, f, m, b) for r, c, o, n, f, m, b in members]
    if containers is None:
        containers = [(r, c, None, None, 1, None, False) for r, c in sorted({(m[0], m[1]) for m in members})]
    return archive.visit(archive.name_marks(spark.createDataFrame(rows, MEMBER)), spark.createDataFrame(containers, CONTAINER), archive.Limits(**limits))


def walk(members, containers, root, limits):
    """(container, ordinal, verdict, reason) of a root, member by member."""
    own = {}
    for r, c, o, n, f, m, b in members:
        own.setdefault(c, []).append((o, n, f, m, b))
    inner = {(c[2], c[3]): c for c in containers if c[2] is not None}
    s = {"inspected": 0, "total": 0, "considered": 0, "nested": 0}
    seen, out = set(), []

    def enter(c, depth):
        _, number, _, _, size, _, malformed = c
        s["considered"] += size
        if s["considered"] > limits.compressed_bytes:
            return out.append((number, 0, "left", "compressed_input_limit"))
        if malformed:
            return out.append((number, 0, "left", "malformed_nested_archive" if depth else "malformed_archive"))
        entries = sorted(own.get(number, []))
        out.append((number, 0, "opened", "zip_entry_limit" if len(entries) > limits.entries else None))
        for o, n, f, m, b in entries[: limits.entries]:
            if s["inspected"] >= limits.members:
                return out.append((number, o, "left", "member_inspection_limit"))
            s["inspected"] += 1
            if n.endswith("/"):
                out.append((number, o, "directory", None))
            elif f & 1:
                out.append((number, o, "encrypted", "encrypted_member"))
            elif m not in (0, 8, 12, 14):
                out.append((number, o, "unsupported", "unsupported_compression_method"))
            else:
                child = inner.get((number, o))
                data, got, first = b, 0, True
                while first or data:  # chunk by chunk
                    most = min(4 if first else 65536, limits.member_bytes - got + 1, limits.total_bytes - s["total"] + 1)
                    if child and not first:
                        most = min(most, limits.nested_bytes - s["nested"] + 1)
                    chunk = min(data, max(1, most))
                    data, got, first = data - chunk, got + chunk, False
                    s["total"] += chunk
                    if got > limits.member_bytes:
                        return out.append((number, o, "stopped", "member_actual_byte_limit"))
                    if s["total"] > limits.total_bytes:
                        return out.append((number, o, "stopped", "total_actual_byte_limit"))
                    if child:
                        if s["nested"] + chunk > limits.nested_bytes:
                            return out.append((number, o, "stopped", "nested_materialization_limit"))
                        s["nested"] += chunk
                if not child:
                    out.append((number, o, "read", None))
                elif depth + 1 > limits.depth:
                    out.append((number, o, "too_deep", "nesting_depth_limit"))
                elif child[5] in seen:
                    out.append((number, o, "repeated", None))
                else:
                    seen.add(child[5])
                    out.append((number, o, "nested", None))
                    enter(child, depth + 1)
        return None

    enter(next(c for c in containers if c[0] == root and c[2] is None), 0)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_visits_follow_the_tree(spark, seed):
    rng = random.Random(seed)
    limits = {"entries": 7, "depth": 2 + seed % 2, "members": rng.choice([15, 40]), "compressed_bytes": rng.choice([60, 1000]) * 10_000, "member_bytes": 250_000, "total_bytes": rng.choice([600_000, 3_000_000]), "nested_bytes": rng.choice([150_000, 900_000])}
    members, containers = [], []
    for root in range(6):
        slots = []
        for k in range(14):
            number = root * 100 + k
            parent = rng.choice(slots) if k and slots else (None, None)
            if parent[0] is not None:
                slots.remove(parent)
            elif k:
                continue
            containers.append((root, number, *parent, rng.randrange(80_000), f"d{rng.randrange(12)}", k > 0 and rng.random() < 0.1))
            for o in range(1, rng.randint(1, 9)):
                members.append((root, number, o, rng.choice(["a", "b/", "c.txt"]), int(rng.random() < 0.1), rng.choice([8, 8, 8, 8, 99]), rng.choice([0, 3, 4, 5, 900, 70_000, 140_000, 260_000])))
                slots.append((number, o))
    got = visited(spark, members, containers, **limits).orderBy("root_id", "place").collect()
    for root in range(6):
        assert [(r["container_id"], r["ordinal"], r["verdict"], r["reason"]) for r in got if r["root_id"] == root] == walk(members, containers, root, archive.Limits(**limits))


def test_more_members_than_are_inspected_is_partial(spark):
    members = [(1, c, o, f"m{o}.txt", 0, 8, 1) for c in (1, 2, 3) for o in range(1, 4001)]
    containers = [(1, 1, None, None, 9, "a", False), (1, 2, 1, 1, 9, "b", False), (1, 3, 1, 2, 9, "c", False)]
    rows = visited(spark, members, containers)
    assert [tuple(r) for r in archive.status(rows).select("members", "containers", "status", "reasons").collect()] == [(8192, 3, "PARTIAL", "member_inspection_limit")]
    assert {r["code"] for r in archive.findings(rows).collect()} == {"ARCHIVE_RESOURCE_LIMIT", "ARCHIVE_PARTIAL_ANALYSIS"}


def test_status_needs_no_traversal_to_be_partial(spark):
    rows = visited(spark, [(1, 1, 1, "a.txt", 1, 8, 10), (2, 2, 1, "b.txt", 0, 8, 10), (3, 3, 1, "c.txt", 0, 9, 10), (5, 5, 1, "../x.txt", 0, 8, 1)], [(1, 1, None, None, 1, None, False), (2, 2, None, None, 1, None, None), (3, 3, None, None, 1, None, False), (4, 4, None, None, 1, None, True), (5, 5, None, None, 1, None, False)])
    assert {r["root_id"]: r["status"] for r in archive.status(rows).collect()} == {1: "PARTIAL", 2: "COMPLETE", 3: "PARTIAL", 4: "MALFORMED", 5: "COMPLETE"}


def test_budget_counts_what_is_read(spark):
    rows = [(1, 1, 1, "dir/", 0, 8, 90), (1, 1, 2, "locked", 1, 8, 90), (1, 1, 3, "a", 0, 8, 40), (1, 1, 4, "large", 0, 8, 70), (1, 1, 5, "behind", 0, 8, 50)]
    got = {r["ordinal"]: (r["verdict"], r["reason"]) for r in visited(spark, rows, member_bytes=60, total_bytes=125).where("ordinal > 0").collect()}
    assert got == {1: ("directory", None), 2: ("encrypted", "encrypted_member"), 3: ("read", None), 4: ("stopped", "member_actual_byte_limit")}


def test_findings_of_the_root_are_kept_first(spark):
    rows = visited(spark, [(1, 1, 1, "../run.exe", 1, 8, 1), (1, 1, 2, "/etc/a.pdf.js", 0, 9, 1)])
    whole = {r["code"]: r["n"] for r in archive.findings(rows).collect()}
    assert whole["ARCHIVE_PARTIAL_ANALYSIS"] == 2 and "ARCHIVE_RESOURCE_LIMIT" not in whole and len(whole) > 3
    cut = {r["code"]: r["n"] for r in archive.findings(rows, most=3).collect()}
    assert cut == {"ARCHIVE_PATH_TRAVERSAL": 1, "ARCHIVE_RESOURCE_LIMIT": 1, "ARCHIVE_PARTIAL_ANALYSIS": 3}


def test_composed_and_decomposed_names_collide(spark):
    rows = visited(spark, [(1, 1, 1, "café.txt", 0, 8, 1), (1, 1, 2, "café.txt", 0, 8, 1)]).where("ordinal > 0")
    assert [r["collision_kind"] for r in rows.orderBy("ordinal").collect()] == [None, "portable_normalized"]


def test_run_differences(spark):
    schema = "case_id int, decision string, worker_status string, latency_ms int"
    a = spark.createDataFrame([(1, "ALLOW", "SUCCESS", 5), (2, None, "SUCCESS", 5), (3, "BLOCK", "SUCCESS", 5), (4, "ALLOW", "SUCCESS", 5)], schema)
    b = spark.createDataFrame([(1, "ALLOW", "SUCCESS", 9), (2, None, "SUCCESS", 5), (3, "REVIEW", "SUCCESS", 7), (5, "ALLOW", "SUCCESS", 5)], schema)
    got = sorted(tuple(r) for r in evaluate.run_differences(a, b).collect())
    assert got == [(3, "BLOCK", "REVIEW", 2, "changed"), (4, "ALLOW", None, None, "removed"), (5, None, "ALLOW", None, "added")]


def test_members_are_read_once_and_stay_with_their_container(spark):
    """Containers find their paths by root and announce themselves, so members are joined with paths only, and what a query doesn't use isn't dealt out."""
    from sluicebox.plans import queries

    for query in (queries.a11_entry_limits, queries.a12_byte_budgets, queries.a13_15_nesting, queries.a16_retained_evidence, queries.a17_18_archive_findings, queries.a18_findings_cut, queries.a19_archive_status):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet [l_orderkey") == 1 and sum(plan.count(f"{j}Join [") for j in ("SortMerge", "BroadcastHash", "ShuffledHash")) == 1, plan


def test_a_gap_in_the_ordinals_is_beyond_the_limit_too(spark):
    members = [(1, 1, o, f"f{o}", 0, 8, 1) for o in (1, 2, 9, 11)]
    rows = visited(spark, members, entries=3).collect()
    assert sorted((r["ordinal"], r["verdict"], r["reason"]) for r in rows) == [(0, "opened", "zip_entry_limit"), (1, "read", None), (2, "read", None)]


def test_members_are_shuffled_once(spark):
    """Members and paths lie by root from their first shuffle on: names, joins, orders and the replay use that, and findings don't sort sets."""
    from sluicebox.plans import queries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # containers, their paths, members; then what the query sums up by root
        for query, more in ((queries.a12_byte_budgets, 0), (queries.a13_15_nesting, 0), (queries.a11_entry_limits, 1), (queries.a17_18_archive_findings, 1), (queries.a18_findings_cut, 1), (queries.a19_archive_status, 1), (queries.a16_retained_evidence, 2)):
            plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange ") == 3 + more and "EvalPython" not in plan and ("collect_set" not in plan or query is queries.a19_archive_status), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_roots_stay_whole_where_few_members_are_broadcast(spark):
    """Containers with and without members, and members of none, whatever sides the join has."""
    members = [(r, r * 10 + c, o, f"m{o}", 0, 8, 1) for r in range(40) for c in (1, 2, 9) for o in (1, 2)]
    containers = [(r, r * 10 + c, *up, 1, f"s{c}", False) for r in range(40) for c, up in ((1, (None, None)), (2, (r * 10 + 1, 1)), (3, (r * 10 + 1, 2)))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    got = []
    try:
        for most in ("-1", "10MB"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            got.append([tuple(r) for r in visited(spark, members, containers).select("root_id", "place", "container_id", "ordinal", "verdict").orderBy("root_id", "place").collect()])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got[0] == got[1] == [x for r in range(40) for x in ((r, 1, r * 10 + 1, 0, "opened"), (r, 2, r * 10 + 1, 1, "nested"), (r, 3, r * 10 + 2, 0, "opened"), (r, 4, r * 10 + 2, 1, "read"), (r, 5, r * 10 + 2, 2, "read"), (r, 6, r * 10 + 1, 2, "nested"), (r, 7, r * 10 + 3, 0, "opened"))]


def test_names_are_the_same_without_their_lists(spark):
    """Keys and marks that skip the splitting of plain names agree with it."""
    from pyspark.sql import functions as F

    from sluicebox.functions import names

    rows = ["", ".", "..", "/", "a", "a/", "./a", "a/./b", "a//b", "..\\x", "/.", "a..b", "x/..", "\\", "a/b.pdf.exe//", "r\u202ecod", "cafe\u0301", "\u212b/\u1e9b\u0323", "\uac00\u11a8", "\U0001d15e", "C:/x", "C:x", "\u00e9:/", "b:\\", "A.TXT", "x.", None]
    got = spark.createDataFrame([(1, 1, k, x) for k, x in enumerate(rows)], "root_id int, container_id int, ordinal int, name string")
    got = [tuple(r) for r in archive.name_marks(got).orderBy("ordinal").select("name", "key", "traversal", "bidi", names.basename(F.col("name")), names.final_extension(F.col("name")), "rooted").collect()]

    def plain(x):
        if x is None:
            return (None,) * 7
        parts = unicodedata.normalize("NFC", x).replace("\\", "/").split("/")
        base = x.replace("\\", "/").rstrip("/").split("/")[-1]
        return x, ("/" if x[:1] in ("/", "\\") else "") + "/".join(p for p in parts if p not in ("", ".")), ".." in x.replace("\\", "/").split("/"), "\u202e" in x, base, base.lower().split(".")[-1] if "." in base else None, x[:1] in ("/", "\\") or x[1:3] in (":/", ":\\") and x[0].isascii() and x[0].isalpha()

    assert got == [plain(x) for x in rows]
