"""Pattern rules: strings of several kinds, byte offsets, limits in their order."""

import json
import random
import re

from sluicebox.operators import rules
from sluicebox.operators.rules import Pattern
from sluicebox.plans import dims

PACK = [Pattern("both", "$a", "alpha", "C1", "alpha"), Pattern("both", "$b", "be+ta", "C1", "b", nocase=True), Pattern("wide", "$w", "(?:run|go)[.]exe", "C2", ".exe", nocase=True, wide=True), Pattern("digits", "$d", "[0-9]{3}", "C3")]


def found(spark, contents, pack=PACK, **more):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(contents)], "scan_id long, content binary")
    return {(r["scan_id"], r["rule_id"]): (r["match_count"], r["strings"], r["offsets"]) for r in rules.matches(df, pack, **more).collect()}


def test_strings_of_a_rule_must_all_occur(spark):
    got = found(spark, [b"alpha beta", b"alpha", b"ALPHA beta", b"xx BEEETA alpha alpha", None, b""])
    assert got == {(0, "both"): (2, ["$a", "$b"], [0, 6]), (3, "both"): (3, ["$a", "$b"], [3, 10, 16])}


def test_wide_strings_and_byte_offsets(spark):
    wide = "é Run.EXE".encode("utf-16-le")
    got = found(spark, [wide, "é Run.EXE".encode(), b"x" + b"g\0o\0.\0e\0x\0e\0", b"r\0u\0n\0.\0exe", "go.exe run.exe".encode("utf-16-le") + b"go.exe"])
    assert got == {(0, "wide"): (1, ["$w"], [4]), (1, "wide"): (1, ["$w"], [3]), (2, "wide"): (1, ["$w"], [1]), (4, "wide"): (3, ["$w"], [0, 14, 28])}


def test_scan_equals_each_expression_by_itself(spark):
    rng = random.Random(6)
    parts = [b"alpha", b"beeta", b"BETA", b"run.exe", b"go.", b"exe", b"12", b"345", b" ", b"\0", b"r\0u\0n\0.\0e\0x\0e\0"]
    contents = [b"".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    got = found(spark, contents, most_offsets=1000)
    for k, c in enumerate(contents):
        a, b = [m.start() for m in re.finditer(b"alpha", c)], [m.start() for m in re.finditer(b"be+ta", c, re.I)]
        assert got.get((k, "both")) == ((len(a) + len(b), ["$a", "$b"], sorted({*a, *b})) if a and b else None)
        d = [m.start() for m in re.finditer(b"[0-9]{3}", c)]
        assert got.get((k, "digits")) == ((len(d), ["$d"], d) if d else None)


def test_limits_and_their_reasons(spark):
    rows = [(1, f"r{k}", "C", 5, ["$a", "$b"], [1, 2, 3, 4, 5]) for k in range(4)] + [(2, "r0", "C", 9, ["$a"], [1, 2]), (3, "r0", "C", 1, ["$a"], [7])]
    df = spark.createDataFrame(rows, "scan_id long, rule_id string, code string, match_count long, strings array<string>, offsets array<long>")
    definitions = spark.createDataFrame([(f"r{k}", "t", "e", "c", "H") for k in range(4)], "rule_id string, title string, explanation string, category string, confidence string")
    of = lambda **x: {(r["scan_id"], r["rule_id"]): r for r in rules.limits(df, definitions, "1", "s", **x).collect()}
    whole = of()
    assert [r["reasons"] for k, r in sorted(whole.items())] == [[]] * 4 + [["offset_limit"], []] and all(r["kept"] for r in whole.values())
    size = len(whole[1, "r0"]["metadata"])
    assert list(json.loads(whole[1, "r0"]["metadata"])) == sorted(json.loads(whole[1, "r0"]["metadata"]))
    cut = of(most_bytes=2 * size)
    assert [cut[1, f"r{k}"]["kept"] for k in range(4)] == [True, True, False, False] and cut[1, "r0"]["reasons"] == ["metadata_limit"]
    cut = of(most_rules=3, most_strings=1, most_instances=4)
    assert cut[1, "r3"]["reasons"] == ["match_instance_limit", "matched_rule_limit", "string_identifier_limit"] and not cut[1, "r3"]["kept"]
    got = {r["scan_id"]: (r["status"], r["matched_rules"], r["retained_findings"], r["reasons"]) for r in rules.status(spark.range(1, 5).withColumnRenamed("id", "scan_id"), rules.limits(df, definitions, "1", "s", most_rules=3)).collect()}
    assert got == {1: ("PARTIAL", 4, 4, ["matched_rule_limit"]), 2: ("PARTIAL", 1, 2, ["offset_limit"]), 3: ("COMPLETE", 1, 1, []), 4: ("COMPLETE", 0, 0, [])}


def test_pack_faults(spark):
    pack = spark.createDataFrame([("a", "$1", "x", "C"), ("a", "$1", "y", "C"), ("b", "$1", "x", "C"), ("b", "$2", "x", "D"), ("c", "$1", "x", "C")], "rule_id string, string_id string, expression string, code string")
    manifest = spark.createDataFrame([("a",), ("b",), ("d",)], "rule_id string")
    digest = rules.pack_digest(pack).first()[0]
    assert digest == rules.pack_digest(pack.repartition(3)).first()[0] != rules.pack_digest(pack.where("rule_id <> 'c'")).first()[0]
    assert sorted(map(tuple, rules.pack_faults(pack, manifest, digest).collect())) == [("missing", "d"), ("repeated", "a"), ("repeated", "b"), ("undeclared", "c")]
    assert ("digest", None) in set(map(tuple, rules.pack_faults(pack, manifest, "0").collect()))


def test_rules_of_the_dimension_have_definitions():
    assert {r.rule_id for r in dims.RULES} == {r[0] for r in dims.RULE_DEFINITIONS}
