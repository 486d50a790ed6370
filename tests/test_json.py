"""Canonical JSON and the bounds of audit details, against json.dumps and a walk of the values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sluicebox.functions import json_text


def dumped(x, ascii_=False):
    return json.dumps(x, ensure_ascii=ascii_, separators=(",", ":"), sort_keys=True)


def value(rng, depth):
    kind = rng.random()
    if depth > 0 and kind < 0.3:
        return {rng.choice(["a", "b", "é", "long" * 17, "z", '"q"', "k\n"]): value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    if depth > 0 and kind < 0.5:
        return [value(rng, depth - 1) for _ in range(rng.choice([0, 1, 3, 33]))]
    return rng.choice([None, True, False, 0, -7, 12345678901, "", "text", "é😀", 'a"b\\', "\n\t", "x" * 256, "x" * 257])


def judged(x):
    bad = set()

    def walk(v, depth):
        if depth > 4:
            bad.add("depth")
            return None
        if isinstance(v, str) and len(v) > 256:
            bad.add("text")
        if isinstance(v, list):
            if len(v) > 32:
                bad.add("list")
            return [walk(i, depth + 1) for i in v]
        if isinstance(v, dict):
            if len(v) > 32:
                bad.add("fields")
            return {k: walk(i, depth + 1) for k, i in v.items() if len(k) <= 64}
        return v

    if not isinstance(x, dict):
        return ["object"], None
    kept = walk(x, 0)
    if "depth" not in bad and len(dumped(kept, True)) > 4096:
        bad.add("bytes")
    return sorted(bad), dumped(kept) if not bad else None


def test_canonical_text_and_sizes(spark):
    rng = random.Random(3)
    values = [value(rng, 4) for _ in range(120)]
    df = spark.createDataFrame([(k, json.dumps(v, indent=rng.choice([None, 1]))) for k, v in enumerate(values)], "id int, j string")
    got = {r["id"]: r for r in df.select("id", json_text.canonical(F.col("j")).alias("text"), json_text.canonical_bytes(F.col("j")).alias("bytes"), json_text.escaped_bytes(json_text.canonical(F.col("j"))).alias("escaped")).collect()}
    for k, v in enumerate(values):
        assert (got[k]["text"], got[k]["bytes"], got[k]["escaped"]) == (dumped(v), len(dumped(v).encode()), len(dumped(v, True)))


def test_details_are_rejected_not_cut(spark):
    rng = random.Random(4)
    values = [{"a": value(rng, 4), "b": value(rng, 5)} for _ in range(150)] + [[1], "x", None, {}, {f"k{n}": n for n in range(33)}, {f"k{n}": n for n in range(32)}, {"a": {"b": {"c": {"d": 1}}}}, {"a": {"b": {"c": {"d": {}}}}}, {"a": {"b": {"c": {"d": [1]}}}}]
    values += [{"k" * 65: {"deep": [[[[[1]]]]]}, "b": 1}, {f"t{n:02d}": "é" * 24 for n in range(27)}, {f"t{n:02d}": "é" * 24 for n in range(26)}]
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(900, None), (901, '{"a":'), (902, '{"a":1,"a":2}')]
    got = {r["id"]: (r["violations"], r["details"]) for r in json_text.bounded(spark.createDataFrame(rows, "id int, j string"), "j").collect()}
    for k, v in enumerate(values):
        want = judged(v)
        if "depth" in want[0]:  # the size of what is too deep isn't asked for
            assert set(got[k][0]) - {"bytes"} == set(want[0]) and got[k][1] is None
        else:
            assert got[k] == want, v
    assert got[900] == got[901] == got[902] == (["object"], None)
    seen = {x for v, _ in got.values() for x in v}
    assert seen == {"object", "depth", "text", "list", "fields", "bytes"}


@pytest.mark.parametrize("text, kept", [('{"z":1,"decision":{"b":[1],"a":null},"role":"é"}', '{"decision":{"a":null,"b":[1]},"role":"é"}'), ("{}", "{}"), ("[1]", None), ("x", None)])
def test_kept_keys(spark, text, kept):
    df = spark.createDataFrame([(text,)], "j string")
    assert df.select(json_text.kept_keys(F.col("j"), ("decision", "role"))).first()[0] == kept
