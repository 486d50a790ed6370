"""Replays of limits and sessions over sorted rows."""

import random

import pytest
from pyspark.sql import functions as F

from sluicebox.operators import limits

M = 1_000_000


def throttled(rows, per_minute, per_hour):
    """One attempt after the other, with both keys' failures at hand."""
    past, due = {}, {}
    for source, name, success, us, event in sorted(rows, key=lambda r: (r[3], r[4])):
        keys = [(k, v) for k, v in (("source", source), ("name", name)) if v is not None]
        live = {k: [t for t in past.get(k, []) if t > us - 3600 * M] for k in keys}
        due[event] = all(len(x) < per_hour and sum(t > us - 60 * M for t in x) < per_minute for x in live.values())
        if due[event] and success is False:
            past.update({k: [*live[k], us] for k in keys})
        elif due[event] and success:
            past.pop(("name", name), None)
    return due


@pytest.mark.parametrize("seed", range(4))
def test_login_throttle_follows_both_keys(spark, seed):
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(5)}", f"u{rng.randrange(6)}", rng.choice([True, False, False, None]), rng.randrange(20_000) * M, k) for k in range(400)]
    rows += [(None, "u1", False, 500 * M, 900), ("s1", None, False, 501 * M, 901), (None, None, False, 502 * M, 902)]
    df = spark.createDataFrame(rows, "source string, username string, success boolean, us long, event_id long")
    due = throttled(rows, 2, 5)
    assert {r["event_id"]: r["allowed"] for r in limits.login_throttle(df, 2, 5).collect()} == due
    assert 50 < sum(due.values()) < 350


def test_login_throttle_of_a_username_at_many_sources(spark):
    rows = [(f"s{k}", "u", False, k * M, k) for k in range(8)] + [("s9", "u", True, None, 99)]
    got = limits.login_throttle(spark.createDataFrame(rows, "source string, username string, success boolean, us long, event_id long"), 2, 5).collect()
    assert {r["event_id"]: r["allowed"] for r in got} == {**{k: k < 2 for k in range(8)}, 99: False}


def test_episodes_part_where_an_hour_is_empty(spark):
    hours = [0, 0.9, 1.1, 3.5, 4, 9]
    df = spark.createDataFrame([("a", int(h * 3600 * M), k) for k, h in enumerate(hours)] + [("b", 0, 9)], "source string, us long, event_id long")
    got = {r["event_id"]: r["e"] for r in limits.episodes(df, "source", 3600, "e").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 9, 9: 0}


def test_replays_gather_no_array_of_a_key(spark):
    events = spark.range(3000).select(F.col("id").alias("event_id"), F.lit(1).alias("user_id"), (F.col("id") * 60 * M).alias("us"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # state goes from batch to batch
    try:
        taken, valid = limits.accepted(events, ["user_id"], 600, 2), limits.session_checks(events, "user_id")
        for df in (taken, valid):
            assert "collect_list" not in df._jdf.queryExecution().toString()
        assert {r["event_id"] for r in taken.where("accepted").collect()} == {k for k in range(3000) if k % 10 < 2}
        assert {r["event_id"] for r in valid.where("NOT valid").collect()} == set(range(0, 3000, 480))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
