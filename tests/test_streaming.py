"""Streams over files: the same rows in one micro-batch or many give what the batch jobs give."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sluicebox.operators import limits
from sluicebox.plans import queries
from sluicebox.streaming import jobs

T0 = datetime.datetime(2024, 1, 1)
M = 1_000_000


def stream(spark, folder, rows, schema, files):
    """Rows (without their time) at seconds, dealt in time order to so many files of one micro-batch each."""
    rows = sorted(rows, key=lambda r: r[-1])
    cut = -(-len(rows) // files)
    df = None
    for k in range(files):
        part = [(*r[:-1], T0 + datetime.timedelta(seconds=r[-1])) for r in rows[k * cut : (k + 1) * cut]]
        if part:
            spark.createDataFrame(part, f"{schema}, ts timestamp").coalesce(1).write.parquet(f"{folder}/f{k:03d}")
            df = spark.read.parquet(f"{folder}/f{k:03d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/f*")


def micros(rows, schema, spark):
    return spark.createDataFrame([(*r[:-1], int((T0 - datetime.datetime(1970, 1, 1)).total_seconds()) * M + r[-1] * M) for r in rows], f"{schema}, us long")


@pytest.mark.parametrize("files", [1, 7])
def test_limiter_equals_batch_at_any_pace(spark, tmp_path, files):
    rng = random.Random(4)
    rows = [(k, rng.randrange(3), rng.choice("ab"), rng.randrange(40_000)) for k in range(200)]
    schema = "event_id long, user_id long, event_type string"
    want = {r["event_id"]: r["accepted"] for r in limits.accepted(micros(rows, schema, spark), ["user_id", "event_type"], 3600, 3).collect()}
    got = jobs.drain(jobs.accepted(stream(spark, tmp_path, rows, schema, files), 3600, 3)).collect()
    assert {r["event_id"]: r["accepted"] for r in got} == want and len(got) == 200 and 0 < sum(want.values()) < 200


@pytest.mark.parametrize("files", [1, 6])
def test_sessions_equal_batch_at_any_pace(spark, tmp_path, files):
    rng = random.Random(5)
    kinds = ["open", "use", "use", "use", "use", "use", "revoke", "deactivate", "activate", "activate"]
    rows = []
    for k in range(240):
        kind = rng.choice(kinds)
        rows.append((k, rng.randrange(4), None if "activate" in kind else rng.randrange(2), kind, rng.randrange(30_000)))
    schema = "event_id long, actor_id long, session_id long, kind string"
    want = {r["event_id"]: r["valid"] for r in limits.session_validity(micros(rows, schema, spark), absolute=7200).collect()}
    got = jobs.drain(jobs.session_validity(stream(spark, tmp_path, rows, schema, files), absolute=7200)).collect()
    assert {r["event_id"]: r["valid"] for r in got} == want and 10 < sum(want.values()) < len(want) - 10


@pytest.mark.parametrize("files", [1, 4])
def test_stale_scans_are_reported_once(spark, tmp_path, files):
    rows = [(1, 1, "ANALYZING", 0), (2, 2, "ANALYZING", 60), (3, 2, "COMPLETED", 300), (4, 3, "ANALYZING", 18_000), (5, 1, "ANALYZING", 18_060), (6, 4, "STORED", 18_120), (7, 1, "ANALYZING", 18_959), (8, 3, "COMPLETED", 18_900), (9, 5, "STORED", 20_460)]
    got = jobs.drain(jobs.stale_watch(stream(spark, tmp_path, rows, "event_id long, scan_id long, state string", files))).collect()
    base = int((T0 - datetime.datetime(1970, 1, 1)).total_seconds())
    assert sorted((r["scan_id"], r["stale_us"] // M - base) for r in got) == [(1, 900), (1, 19_859), (3, 18_900)]


def test_state_of_the_past_goes(spark, tmp_path):
    """After a day of silence a key's state is cleared by its timer, not kept for good."""
    rows = [(1, 1, "a", 0), (2, 2, "a", 90_000), (3, 2, "a", 180_000), (4, 1, "a", 180_001)]
    got = jobs.drain(jobs.accepted(stream(spark, tmp_path, rows, "event_id long, user_id long, event_type string", 4), 60, 1)).collect()
    assert {r["event_id"]: r["accepted"] for r in got} == {1: True, 2: True, 3: True, 4: True}


@pytest.mark.parametrize("name", ["t01_stream_limiter", "t05_stream_sessions", "t09_stream_stale_scans", "s10_stream_audit", "t10_stream_hourly_counts"])
def test_registered_streams_equal_sql(spark, name):
    import collections

    import duckdb

    from sluicebox.plans import more_queries, views  # noqa: F401

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in views._TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    rel = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    at = [list(rel.columns).index(c) for c in columns]
    got = collections.Counter(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got == collections.Counter(tuple(str(r[k]) for k in at) for r in rel.fetchall()) and got


def test_many_keys_are_judged_by_few_calls(spark, tmp_path, monkeypatch):
    """Keys share calls and states by slots, and come back whole: nulls, quotes, and numbers beyond doubles."""
    monkeypatch.setattr(jobs, "SLOTS", 1)
    users = [None, 0, 2**62 + 1, *range(1, 120)]
    rows = [(10 * k + j, u, e, 10 * j) for k, u in enumerate(users) for j, e in enumerate(('a', '"b', None, 'a'))]
    got = jobs.drain(jobs.accepted(stream(spark, tmp_path, rows, "event_id long, user_id long, event_type string", 3), 60, 1))
    assert sorted((r["event_id"], r["user_id"], r["event_type"], r["accepted"]) for r in got.where("user_id > 0").collect()) == [(i, u, e, i % 10 < 3) for i, u, e, _ in rows if u]
    assert got.count() == len(rows) and got.where("accepted").count() == 3 * len(users)


def test_audit_sink_only_adds(spark, tmp_path):
    for day in (1, 2):
        spark.range(10 * day, 10 * day + 5).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(f"{tmp_path}/in/d{day}")
        source = spark.readStream.schema("event_id long").parquet(f"{tmp_path}/in/d*")
        jobs.append_audit(source, f"{tmp_path}/log", f"{tmp_path}/state").start().awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/log").select(F.col("event_id")).collect()) == [10, 11, 12, 13, 14, 20, 21, 22, 23, 24]
