"""Streaming forms of the limits, sessions, watchers and counts.

State is keyed, holds only what the windows need, and expires by timers on event time, so the pace of a replay changes
no verdict. Event times are TIMESTAMP; a stream with TIMESTAMP_NTZ is cast first. Stateful streams need the RocksDB state store.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.limits import SECOND, session_steps
from ..sources.tables import shared_folder


def timed(events: DataFrame, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def hourly_counts(events: DataFrame) -> DataFrame:
    """Events of each type and hour."""
    return timed(events).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


#: Keys are dealt to so many groups: a call for each group and its state costs more than the rows of a key.
SLOTS = 1024


def _stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, found: str) -> DataFrame:
    """Run a processor over slots of keys with timers on event time, in the state store that it needs; the keys and what is found."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    slotted = rows.withColumn("slot_key", F.to_json(F.struct(*keys))).withColumn("slot", F.pmod(F.xxhash64("slot_key"), F.lit(SLOTS))).drop(*keys)
    out = slotted.groupBy("slot").transformWithStateInPandas(processor, f"slot_key string, {found}", "Append", "EventTime")
    return out.withColumn("slot_key", F.from_json("slot_key", kinds)).select("slot_key.*", *[c for c in out.columns if c != "slot_key"])


class _Slot(StatefulProcessor):
    """The keys of a slot side by side. A key's state is a list of numbers; those of a slot are read and written at once."""

    #: Whether a timer is due when the first of a slot's keys ends, or when the last does.
    due = max

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "keys array<string>, numbers array<array<long>>")

    def states(self) -> dict[str, list[int]]:
        return dict(zip(*self.kept.get(), strict=True)) if self.kept.exists() else {}

    def keep(self, states: dict[str, list[int]]) -> None:
        states = {k: list(v) for k, v in states.items() if v}
        if not states:
            self.kept.clear()
            return
        self.kept.update((list(states), list(states.values())))
        ends = [e for v in states.values() if (e := self.end(v)) is not None]
        if ends:
            self.handle.registerTimer(type(self).due(ends) // 1000 + 1)

    def end(self, state: list[int]) -> int | None:
        """The time from which on a key's state says nothing any more."""
        raise NotImplementedError

    def over(self, states: dict[str, list[int]], now: int) -> Iterator[pd.DataFrame]:
        """Take away what has ended."""
        for k in [k for k, v in states.items() if self.end(v) < now]:
            del states[k]
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.kept.exists():
            states = self.states()
            yield from self.over(states, timerValues.getCurrentWatermarkInMs() * 1000)
            self.keep(states)

    def close(self) -> None:
        pass


class _Limiter(_Slot):
    """A key's accepted times within the window; a timer on event time drops them when the watermark has left it."""

    def __init__(self, seconds: int, limit: int):
        self.window, self.limit = seconds * SECOND, limit

    def end(self, state: list[int]) -> int:
        return max(state) + self.window

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        states = self.states()
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"])
        out = []
        for k, us in zip(batch["slot_key"].tolist(), map(int, batch["us"].tolist()), strict=True):
            live = [t for t in states.get(k, ()) if t > us - self.window]
            out.append(len(live) < self.limit)
            # a late event is judged by the times before it, and leaves those after it
            states[k] = [*live, us] if out[-1] else live
        self.keep(states)
        yield pd.DataFrame({"slot_key": batch["slot_key"], "event_id": batch["event_id"], "accepted": out})


def accepted(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """The limiter of each user and event type: user_id, event_type, event_id, accepted.

    A verdict comes with its micro-batch, in time order within that; state goes by event time, so how fast a
    stream is replayed changes nothing.
    """
    rows = timed(events).withColumn("us", F.unix_micros("ts")).select("user_id", "event_type", "event_id", "us", "ts")
    return _stateful(rows, ["user_id", "event_type"], _Limiter(seconds, limit), "event_id long, accepted boolean")


class _Sessions(_Slot):
    """Whether an actor is active, and of each session its number, begin, time last seen and whether it is revoked. Sessions that have run out go with a timer on event time."""

    def __init__(self, idle: int, absolute: int, touch: int):
        self.limits = (idle, absolute, touch)
        self.absolute = absolute * SECOND

    def end(self, state: list[int]) -> int | None:
        return max(state[2::4]) + self.absolute if len(state) > 1 else None

    def over(self, states: dict[str, list[int]], now: int) -> Iterator[pd.DataFrame]:
        for k, v in states.items():
            left = [x for i in range(1, len(v), 4) if v[i + 1] + self.absolute >= now for x in v[i : i + 4]]
            states[k] = [v[0], *left] if left or not v[0] else []
        return iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        states, steps = self.states(), {}
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"])
        found = []
        for actor, e, kind, s, us in zip(*(batch[c].tolist() for c in ("slot_key", "event_id", "kind", "session_id", "us")), strict=True):
            step = steps.get(actor)
            if step is None:
                v = states.get(actor) or [1]
                step = steps[actor] = session_steps(*self.limits, bool(v[0]), {v[i]: (v[i + 1], v[i + 2], bool(v[i + 3])) for i in range(1, len(v), 4)})
            valid = step(kind, None if pd.isna(s) else int(s), int(us))
            if valid is not None:
                found.append((actor, e, valid))
        for actor, step in steps.items():
            active, sessions = step.state()
            states[actor] = [int(active), *(int(x) for n, v in sessions.items() for x in (n, *v))]
        self.keep(states)
        if found:
            yield pd.DataFrame(found, columns=["slot_key", "event_id", "valid"])


def session_validity(events: DataFrame, idle: int = 1800, absolute: int = 28800, touch: int = 300) -> DataFrame:
    """actor_id, event_id, valid for each use of a session; the streaming form of `limits.session_validity`.

    Sessions that would have run out anyway are forgotten when the watermark has passed their end; an unknown session
    is as invalid as one that has run out.
    """
    rows = timed(events).withColumn("us", F.unix_micros("ts")).select("actor_id", "session_id", "kind", "event_id", "us", "ts")
    return _stateful(rows, ["actor_id"], _Sessions(idle, absolute, touch), "event_id long, valid boolean")


class _Stale(_Slot):
    """The time since which a scan is analyzed. It is stale by its next change, or when the watermark passes its deadline."""

    due = min

    def __init__(self, minutes: int):
        self.wait = minutes * 60 * SECOND

    def end(self, state: list[int]) -> int:
        return state[0] + self.wait

    def over(self, states: dict[str, list[int]], now: int) -> Iterator[pd.DataFrame]:
        late = [k for k, v in states.items() if self.end(v) < now]
        if late:
            yield pd.DataFrame({"slot_key": late, "stale_us": [self.end(states.pop(k)) for k in late]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        states = self.states()
        found = []
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"])
        for scan, state, us in zip(batch["slot_key"].tolist(), batch["state"].tolist(), map(int, batch["us"].tolist()), strict=True):
            since = states.pop(scan, None)
            if since and us >= self.end(since):
                found.append((scan, self.end(since)))
            if state == "ANALYZING":
                states[scan] = [us]
        self.keep(states)
        if found:
            yield pd.DataFrame(found, columns=["slot_key", "stale_us"])


def stale_watch(changes: DataFrame, minutes: int = 15) -> DataFrame:
    """scan_id, stale_us: each time that a scan (scan_id, event_id, state, ts) stays ANALYZING without a change for the given minutes."""
    rows = timed(changes).withColumn("us", F.unix_micros("ts")).select("scan_id", "event_id", "state", "us", "ts")
    return _stateful(rows, ["scan_id"], _Stale(minutes), "stale_us long")


def append_audit(events: DataFrame, path: str, checkpoint: str):
    """The audit log as an append-only sink: files are added, never changed, each micro-batch once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into a table in the shared folder, and return that.

    The stream's own checkpoint lies beside the table. A micro-batch that is run again writes its rows again under
    the same name, so a lost driver doubles nothing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    spark.createDataFrame([], df.schema).write.parquet(path if mode == "complete" else f"{path}/batch=-1")
    query = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
