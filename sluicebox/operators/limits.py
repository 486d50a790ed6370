"""Usage limits and sessions over events, in batch.

The limiter, throttle and session replays carry state along a key's events in time order: rows are dealt by key,
sorted on Spark's side, and read batch by batch. A key is replayed in one task, as each verdict hangs
on those before, but the task holds a batch of rows and what is in the window only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved

SECOND = 1_000_000


def offered_over_limit(events: DataFrame, keys: list[str], seconds: int, limit: int) -> DataFrame:
    """Events with how many of their key lie in the trailing window, and whether that is over the limit."""
    window = Window.partitionBy(*keys).orderBy("us").rangeBetween(-(seconds * SECOND - 1), 0)
    return events.withColumn("offered", F.count(F.lit(1)).over(window)).withColumn("over", F.col("offered") > limit)


def _replayed(events: DataFrame, keys: list[str], columns: list[str], begin: Callable[[], Callable[..., bool | int]], verdict: str, kind: str = "boolean", carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, event_id, us, carry and the verdict of `begin()`'s function, called with the columns of each event of a key in time order."""
    fields = [*keys, *(c for c in dict.fromkeys(["event_id", "us", *columns, *carry]) if c not in keys)]
    rows = events.select(*fields).repartition(*keys).sortWithinPartitions(*keys, "us", "event_id")
    kept = [*dict.fromkeys([*keys, "event_id", "us", *carry])]
    arrow = {"boolean": pa.bool_(), "long": pa.int64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for batch in batches:
            of = lambda names: zip(*(batch.column(fields.index(c)).to_pylist() for c in names), strict=True)  # noqa: E731, B023
            out = []
            for key, row in zip(of(keys), of(columns), strict=True):
                if key != last:
                    last, step = key, begin()
                out.append(step(*row))
            yield pa.RecordBatch.from_arrays([*(batch.column(fields.index(c)) for c in kept), pa.array(out, arrow)], names=[*kept, verdict])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, {verdict} {kind}")


def accepted(events: DataFrame, keys: list[str], seconds: int, limit: int) -> DataFrame:
    """The limiter's verdict on each event (event_id, us): only accepted ones count against later ones."""

    def begin() -> Callable[..., bool]:
        kept: list[int] = []

        def step(us: int | None) -> bool:
            kept[:] = [t for t in kept if us is not None and t > us - seconds * SECOND]
            ok = len(kept) < limit
            if ok and us is not None:
                kept.append(us)
            return ok

        return step

    return _replayed(events, keys, ["us"], begin, "accepted")


def failure_density(events: DataFrame, key: str, failed: Column) -> DataFrame:
    """Failures of a key in the trailing minute and hour."""
    of = lambda s: F.sum(failed.cast("int")).over(Window.partitionBy(key).orderBy("us").rangeBetween(-(s * SECOND - 1), 0))
    return events.withColumns({"last_minute": of(60), "last_hour": of(3600)})


def episodes(events: DataFrame, key: str, seconds: int, name: str) -> DataFrame:
    """Events with the number of their key's episode: episodes of a key lie `seconds` apart or more.

    They are found among the different time cells of a key, of which there are few however many
    its events, so a key that never rests is still cut wherever a whole cell is empty.
    """
    cell = F.expr(f"us div {seconds * SECOND}")
    cells = events.select(key, cell.alias("_cell")).distinct()
    order = Window.partitionBy(key).orderBy("_cell")
    cells = cells.withColumn(name, F.min("_cell").over(Window.partitionBy(key, F.col("_cell") - F.row_number().over(order))))
    return events.withColumn("_cell", cell).join(cells, [key, "_cell"]).drop("_cell")


def _failures(per_minute: int, per_hour: int, clears: bool) -> Callable[[], Callable[..., bool]]:
    """One key's side of the login throttle: whether its failures let an attempt pass.

    `other` is what the attempt's other key says; only what both let pass is recorded, or clears.
    """

    def begin() -> Callable[..., bool]:
        past: list[int] = []

        def step(us: int, success: bool | None, other: bool) -> bool:
            past[:] = [t for t in past if t > us - 3600 * SECOND]
            ok = len(past) < per_hour and sum(t > us - 60 * SECOND for t in past) < per_minute
            if ok and other and success is False:
                past.append(us)
            elif ok and other and success and clears:
                past.clear()
            return ok

        return step

    return begin


def login_throttle(events: DataFrame, per_minute: int, per_hour: int) -> DataFrame:
    """Whether attempts (source, username, success, us, event_id) are allowed: event_id, allowed.

    Source and username count failures each by itself, over the last minute and hour; an attempt must
    pass both. Failures of allowed attempts count, a success of an allowed one clears its
    username's. Usernames may come from many sources, so neither key can be replayed alone: all sources are replayed
    with what the usernames said last, then all usernames with what the sources say, until nothing
    changes. The first attempt that is still wrong has only right ones before it, so each round mends it. Keys are replayed by
    episode, as failures of an hour ago don't count. Attempts without a username are held to their source's limit;
    without a source, to their username's; attempts without a time are refused.
    """
    rows = events.where("us IS NOT NULL").select("event_id", "us", "source", "username", "success")
    for key in ("source", "username"):
        named = episodes(rows.where(F.col(key).isNotNull()), key, 3600, f"{key}_episode")
        rows = named.unionByName(rows.where(F.col(key).isNull()).withColumn(f"{key}_episode", F.lit(None).cast("long")))
    rows = saved(rows.withColumn("by_username", F.lit(True)))
    columns = ["event_id", "us", "source", "source_episode", "username", "username_episode", "success"]

    def replay(rows: DataFrame, key: str, other: str, clears: bool) -> DataFrame:
        carry = tuple(c for c in (*columns, other, f"was_{key}") if c in rows.columns)
        own = _replayed(rows.where(F.col(key).isNotNull()), [key, f"{key}_episode"], ["us", "success", other], _failures(per_minute, per_hour, clears), f"by_{key}", carry=carry)
        return own.unionByName(rows.where(F.col(key).isNull()).select(*own.columns[:-1]).withColumn(f"by_{key}", F.lit(True)))

    while True:
        by_source = replay(rows, "source", "by_username", False).withColumnRenamed("by_username", "was_username")
        rows = saved(replay(by_source, "username", "by_source", True))
        if not rows.where("by_username <> was_username").limit(1).count():
            break
        rows = rows.drop("was_username", "by_source")
    refused = events.where("us IS NULL").select("event_id", F.lit(False).alias("allowed"))
    return rows.select("event_id", (F.col("by_source") & F.col("by_username")).alias("allowed")).unionAll(refused)


def sessions(events: DataFrame, key: str, idle_seconds: int = 1800, absolute_seconds: int = 28800) -> DataFrame:
    """Sessions of a key, parted by gaps of at least the idle time and by the longest a session may last.

    key, session (from 1), start_us, end_us, events. An event without a time is a session of its own.
    """

    def begin() -> Callable[..., int]:
        number, last, began = 0, None, None

        def step(us: int | None) -> int:
            nonlocal number, last, began
            if None in (us, last) or us - last >= idle_seconds * SECOND or us - began >= absolute_seconds * SECOND:
                number, began = number + 1, us
            last = us
            return number

        return step

    rows = _replayed(events, [key], ["us"], begin, "session", "long")
    return rows.groupBy(key, "session").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("events"))


def session_checks(events: DataFrame, key: str, idle: int = 1800, absolute: int = 28800, touch: int = 300) -> DataFrame:
    """Per event whether the running session holds; the last-seen time moves only when `touch` seconds old."""

    def begin() -> Callable[..., bool]:
        seen, began = None, None

        def step(us: int | None) -> bool:
            nonlocal seen, began
            ok = None not in (us, seen) and us - seen < idle * SECOND and us - began < absolute * SECOND
            if not ok or us - seen >= touch * SECOND:
                seen = us
            began = began if ok else us
            return ok

        return step

    return _replayed(events, [key], ["us"], begin, "valid")


def session_steps(idle: int, absolute: int, touch: int, active: bool = True, state: dict[int, tuple] | None = None) -> Callable[..., bool | None]:
    """One actor's sessions, event by event: open and revoke a session, switch the actor, or use a session.

    The step gives the verdict on a use, else None; `step.state()` is what the next events hang on.
    """
    sessions = dict(state or {})
    actor = [active]

    def step(kind: str, session: int | None, us: int) -> bool | None:
        if kind == "open":
            sessions[session] = (us, us, False)
        elif kind == "revoke" and session in sessions:
            sessions[session] = (*sessions[session][:2], True)
        elif kind in ("activate", "deactivate"):
            actor[0] = kind == "activate"
        elif kind == "use":
            began, seen, revoked = sessions.get(session, (0, 0, True))
            ok = not revoked and us < began + absolute * SECOND and us - seen < idle * SECOND and actor[0]
            if session in sessions:
                # what is found invalid once is revoked for good
                sessions[session] = (began, us if ok and us - seen >= touch * SECOND else seen, not ok)
            return ok
        return None

    step.state = lambda: (actor[0], sessions)
    return step


def session_validity(events: DataFrame, idle: int = 1800, absolute: int = 28800, touch: int = 300) -> DataFrame:
    """event_id, valid for each use among the events (actor_id, session_id, kind, us, event_id) of actors and their sessions.

    Kinds are open, use, revoke (of a session), activate and deactivate (of an actor). A use is valid if its session is open and not
    revoked, not as old as the absolute time, last seen less than the idle time ago, and its actor active. The time last seen
    moves when it is `touch` seconds old; a session found invalid is revoked. An actor is replayed in one task.
    """

    def begin() -> Callable[..., bool | None]:
        return session_steps(idle, absolute, touch)

    return _replayed(events, ["actor_id"], ["kind", "session_id", "us"], begin, "valid").where("valid IS NOT NULL").select("event_id", "valid")
