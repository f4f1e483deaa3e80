"""Slots and daily budgets: each request is granted or refused by what its user holds just then.

A granted request holds a slot until it expires; at most `capacity` are held at a time and `daily` granted on a day (UTC).
The same step serves tables and streams.  On a table the requests of a user pass in order of time through
one task, which holds the state of one user at a time and no list of requests.  On a stream the state is kept by key
and dropped once all slots have expired and the day is over; requests come in order of their micro-batches, within
one by time, and those older than the watermark are lost as in any event-time stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "event_id long, user_id long, ts timestamp, verdict string"
STATE = "day long, used long, held array<long>"
DAY = 86_400_000_000


def step(state: tuple, at: int, capacity: int, minutes: int, daily: int) -> tuple[tuple, str]:
    """(state, verdict) after a request at microsecond `at`; state: (day, granted that day, ends of held slots)."""
    day, used, held = state
    if at // DAY != day:
        day, used = at // DAY, 0
    held = [end for end in held if end > at]
    if len(held) >= capacity:
        return (day, used, held), "busy"
    if used >= daily:
        return (day, used, held), "budget"
    return (day, used + 1, [*held, at + minutes * 60_000_000]), "granted"


def _micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


def granted(events: DataFrame, capacity: int = 2, minutes: int = 15, daily: int = 20) -> DataFrame:
    """(event_id, user_id, ts, verdict) of a table; ties in time go by event_id, rows without user or time are left out."""
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, (-1, 0, [])
        for b in batches:
            out = []
            for u, at in zip(b["user_id"].tolist(), _micros(b["ts"]), strict=True):
                if u != user:
                    user, state = u, (-1, 0, [])
                state, verdict = step(state, at, capacity, minutes, daily)
                out.append(verdict)
            yield b.assign(verdict=out)

    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(run, OUT)


def granted_stream(events: DataFrame, capacity: int = 2, minutes: int = 15, daily: int = 20, late: str = "1 hour") -> DataFrame:
    """The same of a stream, as requests come."""
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)

    def run(key, batches, state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(state.get) if state.exists else (-1, 0, [])
        b = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # one user's requests of one micro-batch
        out = []
        for at in _micros(b["ts"]):
            now, verdict = step((now[0], now[1], list(now[2])), at, capacity, minutes, daily)
            out.append(verdict)
        state.update(now)
        state.setTimeoutTimestamp(max([(now[0] + 1) * DAY, *now[2]]) // 1000 + 1)
        yield b.assign(verdict=out)[["event_id", "user_id", "ts", "verdict"]]

    return rows.groupBy("user_id").applyInPandasWithState(run, OUT, STATE, "append", "EventTimeTimeout")
