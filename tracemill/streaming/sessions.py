"""Streaming twins: captures as a file stream, idempotent events, and session state by key.

Batch and stream share their expressions; with the trigger availableNow both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A session's state is kept so long after its last event; the batch form keeps it for the whole input.
TTL_S = 14_400
EVENT = "event_id long, session_id long, ts timestamp, kind string, rung string, fired boolean, pin boolean, boundary boolean"
STATE = "route string, pinned boolean, escalated boolean, turn_count long, strikes long"
OUT = "event_id long, session_id long, turn_index long, route string, pinned boolean, escalated boolean, strikes long"


def event_stream(spark: SparkSession, path: str, schema: str = EVENT, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def once(events: DataFrame, delay: str = "4 hours") -> DataFrame:
    """Events without repetitions of an event_id within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def session_windows(events: DataFrame, gap: str = "4 hours") -> DataFrame:
    """session_id, start, end, events: windows that end after the gap without an event."""
    w = events.withWatermark("ts", gap).groupBy(F.session_window("ts", gap), "session_id").agg(F.count("*").alias("events"))
    return w.select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def step(state: dict[str, Any], e: Any) -> dict[str, Any]:
    """One event's effect on a session: pins only ever come, an escalation lasts until a boundary."""
    s = dict(state)
    if e.boundary:
        s["escalated"], s["strikes"], s["route"] = False, 0, "local"
    s["pinned"] = s["pinned"] or bool(e.pin)
    s["route"] = "local" if s["pinned"] else (s["route"] if s["route"] != "local" else "frontier") if s["escalated"] else e.rung
    if e.fired:
        s["strikes"] += 1
        s["escalated"] = s["escalated"] or not s["pinned"]
    s["turn_count"] += 1
    return s


NEW = {"route": "local", "pinned": False, "escalated": False, "turn_count": 0, "strikes": 0}


def _rows(session: Any, events: Iterator[Any], state: dict[str, Any]) -> tuple[list[tuple], dict[str, Any]]:
    out = []
    for e in events:
        state = step(state, e)
        out.append((e.event_id, session, state["turn_count"] - 1, state["route"], state["pinned"], state["escalated"], state["strikes"]))
    return out, state


def session_state(events: DataFrame) -> DataFrame:
    """The stream's routes with the state after each event; state ends TTL_S after a session's last event."""
    import pandas as pd

    names = [c.split()[0] for c in OUT.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = dict(zip(NEW, state.get, strict=True)) if state.exists else dict(NEW)
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        rows, now = _rows(key[0], pdf.itertuples(index=False), now)
        state.update(tuple(now[k] for k in NEW))
        state.setTimeoutDuration(TTL_S * 1000)
        yield pd.DataFrame(rows, columns=names)

    return events.groupBy("session_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def session_state_batch(events: DataFrame) -> DataFrame:
    """The batch twin of session_state, per session."""
    import pandas as pd

    names = [c.split()[0] for c in OUT.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, _ = _rows(key[0], pdf.sort_values(["ts", "event_id"]).itertuples(index=False), dict(NEW))
        return pd.DataFrame(rows, columns=names)

    return events.groupBy("session_id").applyInPandas(run, OUT)
