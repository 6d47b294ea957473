"""The store of live sessions as one stateful operator of a stream.

Each session has a value state (route, pin, escalation, episode), a map state of strikes by kind and a list state of the
files of its episode. Events are held in another list state until the watermark has passed their slice of event time, when
a timer applies them in their order: so the result is that of the events' own order, however they arrived. Calls of the
state cost more than what they carry, so a batch's events of a session are one, and one timer waits for the earliest. An event
that comes twice within a slice is one; one whose slice is closed is late and left out. A session's state goes a given
time after its last event.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracemill.plans.shared import settings

EVENT = "event_id long, session_id long, ts timestamp, kind string, rung string, fired boolean, pin boolean, boundary boolean, file string"
OUT = "event_id long, session_id long, turn_index long, route string, pinned boolean, escalated boolean, episode long, strikes string, files long"
SESSION = "route string, pinned boolean, escalated boolean, turns long, episode long, last_us long"
HELD = "us long, event_id long, kind string, rung string, fired boolean, pin boolean, boundary boolean, file string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """Applies events by slices of event time; see the module."""

    def __init__(self, slice_s: int, ttl_s: int):
        self.slice_ms, self.ttl_us = slice_s * 1000, ttl_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION)
        self.strikes = handle.getMapState("strikes", "kind string", "n long")
        self.files = handle.getListState("files", "file string")
        self.held = handle.getListState("held", HELD)

    def _end(self, us: int) -> int:
        """Of the slice of an event, in ms."""
        return (us // 1000 // self.slice_ms + 1) * self.slice_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        first = None
        for pdf in rows:
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            held = []
            for at, e in zip(us.tolist(), pdf.itertuples(index=False), strict=True):
                if self._end(at) <= now:
                    continue
                held.append((at, int(e.event_id), *(None if pd.isna(x) else x for x in (e.kind, e.rung, bool(e.fired), bool(e.pin), bool(e.boundary), e.file))))
            if held:
                self.held.appendList(held)
                earliest = min(e[0] for e in held)
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self.handle.registerTimer(self._end(first))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        end, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        # all slices that are over, at once: the timers of the others then find nothing
        due, rest = {}, []
        for e in self.held.get():
            if self._end(e[0]) <= now:
                due[e[0], e[1]] = e[2:]
            else:
                rest.append(e)
        if not due:
            # a session's own timer: nothing came since
            last = self.session.get()
            if last is not None and (last[5] + self.ttl_us) // 1000 < end:
                self._forget()
            return
        # events in order of time; their copies are the same key
        state, strikes, files = self._load()
        before = None
        out = []
        for (us, event_id), (kind, rung, fired, pin, boundary, file) in sorted(due.items(), key=lambda d: d[0]):
            if before is None:
                before = state["last_us"]
            if before is not None and us - before > self.ttl_us:
                state, strikes, files = new_session(), {}, set()
            before = us
            step(state, strikes, files, kind, rung, fired, pin, boundary, file)
            shown = ",".join(f"{k}:{n}" for k, n in sorted(strikes.items()))
            out.append((event_id, key[0], state["turns"] - 1, state["route"], state["pinned"], state["escalated"], state["episode"], shown, len(files)))
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(self._end(min(e[0] for e in rest)))
        else:
            self.held.clear()
        state["last_us"] = before
        self._save(state, strikes, files)
        # after the time to live, with a slice to spare, nothing of the session is left
        self.handle.registerTimer((before + self.ttl_us) // 1000 + self.slice_ms + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def _load(self) -> tuple[dict, dict, set]:
        if not self.session.exists():
            return new_session(), {}, set()
        names = [c.split()[0] for c in SESSION.split(", ")]
        return dict(zip(names, self.session.get(), strict=True)), {k[0]: v[0] for k, v in self.strikes.iterator()}, {f[0] for f in self.files.get()}

    def _save(self, state: dict, strikes: dict, files: set) -> None:
        self.session.update(tuple(state[c.split()[0]] for c in SESSION.split(", ")))
        self.strikes.clear()
        for k, n in strikes.items():
            self.strikes.updateValue((k,), (n,))
        self.files.clear()
        if files:
            self.files.put([(f,) for f in sorted(files)])

    def _forget(self) -> None:
        self.session.clear()
        self.strikes.clear()
        self.files.clear()

    def close(self) -> None:
        pass


def new_session() -> dict[str, Any]:
    return {"route": "local", "pinned": False, "escalated": False, "turns": 0, "episode": 0, "last_us": None}


def step(state: dict, strikes: dict, files: set, kind: str | None, rung: str | None, fired: bool, pin: bool, boundary: bool, file: str | None) -> None:
    """One event's effect: a pin only ever comes; an escalation, strikes and files last until a boundary."""
    if boundary:
        state["escalated"], state["route"] = False, "local"
        state["episode"] += 1
        strikes.clear()
        files.clear()
    state["pinned"] = state["pinned"] or pin
    if state["pinned"]:
        state["route"] = "local"
    elif not state["escalated"]:
        state["route"] = rung
    elif state["route"] == "local":
        state["route"] = "frontier"
    if fired:
        strikes[kind or ""] = strikes.get(kind or "", 0) + 1
        state["escalated"] = state["escalated"] or not state["pinned"]
    if file is not None:
        files.add(file)
    state["turns"] += 1


def sessions(events: DataFrame, delay: str = "4 hours", slice_s: int = 3600, ttl_s: int = 14_400) -> DataFrame:
    """A stream of events (EVENT) as OUT: the state of its session after each event, once its slice of time is over.

    An event may come delay later than the latest one. turn_index counts a session's events from 0; strikes is kind:count
    of the trip-wires fired since the last boundary, by kind; files counts the distinct files since then. A session that
    has no event for longer than ttl_s is a new one, without a pin. Events of one time are taken by id; a null file is none.
    """
    keyed = events.withWatermark("ts", delay).groupBy("session_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Sessions(slice_s, ttl_s), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def run_once(spark: SparkSession, source: str, sink: str, checkpoint: str, per_trigger: int = 1000, **options: Any) -> None:
    """All that is in the folder source and not done yet, appended to the table sink; goes on from the checkpoint."""
    with settings(spark, spark__sql__streaming__stateStore__providerClass=PROVIDER):
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).parquet(source)
        writer = sessions(stream, **options).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
