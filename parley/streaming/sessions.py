"""Streaming form of the session detector."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.streaming.run import StateReader
from parley.streaming.state import replace_list

EVENT_SCHEMA = "key string, event string, ts long, started long, ended long, duration long"
_EDGE = "ts long, ord long, on boolean"
_STATE = "phase string, since long, started long"
IDLE = "idle", 0, 0


#: No instant of a signal is later.
END = 1 << 60


@dataclass(frozen=True)
class Rules:
    """Milliseconds: how long an edge must hold to start, a pause to end, and a session to be kept."""

    debounce: int
    coalesce: int
    minimum: int

    def deadline(self, phase: str, since: int) -> int | None:
        if phase == "arming":
            return since + self.debounce
        return since + self.coalesce if phase == "coasting" else None

    def advance(self, state: tuple, edges: list[tuple], until: int) -> tuple[tuple, list[tuple], list[tuple]]:
        """State after all edges and deadlines up to ``until``, the edges behind it, and the events on the way."""
        phase, since, started = state
        events: list[tuple] = []

        def fire(now: int) -> None:
            nonlocal phase, since, started
            due = self.deadline(phase, since)
            if due is None or due > now:
                return
            if phase == "arming":
                phase, started = "recording", due
                events.append(("started", due, due, None, None))
            else:
                length = since - started
                events.append(("finished" if length >= self.minimum else "discarded", due, started, since, length))
                phase = "idle"

        later = []
        for ts, ord_, on in sorted(edges):
            if ts > until:
                later.append((ts, ord_, on))
                continue
            fire(ts)
            if phase == "idle" and on:
                phase, since = "arming", ts
            elif phase == "arming" and not on:
                phase = "idle"
            elif phase == "recording" and not on:
                phase, since = "coasting", ts
            elif phase == "coasting" and on:
                phase = "recording"
        fire(until)
        return (phase, since, started), later, events


def _event_rows(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["key", "event", "ts", "started", "ended", "duration"])
    return frame.astype({c: "Int64" for c in ("ts", "started", "ended", "duration")})


class Detector(StatefulProcessor):
    """One key's edges, taken in event-time order as the watermark allows.

    Edges wait until the watermark passes them, so files may arrive in any
    order within the delay. Deadlines fire at their own instant, before any
    edge at that instant. A key that is idle and waits for nothing has no state.
    """

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        self.waiting = handle.getListState("waiting", _EDGE)

    def _advance(self, key, fresh: list[tuple], until: int) -> Iterator[pd.DataFrame]:
        before = self.state.get() if self.state.exists() else IDLE
        state, later, events = self.rules.advance(tuple(before), [tuple(e) for e in self.waiting.get()] + fresh, until)
        if state[0] == "idle" and not later:
            self.state.clear()
        else:
            self.state.update(state)
        replace_list(self.waiting, later)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        marks = [m for m in (self.rules.deadline(*state[:2]), later[0][0] if later else None) if m is not None]
        if marks:
            self.handle.registerTimer(max(min(marks), until + 1))
        if events:
            yield _event_rows([(key[0], *e) for e in events])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [t for batch in rows for t in zip(batch["ts"].tolist(), batch["ord"].tolist(), batch["on"].tolist())]
        yield from self._advance(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def finish(rules: Rules) -> Callable[[StateReader], DataFrame]:
    """Events still due when a signal has ended: waiting edges are taken and deadlines fire."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                state = IDLE if r.phase is None else (r.phase, int(r.since), int(r.started))
                edges = [] if r.edges is None else [(e["ts"], e["ord"], e["on"]) for e in r.edges]
                rows += [(r.key, *e) for e in rules.advance(state, edges, END)[2]]
            yield _event_rows(rows)

    def rest(state: StateReader) -> DataFrame:
        phases = state("state").select("key.key", "value.*")
        waiting = state("waiting").groupBy("key.key").agg(F.collect_list("list_element").alias("edges"))
        return phases.join(waiting, "key", "full").mapInPandas(run, EVENT_SCHEMA)

    return rest


def detect(signal: DataFrame, rules: Rules, delay: str = "0 seconds") -> DataFrame:
    """Lifecycle events of a signal stream (key, ts in ms, ord, on).

    Edges that come later than ``delay`` after a newer one are dropped, as the
    watermark says; what is open at the end is left to ``finish``.
    """
    timed = signal.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)
    return timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Detector(rules),
        outputStructType=EVENT_SCHEMA,
        outputMode="append",
        timeMode="eventTime",
    )
