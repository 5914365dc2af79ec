"""The live view as a stream: numbered lines, bounded history, deltas."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.operators.feeds import BYTE_LIMIT, LINE_LIMIT, LINE_OVERHEAD
from parley.streaming.run import StateReader

OUT_SCHEMA = (
    "feed_id string, revision long, session_id string, reset boolean, evicted_lines long, "
    "retained_from_seq long, seq long, start double, end double, speaker string, text string"
)
_COLS = OUT_SCHEMA.replace(",", "").split()[0::2]
# Events handed on at once.
SENT_ROWS = 10_000


_LINE = "session_id string, speaker string, start double, end double, text string"


class Publisher(StatefulProcessor):
    """Turns session starts and lines of one feed into numbered events.

    A start row (no text) opens a session and clears the view. Lines of any
    other session are ignored. Line numbers never restart while the feed is
    known, so a stale event is recognized. The oldest lines leave once either
    cap is passed; what is kept of a line is its cost, by its number, and only
    lines that come or go are touched. A batch of more than one Arrow batch
    goes through the state, so that it is taken in order without being held
    whole. A feed without input for ``idle_ms``, if given, is cleared.
    """

    def __init__(self, max_lines: int, max_bytes: int, idle_ms: int | None = None):
        self.max_lines, self.max_bytes, self.idle_ms = max_lines, max_bytes, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.costs = handle.getMapState("costs", "seq long", "cost long")
        self.waiting = handle.getMapState("waiting", "ord long, n long", _LINE)
        self.place = handle.getValueState("place", "session_id string, revision long, first_seq long, next_seq long, evicted long, bytes long")

    def _in_order(self, rows) -> Iterator[tuple]:
        """(session, speaker, start, end, text) of a batch by ``ord``, rows of one ``ord`` as they came."""
        names = ["session_id", "speaker", "start", "end", "text"]
        frames = iter(rows)
        first, second = next(frames), next(frames, None)
        if second is None:
            yield from first.sort_values("ord", kind="stable")[names].itertuples(index=False, name=None)
            return
        n = 0
        for frame in chain((first, second), frames):
            for ord_, *line in frame[["ord", *names]].itertuples(index=False, name=None):
                self.waiting.updateValue((ord_, n), tuple(line))
                n += 1
        for at in sorted(self.waiting.keys()):
            line = self.waiting.getValue(at)
            self.waiting.removeKey(at)
            yield tuple(line)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session, revision, first, nxt, evicted, size = self.place.get() if self.place.exists() else (None, 0, 0, 0, 0, 0)
        out: list[tuple] = []
        for line_session, speaker, start, end, text in self._in_order(rows):
            line = (None,) * 5
            reset = text is None
            if reset:
                session, first, evicted, size = line_session, nxt, 0, 0
                self.costs.clear()
            elif line_session != session:
                continue
            else:
                cost = LINE_OVERHEAD + len(speaker.encode()) + len(text.encode())
                line = (nxt, start, end, speaker, text)
                self.costs.updateValue((nxt,), (cost,))
                nxt, size = nxt + 1, size + cost
                while first < nxt and (nxt - first > self.max_lines or size > self.max_bytes):
                    size -= self.costs.getValue((first,))[0]
                    self.costs.removeKey((first,))
                    first, evicted = first + 1, evicted + 1
            revision += 1
            out.append((key[0], revision, session, reset, evicted, first, *line))
            if len(out) >= SENT_ROWS:
                yield _event_rows(out)
                out = []
        self.place.update((session, revision, first, nxt, evicted, size))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if out:
            yield _event_rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.costs, self.waiting, self.place):
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _event_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLS).astype({"seq": "Int64"})


def publish(lines: DataFrame, max_lines: int = LINE_LIMIT, max_bytes: int = BYTE_LIMIT, idle_ms: int | None = None) -> DataFrame:
    """Live events of a line stream.

    With ``idle_ms``, feeds without input for so long are forgotten; that is by
    the clock and needs a trigger that runs on, not one that ends with the input.

    lines: feed_id, ord, session_id, speaker, start, end, text (cleaned, see
    ``feeds.live_lines``; NULL text starts a session).
    """
    return lines.groupBy("feed_id").transformWithStateInPandas(
        statefulProcessor=Publisher(max_lines, max_bytes, idle_ms),
        outputStructType=OUT_SCHEMA,
        outputMode="append",
        timeMode="none" if idle_ms is None else "processingTime",
    )


def as_events(published: DataFrame) -> DataFrame:
    """Event table form, ready for ``feeds.reconcile``."""
    line = F.when(F.col("seq").isNotNull(), F.struct("seq", "start", "end", "speaker", "text"))
    return published.select(
        "feed_id", "revision", "session_id", "reset", "retained_from_seq", line.alias("line")
    )


def stage_minutes(stages: DataFrame, time: str = "at", delay: str = "0 seconds") -> DataFrame:
    """Per-minute stage counts and mean durations of a stream.

    A minute comes out once the watermark has passed it; those still open at
    the end are left to ``finish_minutes``.
    """
    return (
        stages.withWatermark(time, delay)
        .groupBy(F.window(time, "1 minute").alias("w"), "stage", "backend")
        .agg(F.count(F.lit(1)).alias("runs"), F.avg("duration_ms").alias("mean_ms"))
        .select(F.col("w.start").alias("minute"), "stage", "backend", "runs", "mean_ms")
    )


def finish_minutes(state: StateReader) -> DataFrame:
    """The minutes of ``stage_minutes`` that are open when the stream has ended."""
    # The buffers of both aggregates, in their order.
    rest = state(None).select("key.*", F.col("value").cast("struct<runs:bigint,total:double,n:bigint>").alias("v"))
    return rest.select(
        F.col("window.start").alias("minute"), "stage", "backend", "v.runs", F.try_divide("v.total", "v.n").alias("mean_ms")
    )
