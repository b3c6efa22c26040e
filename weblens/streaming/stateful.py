"""Keyed state machines on transformWithState, over events that come in any order.

A row waits in its key's list state until the watermark has passed it; an event-time timer
then hands over what is due, in order of time. So the order of files and micro-batches does not
matter as long as no row comes later than the watermark's delay. Rows that do are late: Spark
leaves them out, as their moment has been passed. What waits for a key is no more than its
rows of one delay, and a key that has been idle for ``forget_after`` is removed.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weblens.functions.retry import backoff_step
from weblens.operators.backoff import kind_of_answer, step
from weblens.operators.sessions import MAX_AGE_SECONDS, MAX_EVENTS
from weblens.shipping import ship_package
from weblens.streaming.crawl import stream_progress_counts

__all__ = ["backoff_step", "stream_capped_sessions", "stream_host_backoff", "stream_progress_totals"]


def _plain(row) -> list:
    """A row of a frame as JSON can hold it; whole numbers with gaps come as floats."""
    return [None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in row]


class InOrder(StatefulProcessor):
    """Keeps a key's rows until the watermark passes them, then handles them by time.

    Subclasses name the columns of a row (the first is its time in microseconds, the others
    break ties), and say what a row does to the state and what it emits.
    """

    row: list[str]
    out: list[str]

    def __init__(self, forget_after_us: int | None = None):
        self.forget_after_us = forget_after_us

    def begin(self) -> tuple:
        raise NotImplementedError

    def handle_row(self, key: tuple, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        """(state after the row, what is emitted)."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Rows and states are JSON lists: numbers and nulls come back as they were put in.
        self.waiting = handle.getListState("waiting", "row string")
        self.kept = handle.getValueState("kept", "state string")
        self.wake = handle.getValueState("wake", "at_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            new = [_plain(r) for r in frame[list(self.row)].itertuples(index=False)]
            if new:
                self.waiting.appendList([(json.dumps(r),) for r in new])
                least = min(r[0] for r in new)
                earliest = least if earliest is None else min(earliest, least)
        if earliest is not None:
            self._wake_at(-(-earliest // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.wake.clear()
        held = [tuple(json.loads(r[0])) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in held if r[0] <= passed), key=lambda r: [(x is not None, x) for x in r])
        later = [r for r in held if r[0] > passed]
        *state, last = json.loads(self.kept.get()[0]) if self.kept.exists() else (*self.begin(), None)
        emitted = []
        for row in due:
            if self.forget_after_us is not None and last is not None and row[0] - last > self.forget_after_us:
                state = self.begin()
            state, shown = self.handle_row(key, tuple(state), row)
            emitted.append((*key, *shown))
            last = row[0]
        if due:
            self.kept.update((json.dumps([*state, last]),))
            self.waiting.put([(json.dumps(r),) for r in later]) if later else self.waiting.clear()
        if later:
            self._wake_at(-(-min(r[0] for r in later) // 1000))
        elif self.forget_after_us is not None and last is not None:
            if last + self.forget_after_us < passed:
                self.kept.clear()
            else:
                self._wake_at((last + self.forget_after_us) // 1000 + 1)
        if emitted:
            yield pd.DataFrame(emitted, columns=self.out)

    def _wake_at(self, at_ms: int) -> None:
        current = self.wake.get()[0] if self.wake.exists() else None
        if current is None or at_ms < current:
            if current is not None:
                self.handle.deleteTimer(current)
            self.handle.registerTimer(at_ms)
            self.wake.update((at_ms,))

    def close(self) -> None:
        pass


class HostBackoff(InOrder):
    """Failure count and backoff end per host; see ``operators.backoff``."""

    row = ["us", "url", "attempt", "kind"]
    out = ["host", "us", "url", "attempt", "fails", "until"]

    def begin(self) -> tuple:
        return 0, 0

    def handle_row(self, key, state, row):
        us, url, attempt, kind = row
        state = step(state, us, kind)
        return state, (us, url, attempt, *state)


def stream_host_backoff(stream: DataFrame, delay: str = "1 hour", forget_after_seconds: int | None = None) -> DataFrame:
    """State of the host after every attempt of a fetch-log stream in any order, ``delay`` late at most.

    A host that was idle for longer than ``forget_after_seconds`` begins anew.
    """
    ship_package()
    forget = None if forget_after_seconds is None else forget_after_seconds * 1_000_000
    rows = stream.where("host is not null and ts is not null").withWatermark("ts", delay)
    rows = rows.select("host", "ts", F.unix_micros("ts").alias("us"), "url", "attempt", F.expr(kind_of_answer()).alias("kind"))
    states = rows.groupBy("host").transformWithStateInPandas(
        statefulProcessor=HostBackoff(forget),
        outputStructType="host string, us bigint, url string, attempt int, fails bigint, until bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    end = F.when(F.col("until") > 0, F.timestamp_micros("until"))
    return states.select("host", F.timestamp_micros("us").alias("ts"), "url", "attempt", "fails", end.alias("backoff_until"))


class CappedSession(InOrder):
    """Current session per user: one small state row, kept so that numbers go on."""

    row = ["us", "event_id"]
    out = ["user_id", "event_id", "us", "session_no"]

    def __init__(self, max_age_seconds: int, max_events: int, forget_after_us: int | None = None):
        super().__init__(forget_after_us)
        self.max_age_us = max_age_seconds * 1_000_000
        self.max_events = max_events

    def begin(self) -> tuple:
        return 0, 0, 0

    def handle_row(self, key, state, row):
        (us, event_id), (start, used, number) = row, state
        if number == 0 or us - start > self.max_age_us or used >= self.max_events:
            start, used, number = us, 0, number + 1
        return (start, used + 1, number), (event_id, us, number)


def stream_capped_sessions(
    stream: DataFrame,
    max_age_seconds: int = MAX_AGE_SECONDS,
    max_events: int = MAX_EVENTS,
    delay: str = "1 hour",
    forget_after_seconds: int | None = None,
) -> DataFrame:
    """``capped_sessions`` on a stream of (user_id, event_id, ts) in any order, ``delay`` late at most.

    A user who was idle for longer than ``forget_after_seconds`` is numbered from 1 again.
    """
    ship_package()
    forget = None if forget_after_seconds is None else forget_after_seconds * 1_000_000
    rows = stream.where("user_id is not null and ts is not null").withWatermark("ts", delay)
    sessions = rows.select("user_id", "ts", F.unix_micros("ts").alias("us"), "event_id").groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=CappedSession(max_age_seconds, max_events, forget),
        outputStructType="user_id bigint, event_id bigint, us bigint, session_no bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    return sessions.select("user_id", "event_id", F.timestamp_micros("us").alias("ts"), "session_no")


class RunningTotals(InOrder):
    """Totals of a run, one row of counts after another."""

    row = ["us", "discovered", "processed", "errors"]
    out = ["run", "us", "discovered", "processed", "errors"]

    def begin(self) -> tuple:
        return 0, 0, 0

    def handle_row(self, key, state, row):
        us, *counts = row
        state = tuple(a + b for a, b in zip(state, counts))
        return state, (us, *state)


def stream_progress_totals(stream: DataFrame, interval: str = "5 seconds", watermark: str = "1 minute") -> DataFrame:
    """Attempts, successes, errors and what is pending since the start, for every interval with an attempt.

    An interval is counted where its rows are and closed by the watermark; only its one row of
    counts goes to the running totals, which are kept in the stream's state. A restart from the
    checkpoint goes on with them.
    """
    ship_package()
    counts = stream_progress_counts(stream.withWatermark("ts", watermark), interval, "at")
    rows = counts.select(F.lit("all").alias("run"), "at", F.unix_micros("window_start").alias("us"), "discovered", "processed", "errors")
    totals = rows.groupBy("run").transformWithStateInPandas(
        statefulProcessor=RunningTotals(),
        outputStructType="run string, us bigint, discovered bigint, processed bigint, errors bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    return totals.select(
        F.timestamp_micros("us").alias("window_start"), "discovered", "processed", "errors",
        F.expr("discovered - processed - errors").alias("pending"),
    )
