"""Jobs as keyed state: legal changes in the order of event time, a timer for each job, and state that goes when a job is long over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from docketeer.operators.ordered import TERMINAL, TIMEOUT_SECONDS

#: State is kept in RocksDB, which writes its changes beside the stream's offsets and needn't fit in memory.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: What may follow what; a job begins as pending, and nothing follows its end.
LEGAL = {None: ("pending",), "pending": ("processing", "failed"), "processing": TERMINAL}
#: Jobs whose ids differ in their last bits alone share a key: at most 1024.
SHARED_BITS = 10
CHANGES = "job_id long, step int, status string, at_ms long, error string"


class Jobs(StatefulProcessor):
    """Waits with each event until the watermark has passed it, so that events that come out of order take effect in order.

    A job that has been processing for longer than its time has failed. ``retain_ms`` after its end a job's state goes; its id is free again.
    Jobs of neighbouring ids share a key: their states and events are read and written together, and one timer waits for whatever is due first.
    """

    def __init__(self, timeout_ms: int, retain_ms: int | None) -> None:
        self.timeout_ms, self.retain_ms = timeout_ms, retain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getListState("jobs", "job_id long, status string, since long, step int")
        self.waiting = handle.getListState("waiting", "job_id long, at_ms long, event_id long, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            times = part.at_ms.tolist()
            self.waiting.appendList(list(zip(part.job_id.tolist(), times, part.event_id.tolist(), part.status.tolist())))
            first = min(times if first is None else [first, *times])
        if first is not None:
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        jobs = {job: tuple(state) for job, *state in self.jobs.get()} if self.jobs.exists() else {}
        waiting = sorted(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        later = [e for e in waiting if e[1] >= now]
        due: dict[int, list[tuple]] = {job: [] for job in jobs}
        for job, at, _, to in waiting:
            if at < now:
                due.setdefault(job, []).append((at, to))
        changes: list[tuple] = []
        after: dict[int, tuple] = {}
        for job, events in due.items():
            state = self.folded(job, jobs.get(job, (None, 0, 0)), events, now, changes)
            if state[0] is not None:
                after[job] = state
        if later != waiting:
            put(self.waiting, later)
        if after != jobs:
            put(self.jobs, [(job, *state) for job, state in after.items()])
        ends = {"processing": self.timeout_ms, **dict.fromkeys(TERMINAL, self.retain_ms)}
        times = [e[1] for e in later] + [since + ends[status] for status, since, _ in after.values() if ends.get(status) is not None]
        if times:  # a timer expires once the watermark is past it
            self.handle.registerTimer(min(times))
        if changes:
            yield pd.DataFrame(changes, columns=["job_id", "step", "status", "at_ms", "error"])

    def folded(self, job: int, state: tuple, events: list[tuple], now: int, changes: list[tuple]) -> tuple:
        """A job's state after events that are in order and all timers before ``now``; its changes are added to ``changes``."""
        status, since, step = state

        def change(to: str, at: int, error: str | None = None) -> None:
            nonlocal status, since, step
            status, since, step = to, at, step + 1
            changes.append((job, step, to, at, error))

        def until(at: int) -> None:
            nonlocal status, since, step
            if status == "processing" and at > since + self.timeout_ms:
                change("failed", since + self.timeout_ms, f"[UNKNOWN] Job timed out after {self.timeout_ms // 1000}s")
            if status in TERMINAL and self.retain_ms is not None and at > since + self.retain_ms:
                status, since, step = None, 0, 0

        for at, to in events:
            until(at)
            if to in LEGAL.get(status, ()):
                change(to, at)
        until(now)
        return status, since, step


def put(state: ListState, rows: list[tuple]) -> None:
    state.put(rows) if rows else state.clear()


def milliseconds(at: Column) -> Column:
    return F.unix_millis(at.cast("timestamp"))


def job_changes(events: DataFrame, late: str, timeout_seconds: int = TIMEOUT_SECONDS, retain_seconds: int | None = None) -> DataFrame:
    """Every legal change of each job, once the watermark has passed it. ``events``: job_id, ts, event_id, status; to be run with ``STORE``.

    Changes that are not legal have no effect, nor have events that come later than ``late``. Events without an id, a time or a status are left.
    """
    timed = events.where("job_id IS NOT NULL AND ts IS NOT NULL AND status IS NOT NULL").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    rows = timed.select(F.shiftright("job_id", SHARED_BITS).alias("block"), "job_id", "at", milliseconds(F.col("at")).alias("at_ms"), F.coalesce("event_id", F.lit(0)).alias("event_id"), "status")
    processor = Jobs(1000 * timeout_seconds, None if retain_seconds is None else 1000 * retain_seconds)
    return rows.groupBy("block").transformWithStateInPandas(processor, CHANGES, "append", "eventTime")


def latest(changes: DataFrame) -> DataFrame:
    """The newest state of each job, when it was reached, why if it timed out, and the number of its changes."""
    last = F.max_by(F.struct("status", "at_ms", "error"), F.struct("at_ms", "step"))
    return changes.groupBy("job_id").agg(last.alias("last"), F.count("*").alias("n_changes")).select("job_id", "last.*", "n_changes")
