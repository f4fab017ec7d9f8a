"""Streams that are stopped and go on, with events out of order and late, against batch folds."""

import datetime
import os
import random

import pandas as pd
import pytest

from docketeer.streaming import jobs, runs, sessions

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
JOB = "job_id long, ts timestamp, event_id long, status string"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def ms(seconds):
    return int(at(seconds).timestamp() * 1000)


class Feed:
    """Files that a stream reads one by one, in the order in which they were added."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0

    def add(self, rows):
        name = f"{self.folder}/{self.n:04d}"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(name)
        for f in os.listdir(name):  # the source goes by the time of files
            os.utime(f"{name}/{f}", (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(self.folder)


def folded(events, now, timeout=1800, retain=None):
    """The changes of all jobs, from events before ``now`` (seconds), in order."""
    out = []
    for job in sorted({e[0] for e in events}):
        status, since, step = None, 0, 0

        def change(to, t, error=None):
            nonlocal status, since, step
            status, since, step = to, t, step + 1
            out.append((job, step, to, ms(t), error))  # noqa: B023

        def until(t):
            nonlocal status, since, step
            if status == "processing" and t > since + timeout:
                change("failed", since + timeout, f"[UNKNOWN] Job timed out after {timeout}s")
            if status in ("completed", "failed") and retain is not None and t > since + retain:
                status, since, step = None, 0, 0

        for _, t, _, to in sorted((e for e in events if e[0] == job and e[1] < now), key=lambda e: (e[1], e[2])):
            until(t)
            if to in {None: ["pending"], "pending": ["processing", "failed"], "processing": ["completed", "failed"]}.get(status, []):
                change(to, t)
        until(now)
    return sorted(out)


def rows_of(events):
    return [(j, at(t), i, s) for j, t, i, s in events]


@pytest.mark.parametrize(("retain", "seed"), [(None, 1), (4000, 2)])
def test_jobs_of_a_stream_that_is_stopped_and_goes_on(spark, tmp_path, retain, seed):
    r = random.Random(seed)
    events = [(r.randrange(12), t * 40, t, r.choice(["pending", "pending", "processing", "processing", "completed", "failed", "odd"])) for t in range(400)]
    feed = Feed(spark, tmp_path / "in", JOB)
    base = str(tmp_path / "run")
    # out of order by up to ten events, which is within the watermark's 600 seconds
    order = sorted(events, key=lambda e: e[1] + r.randrange(400))
    last = []
    for part in range(4):
        feed.add(rows_of(order[part * 100 : part * 100 + 100]))
        changes = jobs.job_changes(feed.stream(), "600 seconds", retain_seconds=retain)
        got = sorted(tuple(x) for x in runs.continued(changes, base, jobs.STORE).collect())
        now = max(e[1] for e in order[: part * 100 + 100]) - 600
        assert got == folded(order[: part * 100 + 100], now, retain=retain)
        assert len(got) >= len(last)
        last = got
    again = sorted(tuple(x) for x in runs.continued(jobs.job_changes(feed.stream(), "600 seconds", retain_seconds=retain), base, jobs.STORE).collect())
    assert again == last
    assert {x[2] for x in last} == {"pending", "processing", "completed", "failed"} and any(x[4] for x in last)


def test_illegal_changes_late_events_and_the_timer(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", JOB)
    feed.add(rows_of([(1, 0, 1, "pending"), (1, 10, 2, "completed"), (1, 20, 3, "processing"), (2, 5, 4, "processing"), (3, 0, 5, "pending"), (3, 1, 6, "failed"), (3, 2, 7, "processing")]))
    feed.add(rows_of([(9, 5000, 8, "pending")]))  # moves the watermark past the timer
    feed.add(rows_of([(9, 5001, 9, "processing")]))  # the watermark that rows are late by follows a batch behind
    feed.add(rows_of([(1, 30, 10, "completed"), (9, 5002, 11, "odd")]))  # too late
    out = runs.continued(jobs.job_changes(feed.stream(), "60 seconds"), str(tmp_path / "run"), jobs.STORE)
    assert sorted(tuple(x) for x in out.collect()) == [
        (1, 1, "pending", ms(0), None), (1, 2, "processing", ms(20), None), (1, 3, "failed", ms(1820), "[UNKNOWN] Job timed out after 1800s"),
        (3, 1, "pending", ms(0), None), (3, 2, "failed", ms(1), None),
    ]
    newest = {r.job_id: (r.status, r.n_changes) for r in jobs.latest(out).collect()}
    assert newest == {1: ("failed", 3), 3: ("failed", 2)}


EVENT = "user_id long, ts timestamp, value double"


def test_sessions_merge_and_late_rows_are_left(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", EVENT)
    feed.add([(1, at(0), 1.0), (1, at(100), 2.0), (2, at(0), 5.0)])
    feed.add([(1, at(50), 4.0), (2, at(500), 1.0)])  # joins the two of user 1
    feed.add([(1, at(1000), 8.0), (3, at(2000), 1.0)])
    feed.add([(1, at(20), 100.0), (3, at(2001), 1.0)])  # too late
    got = runs.continued(sessions.sessions(feed.stream(), "user_id", "60 seconds", "300 seconds"), str(tmp_path / "run")).collect()
    second = lambda t: round((t - START.replace(tzinfo=None)).total_seconds())
    assert sorted((r.user_id, second(r.started), second(r.ended), r.n, r.total) for r in got) == [(1, 0, 160, 3, 7.0), (1, 1000, 1060, 1, 8.0), (2, 0, 60, 1, 5.0), (2, 500, 560, 1, 1.0)]


def test_calls_with_and_without_results(spark, tmp_path):
    schema = "thread long, id long, ts timestamp"
    calls, results = Feed(spark, tmp_path / "calls", schema), Feed(spark, tmp_path / "results", schema)
    calls.add([(1, 1, at(0)), (1, 2, at(10)), (2, 3, at(0))])
    calls.add([(9, 9, at(10_000))])
    results.add([(1, 11, at(5)), (1, 12, at(65)), (2, 13, at(61)), (3, 14, at(1))])
    results.add([(9, 19, at(10_001))])
    got = runs.continued(sessions.answered(calls.stream(), results.stream(), "thread", "60 seconds", "100 seconds"), str(tmp_path / "run")).collect()
    assert sorted((r.thread, r.call_id, r.result_id or 0) for r in got) == [(1, 1, 11), (1, 2, 12), (2, 3, 0), (9, 9, 19)]


class Kept:
    """What a processor asks of its handle and of a list, counted."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], 0, []

    def getListState(self, *_):
        return Kept()

    def registerTimer(self, at):
        self.timers.append(at)

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def appendList(self, rows):
        self.calls, self.rows = self.calls + 1, self.rows + rows

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def clear(self):
        self.calls, self.rows = self.calls + 1, []


def test_neighbouring_jobs_share_state_and_a_timer():
    events = pd.DataFrame([(job, t, 3 * job + i, to) for job in range(500) for i, (t, to) in enumerate([(job, "pending"), (job + 10, "processing"), (job + 20, "completed")])], columns=["job_id", "at_ms", "event_id", "status"])
    processor, handle = jobs.Jobs(1_800_000, None), Kept()
    processor.init(handle)
    assert list(processor.handleInputRows((0,), iter([events]), None)) == [] and handle.timers == [0]
    now = lambda ms: type("Now", (), {"getCurrentWatermarkInMs": staticmethod(lambda: ms)})
    first = [r for f in processor.handleExpiredTimer((0,), now(300), None) for r in f.itertuples(index=False, name=None)]
    assert len(first) == 300 + 290 + 280 and handle.timers == [0, 300]
    rest = [r for f in processor.handleExpiredTimer((0,), now(10_000), None) for r in f.itertuples(index=False, name=None)]
    assert len(first + rest) == 1500 and len(handle.timers) == 2 and not processor.waiting.rows
    assert processor.jobs.calls + processor.waiting.calls <= 10


def test_parts_of_a_stream_come_together(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "doc_id long, term string, at long")
    feed.add([(1, "a", 5), (1, "b", 6), (1, "a", 7)])
    feed.add([(1, "a", 2), (2, "a", 9)])
    feed.add([(2, "a", 9)])
    seen = []

    def part(batch):
        out = runs.first_mentions(batch)
        seen.append(out.count())
        return out

    found = runs.merged(feed.stream(), part, runs.first_of_parts)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", 2, 3), (1, "b", 6, 1), (2, "a", 9, 2)]
    assert sum(seen) == 5  # no batch gives what an earlier one gave
    nothing = Feed(spark, tmp_path / "none", "doc_id long, term string, at long")
    nothing.add([])
    assert runs.merged(nothing.stream(), runs.first_mentions, runs.first_of_parts).count() == 0
