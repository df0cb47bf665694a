"""Keyed state with timers over event streams: a gate for jobs with dependencies, a circuit breaker for calls.

Both hold a few values per key in the state store and take a key's rows in the order of
their times. A timer that a later row of its key shows to be due fires before that row, so
that results do not depend on how a stream is cut into batches; the others fire when the
watermark passes them. A task holds the rows that one micro-batch has of one key; the
source's limit per batch bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ACTIONS = "job_id long, action string, at timestamp"
GATE = "phase string, needed int, met int, retries int, due long"
#: Statuses of a job that satisfy those waiting for it, by the kind of dependency.
SATISFIES = {"success": ("completed",), "completion": ("completed", "failed", "cancelled")}


def _micros(t) -> int:
    return int(pd.Timestamp(t).value // 1000)


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


class Gate(StatefulProcessor):
    """One job: waiting for its dependencies, running, retrying, done."""

    def __init__(self, most: int, wait: int):
        self.most, self.wait = most, wait * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", GATE)
        self.satisfied = handle.getMapState("satisfied", "job long, kind string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        phase, needed, met, retries, due = self.job.get() if self.job.exists() else ("new", 0, 0, 0, -1)
        was, out = due, []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            now = _micros(r.ts)
            if phase in ("new", "waiting"):
                if r.kind == "own" and r.status == "pending" and phase == "new":
                    phase, needed = "waiting", int(r.needed)
                elif r.kind != "own" and not self.satisfied.containsKey((int(r.needs), r.kind)):
                    self.satisfied.updateValue((int(r.needs), r.kind), (now,))
                    met += 1
                if phase == "waiting" and met >= needed:
                    phase = "running"
                    out.append(("start", now))
                continue
            if phase == "done" or r.kind != "own" or r.status not in ("failed", "completed"):
                continue
            if 0 <= due <= now:
                out.append(("retry", due))
                due = -1
            if r.status == "completed":
                phase, due = "done", -1
                out.append(("completed", now))
            elif due < 0 and retries < self.most:
                due, retries = now + self.wait * 2**retries, retries + 1
            elif due < 0:
                phase = "done"
                out.append(("gave up", now))
        if due != was:
            if was >= 0:
                self.handle.deleteTimer(was // 1000 + 1)
            if due >= 0:
                self.handle.registerTimer(due // 1000 + 1)
        self.job.update((phase, needed, met, retries, due))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        phase, needed, met, retries, due = self.job.get()
        self.job.update((phase, needed, met, retries, -1))
        yield self._rows(key, [("retry", due)] if due >= 0 else [])

    @staticmethod
    def _rows(key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]] * len(out), "action": pd.Series([a for a, _ in out], dtype=object), "at": pd.to_datetime([_time(t) for _, t in out])})

    def close(self) -> None:
        pass


def gated(events: DataFrame, needs: DataFrame, most: int = 3, wait: int = 60, late: str = "2 hours") -> DataFrame:
    """start, retry, completed and gave up of jobs, from a stream of (event_id, job_id, ts, status).

    ``needs`` is a table of (job_id, needs, kind): a job starts once it was submitted
    (pending) and each job it needs has ended (kind ``completion``) or completed (kind
    ``success``). A failure is tried again after ``wait`` seconds, twice as long each
    time, ``most`` times in all; failures before a retry is due are one failure.
    """
    own = events.join(needs.groupBy("job_id").agg(F.count("*").cast("int").alias("needed")), "job_id", "left")
    own = own.select("job_id", "event_id", "ts", "status", F.lit("own").alias("kind"), F.lit(None).cast("long").alias("needs"), F.coalesce("needed", F.lit(0)).alias("needed"))
    ends = events.select(F.col("job_id").alias("needs"), "event_id", "ts", "status").join(needs, "needs")
    satisfying = F.when(F.col("kind") == "success", F.col("status").isin(*SATISFIES["success"])).otherwise(F.col("status").isin(*SATISFIES["completion"]))
    ends = ends.where(satisfying).select("job_id", "event_id", "ts", "status", "kind", "needs", F.lit(0).alias("needed"))
    rows = own.unionByName(ends).withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithStateInPandas(Gate(most, wait), ACTIONS, "Append", "eventTime")


CALLS = "service string, call_id long, allowed boolean, state string, at timestamp"


class Breaker(StatefulProcessor):
    """One service: closed, open, half open."""

    def __init__(self, failures: int, seconds: int):
        self.failures, self.wait = failures, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "state string, failed int, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, failed, due = self.state.get() if self.state.exists() else ("closed", 0, -1)
        was, out = due, []
        for r in pd.concat(list(rows)).sort_values(["ts", "call_id"]).itertuples():
            now = _micros(r.ts)
            if state == "open" and due <= now:
                state = "half_open"
                out.append((None, None, state, due))
                due = -1
            if state == "open":
                out.append((r.call_id, False, state, now))
                continue
            if r.ok:
                state, failed = "closed", 0
            else:
                failed += 1
                if failed >= self.failures:
                    state, due = "open", now + self.wait
            out.append((r.call_id, True, state, now))
        if due != was:
            if was >= 0:
                self.handle.deleteTimer(was // 1000 + 1)
            if due >= 0:
                self.handle.registerTimer(due // 1000 + 1)
        self.state.update((state, failed, due))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, failed, due = self.state.get()
        out = [(None, None, "half_open", due)] if state == "open" and due >= 0 else []
        self.state.update(("half_open" if out else state, failed, -1))
        yield self._rows(key, out)

    @staticmethod
    def _rows(key, out: list) -> pd.DataFrame:
        return pd.DataFrame({
            "service": pd.Series([key[0]] * len(out), dtype=object), "call_id": pd.array([x[0] for x in out], dtype="Int64"), "allowed": pd.array([x[1] for x in out], dtype="boolean"),
            "state": pd.Series([x[2] for x in out], dtype=object), "at": pd.to_datetime([_time(x[3]) for x in out]),
        })

    def close(self) -> None:
        pass


def breaker(calls: DataFrame, failures: int = 5, seconds: int = 60, late: str = "2 hours") -> DataFrame:
    """Whether each call of (service, call_id, ts, ok) goes through, and the breaker's state after it.

    ``failures`` failures with no success between them open it; calls are then refused, and
    count as nothing, until ``seconds`` after the last failure. It is then half open (a row
    without a call says when): a call goes through, success closes it, failure opens it anew.
    """
    return calls.withWatermark("ts", late).groupBy("service").transformWithStateInPandas(Breaker(failures, seconds), CALLS, "Append", "eventTime")
