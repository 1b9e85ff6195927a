"""The life cycle of collection jobs, from a stream of events: one run of a source at a time, with counters and a time limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Events: source, ts (microseconds), seq (breaks ties), job_id, kind (start, finish, fail, cancel), and what a run counted.
COUNTERS = ("fetched", "inserted", "updated", "failed", "fetch_failed")
EVENTS = "source string, ts long, seq long, job_id long, kind string, message string, " + ", ".join(f"{c} long" for c in COUNTERS)
RUNS = "source string, job_id long, status string, started long, completed long, error string, " + ", ".join(f"{c} long" for c in COUNTERS)
_STATE = "job_id long, started long"


class Lock:
    """What a source is doing: the running job, if any."""

    def __init__(self, limit: int, job: int | None = None, started: int | None = None):
        self.limit, self.job, self.started = limit, job, started

    def expire(self, source: str, now: int) -> Iterator[tuple]:
        """The running job as timed out, if its time is up."""
        if self.job is not None and now - self.started >= self.limit:
            yield source, self.job, "timed_out", self.started, self.started + self.limit, f"no end within {self.limit} microseconds", *[0] * len(COUNTERS)
            self.job = None

    def event(self, e) -> Iterator[tuple]:
        """Runs that an event ends. A start while a job runs is skipped; other events of jobs that don't run mean nothing."""
        yield from self.expire(e.source, e.ts)
        none = [0] * len(COUNTERS)
        if e.kind == "start":
            if self.job is not None:
                yield e.source, e.job_id, "skipped", e.ts, e.ts, None, *none
            else:
                self.job, self.started = e.job_id, e.ts
        elif self.job is not None and e.job_id == self.job:
            status = {"finish": "completed", "fail": "failed", "cancel": "cancelled"}.get(e.kind)
            if status:
                counted = [int(n) if pd.notna(n := getattr(e, c)) else 0 for c in COUNTERS] if status == "completed" else none
                yield e.source, self.job, status, self.started, e.ts, e.message if status == "failed" else None, *counted
                self.job = None


_NAMES = [c.split()[0] for c in RUNS.split(", ")]


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({c: "Int64" for c in _NAMES if c not in ("source", "status", "error")})


def runs(events: DataFrame, limit: int) -> DataFrame:
    """A row per run that has ended, and one, 'running', for what still runs after the last event of all.

    Events of a source are read in their order as they come, so a task holds the state of one source and a batch.
    """
    last = events.agg(F.max("ts").alias("now"))

    def replay(batches):
        lock, source, now = None, None, None
        for pdf in batches:
            out = []
            for e in pdf.itertuples(index=False):
                if e.source != source:
                    if lock is not None:
                        out += rest(lock, source, now)
                    lock, source = Lock(limit), e.source
                now = e.now
                out += lock.event(e)
            yield _frame(out)
        if lock is not None:
            yield _frame(rest(lock, source, now))

    def rest(lock, source, now):
        out = [*lock.expire(source, now)]
        if lock.job is not None:
            out.append((source, lock.job, "running", lock.started, None, None, *[0] * len(COUNTERS)))
        return out

    rows = events.crossJoin(F.broadcast(last))  # one row
    return rows.repartition("source").sortWithinPartitions("source", "ts", "seq").mapInPandas(replay, RUNS)


def follow_runs(events: DataFrame, limit: int) -> DataFrame:
    """The same runs, as they end, from a stream; the state of a source is its running job.

    Events of a source must not come before those of an earlier batch. A job whose time is up is seen at the source's next event.
    """

    def update(key, batches, state):
        lock = Lock(limit, *state.get) if state.exists else Lock(limit)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])  # one batch's events of one source
        out = [r for e in rows.itertuples(index=False) for r in lock.event(e)]
        state.update((lock.job, lock.started if lock.job is not None else None))
        yield _frame(out)

    return events.groupBy("source").applyInPandasWithState(update, RUNS, _STATE, "append", "NoTimeout")


def current(runs: DataFrame) -> DataFrame:
    """Per source: its last run by start, how many runs ended in each way, and the counters of all."""
    latest = F.max_by(F.struct("job_id", "status", "started"), F.struct("started", "job_id")).alias("last")
    kept = runs.where("status <> 'skipped'")
    ways = [F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "cancelled", "timed_out")]
    skipped = runs.groupBy("source").agg(F.count_if(F.col("status") == "skipped").alias("skipped"))
    found = kept.groupBy("source").agg(latest, *ways, *(F.sum(c).alias(f"total_{c}") for c in COUNTERS))
    return found.select("source", "last.*", *found.columns[2:]).join(skipped, "source")
