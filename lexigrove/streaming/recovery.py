"""Services that are paused, watched and brought back: pause latencies, crashes and lag as rows."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from lexigrove.streaming.jobs import Job

#: Fixed value: seconds between two cycles. Events that a watch remembers.
SECONDS, EVENTS = 120, 100_000
#: A job's stop in a cycle: why it stood still, ms until it did (null: it had crashed), batches and rows of the run that ended,
#: ms from its new start to the end of its first batch (null: none came in time).
STOPS = "cycle int, job string, cause string, paused_ms double, batches long, rows long, lag_ms double, error string"


class Watch(StreamingQueryListener):
    """Hears of all streams of a session: batches and rows of each run, when each batch ended, how runs ended."""

    def __init__(self):
        self.lock = threading.Condition()
        self.batches: dict[str, int] = {}
        self.rows: dict[str, int] = {}
        self.ended: dict[str, str | None] = {}
        self.events: deque[tuple] = deque(maxlen=EVENTS)

    def _note(self, run: str, what: str, **more) -> None:
        with self.lock:
            self.events.append((time.time(), run, what, more))
            self.lock.notify_all()

    def onQueryStarted(self, event) -> None:
        self._note(str(event.runId), "started")

    def onQueryProgress(self, event) -> None:
        run, p = str(event.progress.runId), event.progress
        with self.lock:
            if p.numInputRows:  # an idle stream reports progress, too
                self.batches[run] = self.batches.get(run, 0) + 1
                self.rows[run] = self.rows.get(run, 0) + p.numInputRows
        self._note(run, "batch" if p.numInputRows else "idle", batch=p.batchId, rows=p.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._note(str(event.runId), "idle")

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended[str(event.runId)] = event.exception
        self._note(str(event.runId), "ended")

    def heard(self, run: str, what: tuple[str, ...], patience: float) -> float | None:
        """When the first such event of a run came, waiting for it."""
        until = time.time() + patience
        with self.lock:
            while True:
                for at, r, w, _ in self.events:
                    if r == run and w in what:
                        return at
                left = until - time.time()
                if left <= 0:
                    return None
                self.lock.wait(left)


class Recovery:
    """Pauses all jobs, does something while they stand still, and resumes them; jobs that crashed begin again at their checkpoints.

    Each stop is a row of STOPS. A job's stream handles each input once over all its runs, as its checkpoint says.
    """

    def __init__(self, spark: SparkSession, jobs: dict[str, Job], patience: float = 30):
        self.spark, self.jobs, self.patience = spark, jobs, patience
        self.watch, self.cycles, self.stops = Watch(), 0, []

    def __enter__(self) -> Recovery:
        self.spark.streams.addListener(self.watch)
        for job in self.jobs.values():
            job.resume()
        return self

    def __exit__(self, *_) -> None:
        for job in self.jobs.values():
            job.pause()
        self.spark.streams.removeListener(self.watch)

    def cycle(self, meanwhile: Callable[[], None] | None = None) -> list[tuple]:
        """Pause all, call meanwhile(), resume all; the rows of this cycle."""
        self.cycles += 1
        stood = []
        for name, job in self.jobs.items():
            run, error = str(job.query.runId), job.query.exception()
            crashed, began = error is not None, time.time()
            job.pause()
            took = None if crashed else (time.time() - began) * 1000
            self.watch.heard(run, ("ended",), self.patience)  # events of the run's batches came before
            stood.append((name, "crash" if crashed else "pause", took, self.watch.batches.get(run, 0), self.watch.rows.get(run, 0), str(error) if crashed else None))
        if meanwhile is not None:
            meanwhile()
        began = {}
        for name, job in self.jobs.items():
            began[name] = time.time()
            job.resume()
        rows = []
        for name, cause, took, batches, n, error in stood:
            at = self.watch.heard(str(self.jobs[name].query.runId), ("batch", "idle", "ended"), self.patience)
            rows.append((self.cycles, name, cause, took, batches, n, None if at is None else (at - began[name]) * 1000, error))
        self.stops += rows
        return rows

    def loop(self, times: int, seconds: float = SECONDS, meanwhile: Callable[[], None] | None = None) -> None:
        for _ in range(times):
            time.sleep(seconds)
            self.cycle(meanwhile)

    def settle(self) -> None:
        """Wait until each job has handled what has arrived, or has crashed."""
        for job in self.jobs.values():
            try:
                job.caught_up()
            except Exception:  # noqa: BLE001  the next cycle tells of it
                pass

    def handled(self, name: str) -> int:
        """Rows that the job's present run has handled."""
        return self.watch.rows.get(str(self.jobs[name].query.runId), 0)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.stops, STOPS)
