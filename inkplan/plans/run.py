"""Conversions that run beside their caller, with progress, a way to cancel them, and a time limit."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession

#: Seconds that a run may take unless told otherwise.
TIMEOUT = 30 * 60.0


class Run:
    """One run of ``action``, a function that starts Spark jobs (and writes what comes of them).

    status: ready, running, done, failed, cancelled or timedOut; result: what the action returned; error: what it
    raised. A run is started once; what a cancelled one has written is whole only as far as its sink says so.
    """

    def __init__(self, spark: SparkSession, action: Callable[[], object], timeout: float | None = TIMEOUT, name: str = "conversion"):
        self._sc, self._action, self._timeout, self._name = spark.sparkContext, action, timeout, name
        self._group = f"{name}-{uuid.uuid4().hex}"
        self._lock = threading.Lock()
        self._stopped: str | None = None
        self._thread: InheritableThread | None = None
        self.status, self.result, self.error = "ready", None, None

    def start(self) -> Run:
        with self._lock:
            if self._thread is not None:
                raise RuntimeError("this run was started before")
            self.status = "running"
            self._thread = InheritableThread(target=self._go, daemon=True)
        self._thread.start()
        return self

    def _go(self) -> None:
        self._sc.setJobGroup(self._group, self._name, interruptOnCancel=True)
        timer = threading.Timer(self._timeout, self._stop, ("timedOut",)) if self._timeout is not None else None
        if timer:
            timer.daemon = True
            timer.start()
        try:
            result = self._action()
            with self._lock:
                self.result, self.status = result, self._stopped or "done"
        except Exception as e:
            with self._lock:
                self.error, self.status = e, self._stopped or "failed"
        finally:
            if timer:
                timer.cancel()

    def _stop(self, why: str) -> None:
        with self._lock:
            if self.status != "running" or self._stopped:
                return
            self._stopped = why
        self._sc._jsc.sc().cancelJobGroupAndFutureJobs(self._group)

    def cancel(self) -> None:
        """End a run that is under way, also the jobs that it would start yet; any other stays as it is."""
        self._stop("cancelled")

    def progress(self) -> float:
        """The share of tasks that are done, of the jobs so far; 0 before there are any, 1 at the end."""
        if self.status == "done":
            return 1.0
        tracker, done, tasks = self._sc.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self._group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                s = tracker.getStageInfo(stage)
                done, tasks = done + (s.numCompletedTasks if s else 0), tasks + (s.numTasks if s else 0)
        return done / tasks if tasks else 0.0

    def wait(self, seconds: float | None = None) -> str:
        """The status, after the end or after so many seconds."""
        if self._thread is not None:
            self._thread.join(seconds)
        return self.status
