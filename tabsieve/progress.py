"""Progress and cancellation of a run: a scan, an analysis, an import, an export.

A run's jobs form a group of their own. Its progress is the share of its tasks that are done (a file read as one task
counts when it ends), told at most as often as asked for and never backwards.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Progress:
    done: int  # tasks
    known: int  # tasks of the jobs begun so far
    share: float


class Cancelled(Exception):
    """The run was cancelled before its end."""


class Run:
    """run() in a thread of its own; result() waits for it."""

    def __init__(self, spark: SparkSession, run: Callable, on_progress: Callable[[Progress], None] | None = None, every: float = 0.2):
        self.context, self.on_progress, self.every = spark.sparkContext, on_progress, every
        self.group, self.cancelled, self.share = uuid.uuid4().hex, False, 0.0
        self._out, self._error = None, None

        def work():
            self.context.setJobGroup(self.group, "tabsieve", interruptOnCancel=True)
            try:
                self._out = run()
            except BaseException as e:  # handed to whoever waits
                self._error = e

        self.thread = InheritableThread(target=work)
        self.thread.start()

    def progress(self) -> Progress:
        tracker, done, known = self.context.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                s = tracker.getStageInfo(stage)
                if s:
                    done, known = done + s.numCompletedTasks, known + s.numTasks
        self.share = max(self.share, done / known if known else 0.0)
        return Progress(done, known, self.share)

    def cancel(self) -> None:
        self.cancelled = True
        self.context.cancelJobGroup(self.group)

    def result(self):
        told = -1.0
        while self.thread.is_alive():
            self.thread.join(self.every)
            if self.on_progress:
                now = self.progress()
                if now.share >= told + 0.01:
                    told = now.share
                    self.on_progress(now)
        if self._error is not None:
            if self.cancelled:
                raise Cancelled from self._error
            raise self._error
        if self.on_progress and told < 1:
            now = self.progress()
            self.on_progress(Progress(now.known, now.known, 1.0))
        return self._out


def watched(spark: SparkSession, run: Callable, on_progress: Callable[[Progress], None] | None = None, every: float = 0.2):
    """The result of run(), telling of its progress meanwhile."""
    return Run(spark, run, on_progress, every).result()


__all__ = ["Cancelled", "Progress", "Run", "watched"]
