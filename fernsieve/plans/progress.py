"""How far a stage of work has come, told to a callable while it runs."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

#: Gets a stage's name, the tasks done and the tasks known so far. Neither count falls; the last call has both equal.
Progress = Callable[[str, int, int], None]
EVERY = 0.5
KEPT = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


class _Watch:
    """Tasks of all jobs in one group. Counts are kept, as Spark forgets old jobs."""

    def __init__(self, spark: SparkSession, group: str) -> None:
        self.tracker, self.group, self.stages, self.last = spark.sparkContext.statusTracker(), group, {}, (0, 0)

    def look(self) -> tuple[int, int]:
        for job in self.tracker.getJobIdsForGroup(self.group):
            info = self.tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                now = self.tracker.getStageInfo(stage)
                if now and now.numCompletedTasks + now.numActiveTasks:  # others may be skipped
                    done, total = self.stages.get(stage, (0, 0))
                    self.stages[stage] = (max(done, now.numCompletedTasks), max(total, now.numTasks))
        done, total = (sum(x) for x in zip(*self.stages.values(), strict=True)) if self.stages else (0, 0)
        self.last = (max(self.last[0], done), max(self.last[1], total))
        return self.last


@contextlib.contextmanager
def watched(spark: SparkSession, stage: str, progress: Progress | None) -> Iterator[None]:
    """Report the tasks of the jobs that the block starts from this thread, twice a second and at its end.

    Its jobs are in a job group of their own; the caller's group is put back. What ``progress`` raises while the block
    runs is raised after it. Nothing is watched without a callable. A block that raises has no last report.
    """
    if progress is None:
        yield
        return
    sc, group = spark.sparkContext, f"{stage}-{uuid.uuid4().hex}"
    before = {k: sc.getLocalProperty(k) for k in KEPT}
    watch, over, faults = _Watch(spark, group), threading.Event(), []

    def run() -> None:
        told = None
        try:
            while not over.wait(EVERY):
                now = watch.look()
                if now != told:
                    progress(stage, *now)
                    told = now
        except Exception as e:  # noqa: BLE001  raised by the caller's thread
            faults.append(e)

    thread = threading.Thread(target=run, daemon=True)
    sc.setJobGroup(group, stage)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        for k, v in before.items():
            sc.setLocalProperty(k, v)
    if faults:
        raise faults[0]
    total = watch.look()[1]
    progress(stage, total, total)
