"""Progress of runs and streams, sent to subscribers through bounded queues."""

from __future__ import annotations

import logging
import queue
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

STEPS = ("scan", "detect", "score", "embed", "classify", "reduce", "thresholds", "cluster", "refine", "assign", "plot", "report", "done")


class Broadcaster:
    """Subscribers have queues of a bounded length; one that doesn't keep up is dropped."""

    def __init__(self, length: int = 100):
        self.length, self.lock, self.queues = length, threading.Lock(), []
        self.state: dict[str, Any] = {"status": "idle", "progress": 0}

    def subscribe(self) -> queue.Queue:
        q: queue.Queue = queue.Queue(self.length)
        with self.lock:
            self.queues.append(q)
        return q

    def send(self, **update: Any) -> None:
        with self.lock:
            self.state |= update
            alive = []
            for q in self.queues:
                try:
                    q.put_nowait(dict(self.state))
                    alive.append(q)
                except queue.Full:
                    pass
            self.queues = alive

    def step(self, name: str) -> None:
        n = STEPS.index(name) + 1
        self.send(status="running" if name != "done" else "done", step=name, progress=int(n / len(STEPS) * 100), at=time.time())


    def listen(self, q: queue.Queue, every: float = 15.0) -> Iterator[dict[str, Any]]:
        """The updates of a subscriber's queue, up to the last of a run. After every seconds of silence comes {"keepalive": True}, so that whoever passes them on can tell a quiet run from a lost one."""
        while True:
            try:
                update = q.get(timeout=every)
            except queue.Empty:
                yield {"keepalive": True}
                continue
            yield update
            if update.get("status") in ENDED:
                return


#: States after which a run sends nothing more.
ENDED = ("done", "failed", "cancelled")


class Busy(RuntimeError):
    """A run was asked for while one is going."""


class Cancelled(RuntimeError):
    """The run was cancelled."""


class Control:
    """One run at a time. Its Spark jobs carry a tag, by which cancel() ends them; between jobs the run ends at its next step."""

    def __init__(self, to: Broadcaster):
        self.to, self.going, self.tag, self.asked = to, threading.Lock(), None, threading.Event()

    @contextmanager
    def run(self, spark: SparkSession) -> Iterator[None]:
        """The span of a run: Busy if one is going. A run that raises is announced as failed, or as cancelled (and raises Cancelled)."""
        if not self.going.acquire(blocking=False):
            raise Busy("a run is going")
        self.asked.clear()
        self.tag = f"kinweave-{uuid.uuid4().hex}"
        spark.sparkContext.addJobTag(self.tag)
        try:
            yield
        except Exception as e:
            self.to.send(status="cancelled" if self.asked.is_set() else "failed", error=f"{type(e).__name__}: {e}"[:1000])
            if self.asked.is_set() and not isinstance(e, Cancelled):
                raise Cancelled("the run was cancelled") from e
            raise
        finally:
            spark.sparkContext.removeJobTag(self.tag)
            self.tag = None
            self.going.release()

    def step(self, name: str) -> None:
        if self.asked.is_set() and self.tag is not None:
            raise Cancelled("the run was cancelled")
        self.to.step(name)

    def cancel(self, spark: SparkSession) -> bool:
        """Ask the run that is going, if any, to end, and cancel its jobs; whether there was one."""
        tag = self.tag
        if tag is None:
            return False
        self.asked.set()
        spark.sparkContext.cancelJobsWithTag(tag)
        return True

    @staticmethod
    def stages(spark: SparkSession) -> list[dict[str, Any]]:
        """Tasks of the stages at work now: stage, name, tasks, done, active, failed."""
        tracker = spark.sparkContext.statusTracker()
        known = [tracker.getStageInfo(k) for k in tracker.getActiveStageIds()]
        return [{"stage": i.stageId, "name": i.name, "tasks": i.numTasks, "done": i.numCompletedTasks, "active": i.numActiveTasks, "failed": i.numFailedTasks} for i in known if i is not None]


class StreamProgress(StreamingQueryListener):
    """Every batch of every stream as an update."""

    def __init__(self, to: Broadcaster):
        self.to = to

    def onQueryStarted(self, event) -> None:
        self.to.send(status="running", query=str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.to.send(query=str(p.id), batch=p.batchId, rows=p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.to.send(status="done" if event.exception is None else "failed", query=str(event.id))


def setup_logging(folder: str | None = None, level: str = "INFO", console: bool = True) -> logging.Logger:
    """The package's log, to the console and to pipeline.log in folder."""
    log = logging.getLogger("kinweave")
    log.setLevel(level)
    for h in list(log.handlers):
        log.removeHandler(h)
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        log.addHandler(logging.FileHandler(Path(folder) / "pipeline.log", encoding="utf-8"))
    if console:
        log.addHandler(logging.StreamHandler())
    for h in log.handlers:
        h.setFormatter(logging.Formatter("%(asctime)s | %(levelname)-8s | %(message)s"))
    return log
