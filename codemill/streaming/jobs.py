"""A queue of jobs for one driver: handlers by type, priorities, cancelling, waiting, and its events."""

from __future__ import annotations

import itertools
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Job:
    id: str
    type: str
    payload: dict
    priority: int = 0
    status: str = "pending"
    done: int = 0
    total: int = 0
    error: str | None = None
    result: object = None
    order: int = 0
    cancelled: threading.Event = field(default_factory=threading.Event)
    ended: threading.Event = field(default_factory=threading.Event)


class JobQueue:
    """Runs jobs in threads, each of which may use Spark (a fair pool of its own). Equal priorities run in order of arrival. At
    most one job runs for each key of a payload (its project), as only one may write its table."""

    def __init__(self, workers: int = 2, on_event: Callable[[str, Job], None] = lambda kind, job: None, every: float = 1.0) -> None:
        self.workers, self.on_event, self.every = workers, on_event, every
        self.handlers: dict[str, Callable[[Job, Callable[[int, int], None]], object]] = {}
        self.jobs: dict[str, Job] = {}
        self._lock, self._count, self._running = threading.RLock(), itertools.count(1), set()

    def register(self, kind: str, handler: Callable[[Job, Callable[[int, int], None]], object]) -> None:
        self.handlers[kind] = handler

    def enqueue(self, kind: str, payload: dict, priority: int = 0) -> Job:
        if kind not in self.handlers:
            raise ValueError(f"no handler for job type {kind}; known: {', '.join(sorted(self.handlers))}")
        with self._lock:
            n = next(self._count)
            job = self.jobs[f"job-{n}"] = Job(f"job-{n}", kind, payload, priority, order=n)
        self.on_event("job-queued", job)
        self._pump()
        return job

    def busy(self, project: str) -> bool:
        with self._lock:
            return any(j.status == "running" and j.payload.get("project") == project for j in self.jobs.values())

    def _pump(self) -> None:
        with self._lock:
            while len(self._running) < self.workers:
                held = {self.jobs[i].payload.get("project") for i in self._running}
                ready = [j for j in self.jobs.values() if j.status == "pending" and (j.payload.get("project") is None or j.payload.get("project") not in held)]
                if not ready:
                    return
                job = min(ready, key=lambda j: (-j.priority, j.order))
                job.status = "running"
                self._running.add(job.id)
                threading.Thread(target=self._run, args=(job,), daemon=True).start()

    def _run(self, job: Job) -> None:
        self.on_event("job-started", job)
        last = [0.0]

        def progress(done: int, total: int) -> None:
            if job.cancelled.is_set():
                raise InterruptedError("cancelled")
            job.done, job.total = done, total
            if time.monotonic() - last[0] >= self.every:
                last[0] = time.monotonic()
                self.on_event("job-progress", job)

        try:
            progress(0, 0)
            job.result = self.handlers[job.type](job, progress)
            job.status = "completed"
        except InterruptedError:
            job.status = "cancelled"
        except Exception as e:  # noqa: BLE001 - a handler's failure is its job's
            job.status, job.error = "failed", str(e)
        with self._lock:
            self._running.discard(job.id)
        job.ended.set()
        self.on_event(f"job-{job.status}", job)
        self._pump()

    def cancel(self, job_id: str) -> bool:
        with self._lock:
            job = self.jobs.get(job_id)
            if job is None or job.status not in ("pending", "running"):
                return False
            job.cancelled.set()
            if job.status == "pending":
                job.status = "cancelled"
                job.ended.set()
        return True

    def wait(self, job_id: str, seconds: float = 120.0) -> Job:
        """The job when it has ended or the time is up, whichever is first."""
        self.jobs[job_id].ended.wait(seconds)
        return self.jobs[job_id]


class EventRing:
    """The last events with growing ids; a cursor beyond the last id begins anew."""

    def __init__(self, capacity: int = 512) -> None:
        self.capacity, self._rows, self._next, self._lock = capacity, [], 1, threading.Lock()

    def add(self, kind: str, **fields: object) -> int:
        with self._lock:
            self._rows.append({"id": self._next, "type": kind, "ts": time.time(), **fields})
            self._rows = self._rows[-self.capacity :]
            self._next += 1
            return self._next - 1

    def since(self, cursor: int = 0) -> tuple[list[dict], int]:
        with self._lock:
            last = self._next - 1
            cursor = 0 if last < cursor else cursor
            return [r for r in self._rows if r["id"] > cursor], last
