"""Plans run in the background, and what became of them."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from ..config import ChatConfig
from .chat import generate

LOG_LINES = 200


def is_inside(path: str, root: str) -> bool:
    """Whether a path, links followed, lies in a folder."""
    try:
        Path(path).resolve().relative_to(Path(root).resolve())
    except (ValueError, OSError):
        return False
    return True


@dataclass
class Job:
    job_id: str
    state: str = "queued"
    progress: int = 0
    logs: list[str] = field(default_factory=list)
    result: dict | None = None
    error_message: str | None = None
    created_at: float = field(default_factory=time.time)
    completed_at: float | None = None

    def tell(self, message: str, percent: int) -> None:
        self.progress = percent
        self.logs = [*self.logs, f"[{time.strftime('%H:%M:%S')}] {message}"][-LOG_LINES:]


class Jobs:
    """Jobs of one session, each in a thread of its own; Spark's own scheduler shares the cluster among them."""

    def __init__(self, spark: SparkSession, out_root: str):
        self.spark, self.out_root = spark, out_root
        self._jobs: dict[str, Job] = {}
        self._lock = threading.Lock()

    def create(self, root: str, out: str, options: dict | None = None, plan: Callable[..., dict] = generate) -> str:
        """Start a job; outputs outside the root, and unknown options, are refused here."""
        if not root:
            raise ValueError("a job needs a tree")
        if not is_inside(out, self.out_root):
            raise ValueError(f"{out} is not below {self.out_root}")
        config, job = ChatConfig(**(options or {})), Job(uuid.uuid4().hex)
        with self._lock:
            self._jobs[job.job_id] = job
        threading.Thread(target=self._run, args=(job, plan, root, out, config), daemon=True).start()
        return job.job_id

    def _run(self, job: Job, plan: Callable[..., dict], root: str, out: str, config: ChatConfig) -> None:
        job.state = "running"
        self.spark.addTag(f"job-{job.job_id}")
        try:
            job.result = plan(self.spark, root, out, config, progress=job.tell)
            job.state, job.progress = "done", 100
        except Exception as e:  # a job's failure is its own
            job.state, job.error_message = "error", str(e)
            job.tell(f"Error: {e}", job.progress)
        finally:
            job.completed_at = time.time()

    def get(self, job_id: str) -> Job | None:
        with self._lock:
            return self._jobs.get(job_id)

    def list(self) -> list[Job]:
        with self._lock:
            return list(self._jobs.values())

    def result(self, job_id: str) -> dict:
        job = self.get(job_id)
        if job is None:
            raise KeyError(job_id)
        if job.state != "done":
            raise ValueError(f"the job is {job.state}")
        return job.result or {}
