"""What runs beside Spark: phases and their times, work with retries, a progress log, and a report of what is installed."""

from __future__ import annotations

import importlib.util
import os
import shutil
import sys
import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field


def worker_count(requested: int | str | None, items: int) -> int:
    """As many as asked for (auto or none: one for each core), no more than there are items, and one at least."""
    if isinstance(requested, str):
        if requested != "auto" and (not requested.isdigit() or int(requested) < 1):
            raise ValueError(f"workers must be auto or a positive number, not {requested!r}")
        requested = None if requested == "auto" else int(requested)
    return max(1, min(items, requested or os.cpu_count() or 1))


@dataclass
class Outcome:
    """Results by item, errors of items that failed to the end, attempts by item, and an event for each round."""

    results: dict = field(default_factory=dict)
    errors: dict = field(default_factory=dict)
    attempts: dict = field(default_factory=dict)
    events: list[dict] = field(default_factory=list)


def with_retries(items: Iterable, work: Callable, workers: int | str | None = None, attempts: int = 3, phase: str = "work") -> Outcome:
    """Runs work over hashable items in threads of the driver, for work that Spark doesn't do. What fails is tried again, each time by half as many workers, at last by one after another."""
    out, left = Outcome(), list(items)
    count = worker_count(workers, len(left))
    for attempt in range(1, attempts + 1):
        if not left:
            break
        failed: dict = {}

        def one(item):
            try:
                return item, work(item), None
            except Exception as error:  # any failure of an item is its outcome
                return item, None, error

        with ThreadPoolExecutor(count) as pool:
            for item, result, error in pool.map(one, left):
                out.attempts[item] = attempt
                if error is None:
                    out.results[item] = result
                else:
                    failed[item] = error
        out.events.append({"phase": phase, "attempt": attempt, "workers": count, "items": len(left), "failed": len(failed)})
        out.errors = failed
        left, count = list(failed), max(1, count // 2)
    return out


class Phases:
    """Seconds by phase; one that runs again adds up."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self.clock, self.totals, self.begun = clock, {}, clock()

    @contextmanager
    def run(self, name: str):
        began = self.clock()
        try:
            yield
        finally:
            self.totals[name] = self.totals.get(name, 0.0) + self.clock() - began

    def whole(self) -> float:
        return self.clock() - self.begun


class ProgressLog:
    """Tab-separated lines of a run (time, worker, phase, frame, source, fields), appended under a lock."""

    HEAD = ("time", "worker", "phase", "frame", "source", "fields")

    def __init__(self, path: str, clock: Callable[[], float] = time.time):
        self.path, self.clock, self.lock = path, clock, threading.Lock()

    def reset(self) -> None:
        with self.lock, open(self.path, "w", encoding="utf-8") as out:
            out.write("\t".join(self.HEAD) + "\n")

    def add(self, phase: str, frame: object = "", source: str = "", fields: Iterable[str] = ()) -> None:
        cells = (f"{self.clock():.3f}", threading.current_thread().name, phase, str(frame), source, ",".join(fields))
        with self.lock, open(self.path, "a", encoding="utf-8") as out:
            out.write("\t".join(c.replace("\t", " ").replace("\n", " ") for c in cells) + "\n")


def doctor() -> dict[str, str]:
    """What is there: versions of Python and Spark, a JVM, and the optional programs and packages."""
    import pyspark

    found = {"python": sys.version.split()[0], "pyspark": pyspark.__version__, "java": shutil.which("java") or "missing"}
    found |= {name: shutil.which(name) or "missing (optional)" for name in ("ffmpeg", "ffprobe", "tesseract")}
    return found | {name: "installed" if importlib.util.find_spec(name) else "missing" for name in ("pyarrow", "pandas", "numpy")}
