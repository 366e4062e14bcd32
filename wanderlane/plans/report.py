"""Reports of runs, one JSON file each: what was asked, of which graph, what came out, and where the time went."""

from __future__ import annotations

import json
import logging
import resource
import time
import uuid
from contextlib import contextmanager
from pathlib import Path

log = logging.getLogger("wanderlane")


class Report:
    """Collects a run's facts. asked: its settings; phases: seconds by name; counts: walks, index hits and the like."""

    def __init__(self, **asked):
        self.run, self.began = uuid.uuid4().hex[:12], time.time()
        self.asked, self.found = asked, {}
        self.phases: dict[str, float] = {}
        self.counts: dict[str, int] = {}

    @contextmanager
    def phase(self, name: str):
        at = time.perf_counter()
        try:
            yield
        finally:
            took = time.perf_counter() - at
            self.phases[name] = self.phases.get(name, 0.0) + took
            log.info("%s took %.3f s", name, took)

    def add(self, name: str, by: int) -> None:
        self.counts[name] = self.counts.get(name, 0) + by

    def facts(self) -> dict:
        return {
            "run": self.run, "began": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(self.began)), "seconds": round(time.time() - self.began, 3),
            "asked": self.asked, "found": self.found, "phases": self.phases, "counts": self.counts, "driver_peak_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024,
        }

    def save(self, folder: str) -> Path:
        path = Path(folder) / f"run-{self.run}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(self.facts(), indent=1, default=str))
        log.info("report in %s", path)
        return path
