"""When maintenance is due (M3): hourly, nightly, weekly and monthly jobs, with the clock given."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta


def next_run(job: str, after: datetime) -> datetime:
    """The first time behind `after` at which a job runs: decay every hour, consolidate every night at
    3, summarize on Sundays at 4, reindex on the first of a month at 5."""
    if job == "decay":
        return after + timedelta(hours=1)
    hour = {"consolidate": 3, "summarize": 4, "reindex": 5}[job]
    at = after.replace(hour=hour, minute=0, second=0, microsecond=0)
    fits = {"consolidate": lambda t: True, "summarize": lambda t: t.weekday() == 6, "reindex": lambda t: t.day == 1}[job]
    while at <= after or not fits(at):
        at += timedelta(days=1)
    return at


@dataclass
class Schedule:
    """Jobs by name, run when their time has come. What a job raises is kept beside its results, and
    the others still run."""

    jobs: dict[str, Callable[[], object]]
    started: datetime
    results: list[tuple[str, datetime, object]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.due = {name: next_run(name, self.started) for name in self.jobs}

    def tick(self, now: datetime) -> list[str]:
        """Runs every job whose time has come, once, and returns their names."""
        ready = [name for name in self.jobs if self.due[name] <= now]
        for name in ready:
            try:
                self.results.append((name, now, self.jobs[name]()))
            except Exception as error:
                self.results.append((name, now, error))
            self.due[name] = next_run(name, now)
        return ready
