"""A registry of named functions with parameters, and their jobs."""

from __future__ import annotations

import itertools
import time
from collections import Counter
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Parameter:
    """A parameter: its type, whether it must be given, its default and the values it may take."""

    kind: type
    required: bool = False
    default: object = None
    choices: tuple[object, ...] = ()


@dataclass
class Tool:
    name: str
    category: str
    run: Callable[..., object]
    parameters: dict[str, Parameter] = field(default_factory=dict)

    def checked(self, given: dict[str, object]) -> dict[str, object]:
        """The arguments with defaults; errors name the parameter."""
        if unknown := given.keys() - self.parameters.keys():
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        out = {}
        for name, p in self.parameters.items():
            value = given.get(name, p.default)
            if value is None:
                if p.required:
                    raise ValueError(f"{name} is required")
                continue
            if not isinstance(value, p.kind) or p.choices and value not in p.choices:
                raise ValueError(f"{name} is not valid")
            out[name] = value
        return out

    def schema(self) -> dict[str, object]:
        """JSON schema of the parameters."""
        kinds = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}
        return {"type": "object", "properties": {n: {"type": kinds[p.kind]} | ({"enum": list(p.choices)} if p.choices else {}) for n, p in self.parameters.items()}, "required": [n for n, p in self.parameters.items() if p.required]}


class Registry:
    """Tools by name. Jobs run on driver threads; a Spark job group per job makes them cancellable."""

    def __init__(self, spark: object | None = None, workers: int = 4) -> None:
        self.tools: dict[str, Tool] = {}
        self.jobs: dict[int, tuple[str, float, Future]] = {}
        self.spark, self.pool, self.numbers = spark, ThreadPoolExecutor(workers), itertools.count(1)

    def register(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ValueError(f"{tool.name} is registered already")
        self.tools[tool.name] = tool

    def execute(self, name: str, **given: object) -> object:
        tool = self.tools[name]
        return tool.run(**tool.checked(given))

    def submit(self, name: str, **given: object) -> int:
        tool, number = self.tools[name], next(self.numbers)
        arguments = tool.checked(given)

        def work() -> object:
            if self.spark is not None:
                self.spark.sparkContext.setJobGroup(f"job-{number}", name, interruptOnCancel=True)
            return tool.run(**arguments)

        self.jobs[number] = (name, time.time(), self.pool.submit(work))
        return number

    def status(self, number: int) -> str:
        job = self.jobs[number][2]
        if job.cancelled():
            return "cancelled"
        if not job.done():
            return "running"
        return "failed" if job.exception() else "completed"

    def cancel(self, number: int) -> None:
        if not self.jobs[number][2].cancel() and self.spark is not None:
            self.spark.sparkContext.cancelJobGroup(f"job-{number}")

    def recent(self, limit: int = 10) -> list[tuple[int, str, str]]:
        """T10. The latest jobs with name and status."""
        return [(n, self.jobs[n][0], self.status(n)) for n in sorted(self.jobs, reverse=True)[:limit]]

    def forget(self, older_than: float) -> None:
        """Drops finished jobs of that age in seconds."""
        for n in [n for n, (_, at, job) in self.jobs.items() if job.done() and time.time() - at > older_than]:
            del self.jobs[n]

    def by_category(self) -> dict[str, int]:
        """A18."""
        return dict(Counter(t.category for t in self.tools.values()))
