"""Limits on model calls (E3, E4, Q27): plain state machines on the driver, with the clock given."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock


@dataclass
class Budget:
    """A token budget of which a share is held back for the answer."""

    total: int
    reserve: float = 0.25
    used: int = 0

    def allows(self, tokens: int, final: bool = False) -> bool:
        return self.used + tokens <= (self.total if final else self.total * (1 - self.reserve))

    def spend(self, tokens: int) -> None:
        self.used += tokens


@dataclass
class CircuitBreaker:
    """Open for a while after so many failures in a row."""

    clock: Callable[[], float]
    failures: int = 3
    seconds: float = 60.0
    count: int = 0
    opened: float | None = None

    def allows(self) -> bool:
        return self.opened is None or self.clock() - self.opened >= self.seconds

    def record(self, ok: bool) -> None:
        self.count = 0 if ok else self.count + 1
        self.opened = None if ok else self.clock() if self.count >= self.failures else self.opened


@dataclass
class CachedCalls:
    """Sub-calls, at most `concurrency` at a time, remembered for a time, with a limit on their number
    and, where per_key is set, on those under one key. Several threads may ask at once."""

    call: Callable[[str], str]
    clock: Callable[[], float]
    limit: int = 50
    concurrency: int = 5
    ttl: float = 300.0
    per_key: int | None = None
    made: int = 0
    memory: dict[str, tuple[float, str]] = field(default_factory=dict)
    by_key: Counter[str] = field(default_factory=Counter)
    lock: Lock = field(default_factory=Lock)

    def ask(self, prompt: str, key: str = "") -> str:
        with self.lock:
            held = self.memory.get(prompt)
            if held and self.clock() - held[0] < self.ttl:
                return held[1]
            if self.made >= self.limit or self.per_key is not None and self.by_key[key] >= self.per_key:
                raise RuntimeError("no sub-calls left")
            self.made += 1
            self.by_key[key] += 1
        answer = self.call(prompt)
        self.memory[prompt] = (self.clock(), answer)
        return answer

    def ask_all(self, prompts: list[str]) -> list[str]:
        with ThreadPoolExecutor(self.concurrency) as pool:
            return list(pool.map(self.ask, prompts))


def model_limits(name: str, table: list[tuple[str, int]], default: int = 8192) -> int:
    """Q27. The limit of the first entry whose name is part of the model's, in order."""
    return next((limit for part, limit in table if part in name), default)


# How a question is answered, by what a model's code is worth and how hard the question is.
STRATEGIES = {
    "none": {"simple": "direct", "moderate": "iterative", "complex": "iterative"},
    "limited": {"simple": "direct", "moderate": "iterative", "complex": "iterative"},
    "good": {"simple": "direct", "moderate": "iterative", "complex": "recursive"},
    "excellent": {"simple": "direct", "moderate": "recursive", "complex": "recursive"},
}


def strategy(code: str, complexity: str) -> str:
    """E4. How to retrieve: direct, iterative or recursive."""
    return STRATEGIES.get(code, STRATEGIES["excellent"])[complexity]


@dataclass
class Termination:
    """E4. When a loop of model answers ends: at a limit at once, else with enough signs."""

    needed: int = 2
    out_of_rounds: bool = False
    out_of_budget: bool = False

    def decide(self, signals: dict[str, bool]) -> tuple[bool, str, float]:
        """Whether to end, why, and how sure."""
        if self.out_of_rounds or self.out_of_budget:
            return True, "rounds" if self.out_of_rounds else "budget", 1.0
        n = sum(signals[name] for name in ("explicit_tag", "confidence_statement", "no_more_actions", "answer_valid"))
        return n >= self.needed, f"{n} signals", n / 4


def run_guarded(call: Callable[[], str], breaker: CircuitBreaker) -> str:
    """E4. A call behind a circuit breaker: refused while it is open; after its time one is tried."""
    if not breaker.allows():
        raise RuntimeError("too many recent failures")
    try:
        answer = call()
    except Exception:
        breaker.record(False)
        raise
    breaker.record(True)
    return answer
