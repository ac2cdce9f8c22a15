"""Settings (S14): defaults, ranges and environment overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Checked on creation: shares lie in 0..1 and the three weights add up to about 1."""

    similarity_weight: float = 0.5
    decay_weight: float = 0.3
    importance_weight: float = 0.2
    archive_threshold: float = 0.2
    half_life_days: float = 60.0
    duplicate_threshold: float = 0.7
    max_age_days: int = 365
    top_k: int = 10

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if ("weight" in f.name or "threshold" in f.name) and not 0 <= value <= 1:
                raise ValueError(f"{f.name} must lie between 0 and 1")
            if f.name in ("half_life_days", "max_age_days", "top_k") and value <= 0:
                raise ValueError(f"{f.name} must be positive")
        if not 0.95 <= self.similarity_weight + self.decay_weight + self.importance_weight <= 1.05:
            raise ValueError("weights must add up to 1")


def load(values: dict[str, object] | None = None, environment: dict[str, str] | None = None, prefix: str = "TIDEMARK_") -> Settings:
    """Defaults, over them the given values, over them the environment."""
    env = os.environ if environment is None else environment
    chosen = dict(values or {})
    for f in fields(Settings):
        if raw := env.get(prefix + f.name.upper()):
            chosen[f.name] = type(f.default)(raw)
    unknown = chosen.keys() - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Settings(**chosen)
