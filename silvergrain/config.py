"""Settings with their ranges; what is out of range takes the nearest value or the default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


def clamped(value, low, high):
    return max(low, min(high, value))


def weight(text: str | float | None, default: float = 1.0) -> float:
    """A leg's weight, 0 to 10; anything else is the default."""
    try:
        value = float(text)
    except (TypeError, ValueError):
        return default
    return value if 0 <= value <= 10 else default


def rrf_k(text: str | int | None, default: int = 60) -> int:
    """The fusion constant, 1 or more; anything else is the default."""
    try:
        value = int(text)
    except (TypeError, ValueError):
        return default
    return value if value >= 1 else default


@dataclass(frozen=True)
class Settings:
    """All settings of searches and loops."""

    dense_weight: float = 1.0
    text_weight: float = 1.0
    fusion_k: int = 60
    graph_depth: int = 2
    hops: int = 3
    confident: float = 0.8
    rerank_threshold: float = 0.0
    batch: int = 500

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        put("dense_weight", weight(self.dense_weight))
        put("text_weight", weight(self.text_weight))
        put("fusion_k", rrf_k(self.fusion_k))
        put("graph_depth", clamped(int(self.graph_depth), 1, 3))
        put("hops", clamped(int(self.hops), 1, 5))
        put("confident", clamped(float(self.confident), 0.0, 1.0))
        put("rerank_threshold", clamped(float(self.rerank_threshold), 0.0, 1.0))
        put("batch", clamped(int(self.batch), 10, 5000))

    @classmethod
    def from_environment(cls, prefix: str = "SILVERGRAIN_") -> Settings:
        """Settings whose variables are set; unreadable numbers keep the default."""
        found = {}
        for f in fields(cls):
            text = os.environ.get(prefix + f.name.upper())
            if text is not None:
                try:
                    found[f.name] = float(text) if isinstance(f.default, float) else int(text)
                except ValueError:
                    continue
        return cls(**found)
