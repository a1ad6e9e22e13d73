"""Thresholds, weights and limits of detection."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Thresholds:
    image_distance: int = 5
    frame_distance: int = 5
    duration_share: float = 0.02
    duplicate: float = 0.85
    similar: float = 0.60


@dataclass(frozen=True)
class Limits:
    comparisons_per_bucket: int = 10_000
    bucket_size: int = 256


@dataclass(frozen=True)
class Weights:
    """What each kind of evidence adds to a pair's score."""

    checksum: float = 0.50
    hash: float = 0.30
    metadata: float = 0.10
    name: float = 0.05
    capture_time: float = 0.03
    policy_bonus: float = 0.05

    def __post_init__(self):
        if min(vars(self).values()) < 0 or self.checksum > 1:
            raise ValueError("weights must not be negative, and checksum not over 1")

    def with_overrides(self, **changes: float) -> Weights:
        return replace(self, **changes)

    @property
    def is_valid(self) -> bool:
        return sum(vars(self).values()) <= 2.0

    @property
    def normalized(self) -> Weights:
        """All but checksum scaled so that the weights sum to 1."""
        rest = {k: v for k, v in vars(self).items() if k != "checksum"}
        total = sum(rest.values())
        return self if total <= 0 else replace(self, **{k: v * (1 - self.checksum) / total for k, v in rest.items()})
