"""Detection settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectionConfig:
    """Thresholds of the detectors; times in microseconds, 0 switches a detector off."""

    nplus1_threshold: int = 5
    nplus1_window_us: int = 1_000_000
    nplus1_cooldown_us: int = 10_000_000
    slow_us: int = 100_000

    def __post_init__(self) -> None:
        if min(self.nplus1_threshold, self.nplus1_cooldown_us, self.slow_us) < 0:
            raise ValueError("detection settings must not be negative")
        if self.nplus1_threshold > 0 and self.nplus1_window_us <= 0:
            raise ValueError("the N+1 window must be positive")


DEFAULTS = DetectionConfig()
