"""Tunables of the analytics, with their usual values; pass another instance to change them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Scoring:
    """Times in milliseconds."""

    interval_ms: int = 60_000
    context_ms: int = 10_000  # each interval sees this much on either side
    bin_ms: int = 125  # pulses this near are alternatives
    mode_bin_ms: int = 20  # bins of the interval histogram
    reach_ms: int = 10_000  # how far a pulse looks for others of its train
    burst_bins: int = 6
    burst_least: int = 20
    burst_rate: float = 20.0  # pulses a second in a bin
    burst_seconds: float = 10.0
    interval_low: float = 0.33  # bounds of the expected interval, as shares of the nominal one
    interval_high: float = 1.67


@dataclass(frozen=True)
class Positioning:
    window_s: float = 30.0
    step_s: float = 60.0
    coarse_m: float = 5.0
    fine_m: float = 1.0
    near_best: float = 0.9


@dataclass(frozen=True)
class Tracking:
    window: int = 500
    overlap: int = 100
    hop_cost: float = 0.0


@dataclass(frozen=True)
class Detector:
    """Times in samples."""

    pulse_width: int = 160
    save_width: int = 480
    rise: float = 1.1
    time_constant: float = 1000.0
    confirmation: int = 80
