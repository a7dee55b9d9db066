"""Tunables with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

HOUR, DAY = 3600.0, 86400.0


@dataclass(frozen=True)
class Tier:
    name: str
    seconds: float
    meters: float


@dataclass(frozen=True)
class Config:
    # Thresholds that decide results.
    radius_default: float = 300.0
    radius_min: float = 50.0
    radius_max: float = 50_000.0
    journey_km: float = 80.0
    journey_hours: float = 8.0
    trip_gap_days: float = 3.0
    trip_min_rows: int = 6
    trip_min_hours: float = 6.0
    away_km: float = 150.0
    stop_km: float = 25.0
    weekly_min_rows: int = 30
    min_support: float = 0.05
    suggestion_meters: float = 200.0
    suggestion_hours: float = 12.0
    weight_spatial: float = 0.5
    weight_temporal: float = 0.3
    weight_folder: float = 0.2
    suggestion_score: float = 0.15
    stable_jaccard: float = 0.5
    stable_shift: float = 100.0
    page_size: int = 120
    page_max: int = 500
    tiers: tuple[Tier, ...] = field(default=(Tier("Event", 2 * HOUR, 1e3), Tier("Trip", 3 * DAY, 5e4), Tier("Month", 12 * DAY, 4e5), Tier("Year", 90 * DAY, 3e6)))
    steps: int = 24
    default_step: int = 8


DEFAULTS = Config()
