"""Parameters of a study; every interval is in seconds, so the same plans run on millisecond and on day-granular data."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

MINUTE, HOUR, DAY = 60, 3600, 86400


@dataclass(frozen=True)
class Params:
    window: int = 10 * MINUTE
    lookback: int = 60 * MINUTE
    settle: int = 60 * MINUTE
    max_pre_age: int = 30 * MINUTE
    drift_lead: int = 10 * MINUTE
    min_move: float = 0.03
    fit_min_events: int = 5
    control_gap: int = 60 * MINUTE
    placebo_games: int = 3
    season_start: date = date(2026, 9, 8)
    season_zone: str = "America/New_York"
    game_length: int = 3 * HOUR + 30 * MINUTE
    after: int = 8 * DAY
    #: (name, from, to) seconds after the moment, half open; the last takes in its end.
    buckets: tuple[tuple[str, float, float], ...] = (("0_10s", 0, 10), ("10_30s", 10, 30), ("30_60s", 30, 60), ("1_5m", 60, 300), ("5_10m", 300, 600.001))


#: The same study on tables whose times are whole days.
DAILY = Params(
    window=10 * DAY, lookback=60 * DAY, settle=60 * DAY, max_pre_age=30 * DAY, drift_lead=10 * DAY, control_gap=60 * DAY, game_length=90 * DAY, after=8 * DAY, season_start=date(1995, 1, 3), season_zone="UTC",
    buckets=(("0_1d", 0, DAY), ("1_3d", DAY, 3 * DAY), ("3_10d", 3 * DAY, 10 * DAY + 0.001)),
)
