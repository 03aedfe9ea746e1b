"""The parameters of the two forecasting protocols, hourly and daily. The defaults are fixed values of the protocols."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta


@dataclass(frozen=True)
class Hourly:
    season: int = 168
    horizon: int = 168
    hours: tuple[int, ...] = (0, 9, 13)
    spacing_days: int = 7
    min_train_days: int = 56
    min_pairs: int = 24
    min_obs: int = 3
    min_series_days: int = 56
    buckets: dict[str, tuple[int, int]] = field(default_factory=lambda: {"1h": (1, 1), "same_day": (2, 24), "2-3d": (25, 72), "4-7d": (73, 168)})


@dataclass(frozen=True)
class Daily:
    season: int = 7
    horizon: int = 112
    spacing_days: int = 7
    min_train_days: int = 56
    min_pairs: int = 28
    min_hours: int = 4
    own_start: date = date(2026, 3, 6)
    buckets: dict[str, tuple[int, int]] = field(default_factory=lambda: {"1-7d": (1, 7), "8-14d": (8, 14), "15-28d": (15, 28), "29-56d": (29, 56), "57-112d": (57, 112)})


@dataclass(frozen=True)
class Grid:
    """Origins at first + k weeks (k below weeks), each at the hours given. Few numbers, whatever the panel's size: rows find
    their origins by arithmetic, so that no range join is needed."""

    first: datetime
    weeks: int
    hours: tuple[int, ...] = (0,)
    spacing_days: int = 7

    @property
    def count(self) -> int:
        return self.weeks * len(self.hours)

    def times(self) -> list[datetime]:
        return [self.first + timedelta(days=self.spacing_days * k, hours=h) for k in range(self.weeks) for h in self.hours]
