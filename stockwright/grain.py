"""Day or week: every constant that depends on the length of a period."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grain:
    """Lengths are in periods unless named otherwise."""

    name: str
    days: int
    periods_per_year: int
    horizon: int
    n_folds: int
    mase_lag: int
    naive_season: int
    model_season: int
    ma_window: int
    lead_time: int
    n_series_sample: int | None
    lags: tuple[int, ...]
    windows: tuple[int, ...]
    price_lag: int
    history: int

    def before(self, day: date, n: int) -> date:
        return day - timedelta(days=self.days * n)

    def periods_in(self, start: date, end: date) -> int:
        """Periods from start to end, both included."""
        return (end - start).days // self.days + 1

    def shift(self, day: Column, n: Column | int) -> Column:
        """The period start n periods after (before, if negative) a day."""
        steps = F.lit(n) if isinstance(n, int) else n
        return F.date_add(day, (steps * self.days).cast("int"))

    def steps(self, start: Column, end: Column) -> Column:
        return (F.datediff(end, start) / self.days).cast("int")

    def period_rate(self, annual: float) -> float:
        return annual / self.periods_per_year

    def annual_rate(self, per_period: float) -> float:
        return per_period * self.periods_per_year


DAILY = Grain("day", 1, 365, 28, 4, 7, 7, 7, 28, 7, 400, (1, 7, 14, 28), (7, 28), 7, 90)
WEEKLY = Grain("week", 7, 52, 13, 4, 1, 52, 1, 4, 2, None, (1, 2, 4, 13), (4, 13), 4, 30)
TRACKS = {"a": DAILY, "b": WEEKLY}


def for_track(track: str) -> Grain:
    if track not in TRACKS:
        raise ValueError(f"track must be one of {sorted(TRACKS)}, got {track!r}")
    return TRACKS[track]
