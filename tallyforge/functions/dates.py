"""Ranges of local days as bounds in UTC; the clock and the time zone are given, so that a preset means the day of the query."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

#: Days of a preset that move with the clock.
PRESETS = {"today": 1, "7d": 7, "30d": 30}


def preset_days(preset: str, now: datetime, tz: str) -> tuple[str, str]:
    """The first and last local day of a preset; empty for ``all`` and ``custom``. now has a time zone."""
    if preset not in PRESETS:
        return "", ""
    last = now.astimezone(ZoneInfo(tz)).date()
    return (last - timedelta(days=PRESETS[preset] - 1)).isoformat(), last.isoformat()


def effective_days(preset: str, first: str, last: str, now: datetime, tz: str) -> tuple[str, str]:
    """The days that a filter means now: a moving preset's own, else those that it holds."""
    return preset_days(preset, now, tz) if preset in PRESETS else (first, last)


def _utc(day: str, at: time, tz: str) -> str:
    local = datetime.combine(date.fromisoformat(day), at, ZoneInfo(tz))
    return local.astimezone(ZoneInfo("UTC")).strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def day_bounds(first: str, last: str, tz: str) -> tuple[str | None, str | None]:
    """Inclusive bounds in UTC of local days, to the millisecond; an empty day is no bound.

    A day that starts in a gap of the clock starts after the gap, one that ends twice ends the first time.
    """
    return _utc(first, time.min, tz) if first else None, _utc(last, time(23, 59, 59, 999000), tz) if last else None


def window_days(first: str, last: str) -> int | None:
    """The days from the first to the last, both counted; null where one is missing."""
    return (date.fromisoformat(last) - date.fromisoformat(first)).days + 1 if first and last else None
