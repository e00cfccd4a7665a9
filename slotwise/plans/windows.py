"""Report windows relative to ``as_of``; nothing here reads the clock."""

from __future__ import annotations

from datetime import datetime, timedelta


def trailing(as_of: datetime, days: float = 0, hours: float = 0) -> tuple[datetime, datetime]:
    """``[as_of - length, as_of)``, cut to whole seconds as the reports state them."""
    end = as_of.replace(microsecond=0)
    return end - timedelta(days=days, hours=hours), end


def day_start(as_of: datetime) -> datetime:
    return datetime(as_of.year, as_of.month, as_of.day)
