"""Named time ranges, counted back from an explicit moment."""

from __future__ import annotations

from datetime import datetime, timedelta

from telemill.fixed_values import TIME_RANGES


def since_for(name: str, as_of: datetime) -> datetime | None:
    """Start of a named range ending at ``as_of``; None for all time."""
    _, hours = TIME_RANGES[name]
    return None if hours is None else as_of - timedelta(hours=hours)


def range_label(name: str) -> str:
    return TIME_RANGES[name][0]
