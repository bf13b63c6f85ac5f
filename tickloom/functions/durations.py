"""Durations such as "5 minutes"."""

from __future__ import annotations

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def seconds(duration: str) -> int:
    """Length of a duration; an unknown unit is an error, not a guess."""
    number, _, unit = duration.strip().partition(" ")
    unit = unit.strip().rstrip("s").lower()
    if not number.isdigit() or unit not in SECONDS:
        raise ValueError(f"not a duration: {duration!r}")
    return int(number) * SECONDS[unit]


def short(duration: str) -> str:
    """"5 minutes" as "5m"."""
    seconds(duration)
    number, _, unit = duration.strip().partition(" ")
    return number + unit.strip()[0].lower()
