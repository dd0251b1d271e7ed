"""Window lengths as whole microseconds, for arithmetic on event-time panes."""

from __future__ import annotations

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def to_micros(text: str) -> int:
    """``"1 hour 30 minutes"`` -> microseconds. Only fixed-length units are meaningful for windows."""
    words = text.lower().split()
    if not words or len(words) % 2:
        raise ValueError(f"not an interval: {text!r}")
    total = 0
    for amount, unit in zip(words[::2], words[1::2]):
        seconds = _UNIT_SECONDS.get(unit.rstrip("s"))
        if seconds is None:
            raise ValueError(f"unit {unit!r} has no fixed length in {text!r}")
        total += int(amount) * seconds
    if total <= 0:
        raise ValueError(f"interval must be positive: {text!r}")
    return total * 1_000_000
