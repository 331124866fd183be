"""Durations and ages."""

from __future__ import annotations

import re

_UNITS = {"d": 86400, "h": 3600, "m": 60, "s": 1, "": 1}


def parse_duration(text: str) -> int:
    """Seconds of Nd, Nh, Nm, Ns or N; anything else, negative ones too, is an error."""
    m = re.fullmatch(r"\s*(\d+)\s*([dhms]?)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * _UNITS[m[2]]


def humanize(age: int) -> str:
    for size, name in ((86400, "d"), (3600, "h"), (60, "m")):
        if age >= size:
            return f"{age // size}{name} ago"
    return f"{max(age, 0)}s ago"


def backoff(attempt: int, base: float = 0.5, cap: float = 30.0, retry_after: float | None = None) -> float:
    """Exponential delay before a retry, capped; a server's own wish wins up to the cap."""
    return min(cap, retry_after if retry_after is not None else base * 2**attempt)
