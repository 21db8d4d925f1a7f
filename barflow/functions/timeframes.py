"""Timeframes by name, and the columns that coarser ones bring."""

from __future__ import annotations

import re

#: The timeframes that are known, in seconds.
SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
COARSE = re.compile(r"^tf\d+[mhd]_")


def seconds(timeframe: str) -> int:
    if timeframe not in SECONDS:
        raise ValueError(f"timeframe {timeframe!r} is not known; these are: {', '.join(SECONDS)}")
    return SECONDS[timeframe]


def prefix(timeframe: str) -> str:
    """What the columns of a timeframe begin with."""
    return f"tf{timeframe}"


def check_coarser(main: str, other: str) -> int:
    """How many main bars make one of the other timeframe; refuses one that is not coarser or does not fit."""
    own, more = seconds(main), seconds(other)
    if more <= own or more % own:
        raise ValueError(f"{other} bars cannot be made of {main} bars")
    return more // own


def coarse_columns(columns: list[str]) -> list[str]:
    """The columns of coarser timeframes, and their confluence."""
    return [c for c in columns if COARSE.match(c)] + [c for c in columns if c == "mtf_confluence"]
