"""Time bucketing (F1, F2) as native Column expressions.

All functions keep the input's timestamp flavour: batch tables carry
``timestamp_ntz`` (``ntz=True``), streams carry ``timestamp`` (session zone
UTC). ``date_trunc`` always returns ``timestamp``, so the result is cast back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rollup resolutions and their bucket widths.
RESOLUTIONS = {
    "15m": "15 minutes",
    "1h": "1 hour",
    "1d": "1 day",
    "1w": "1 week",
    "1mo": "1 month",
}

_TRUNC_UNITS = {"second", "minute", "hour", "day", "week", "month", "quarter", "year"}


def _as(col: Column, ntz: bool) -> Column:
    return col.cast("timestamp_ntz") if ntz else col.cast("timestamp")


def time_bucket(width: str, col: Column | str, ntz: bool = True) -> Column:
    """Start of the aligned bucket holding ``col``.

    ``width`` is a resolution key (``15m``), an interval (``15 minutes``,
    ``1 hour``) or a ``date_trunc`` unit. Weeks start on Monday (UTC), months
    on the first day; sub-hour widths must divide an hour, sub-day widths a
    day.
    """
    col = F.col(col) if isinstance(col, str) else col
    width = RESOLUTIONS.get(width, width)
    m = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day|week|month)s?\s*", width)
    if m is None:
        if width not in _TRUNC_UNITS:
            raise ValueError(f"unsupported bucket width: {width!r}")
        return _as(F.date_trunc(width, col), ntz)
    n, unit = int(m.group(1)), m.group(2)
    if n == 1:
        return _as(F.date_trunc(unit, col), ntz)
    if unit == "minute" and 60 % n == 0:
        base = F.date_trunc("hour", col)
        mins = F.floor(F.minute(col) / n) * n
        return _as(base + F.make_dt_interval(mins=mins.cast("int")), ntz)
    if unit == "hour" and 24 % n == 0:
        base = F.date_trunc("day", col)
        hours = F.floor(F.hour(col) / n) * n
        return _as(base + F.make_dt_interval(hours=hours.cast("int")), ntz)
    if unit in ("second", "minute"):
        return F.window(col, width).start
    raise ValueError(f"unsupported bucket width: {width!r}")


def bucket_width(width: str) -> Column:
    """Width of a fixed-size bucket as an interval literal column."""
    width = RESOLUTIONS.get(width, width)
    return F.expr(f"INTERVAL '{width}'")


def epoch_ms(col: Column | str) -> Column:
    """Epoch milliseconds (long) of a timestamp or timestamp_ntz column."""
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(F.unix_micros(col.cast("timestamp")) / 1000).cast("bigint")


def epoch_bucket_ms(ms: Column | str, width_ms: int = 300_000) -> Column:
    """``ms - ms % width`` with a non-negative remainder."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return ms - F.pmod(ms, F.lit(width_ms))
