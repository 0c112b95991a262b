"""Event-time windows: fixed, sliding, session, and calendar ones in a time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(amount: int, unit: str) -> str:
    return f"{amount} {unit}"


def assigned(kind: str, ts: Column, size: int = 1, unit: str = "second", period: int | None = None, offset: int = 0, gap: int | None = None, zone: str = "UTC", start: str = "1970-01-01") -> Column:
    """The grouping column of a window strategy: window structs, or the start of the calendar period."""
    if kind == "fixed":
        return F.window(ts, duration(size, unit), duration(size, unit), duration(offset, unit))
    if kind == "sliding":
        return F.window(ts, duration(size, unit), duration(period or size, unit), duration(offset, unit))
    if kind == "session":
        return F.session_window(ts, duration(gap or size, unit))
    if kind != "calendar":
        raise ValueError(f"unknown window {kind!r}")
    local = F.from_utc_timestamp(ts, zone)
    origin = F.lit(start).cast("date")
    if unit == "day":
        days = F.floor(F.datediff(local.cast("date"), origin) / size) * size
        return F.date_add(origin, days.cast("int"))
    if unit == "week":
        days = F.floor(F.datediff(local.cast("date"), origin) / (7 * size)) * (7 * size)
        return F.date_add(origin, days.cast("int"))
    months = (F.year(local) - F.year(origin)) * 12 + F.month(local) - F.month(origin)
    step = size * (12 if unit == "year" else 1)
    return F.add_months(F.trunc(origin, "month"), (F.floor(months / step) * step).cast("int"))
