"""Time buckets, ranges and tenant scoping."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRANULARITIES = ("minute", "hour", "day", "week", "month")
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}

TimeLike = str | dt.datetime


def seconds(interval: str | int) -> int:
    """``'30 minutes'`` -> 1800; integers are already seconds."""
    if isinstance(interval, int):
        return interval
    match = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day|week)s?\s*", interval)
    if match is None:
        raise ValueError(f"cannot read interval {interval!r}")
    return int(match.group(1)) * _UNITS[match.group(2)]


def timestamp(value: TimeLike | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def bucket(col: str | Column, granularity: str) -> Column:
    """Start of the bucket; weeks start on Sunday."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}")
    col = F.col(col) if isinstance(col, str) else col
    if granularity == "week":
        return F.date_sub(F.to_date(col), F.dayofweek(col) - 1).cast("timestamp")
    return F.date_trunc(granularity, col)


def scope(
    events: DataFrame,
    app_id: str | None = None,
    start: TimeLike | None = None,
    end: TimeLike | None = None,
    time_col: str = "event_time",
) -> DataFrame:
    """Tenant filter plus inclusive time range.

    Partition predicates on ``event_date`` are added next to the time ones because Catalyst does
    not derive them; without them a range query would list every partition.
    """
    if isinstance(start, (str, dt.datetime)) and isinstance(end, (str, dt.datetime)):
        if _parse(start) > _parse(end):
            raise ValueError("start must not be after end")
    by_date = "event_date" in events.columns and time_col == "event_time"
    if app_id is not None:
        events = events.filter(F.col("app_id") == app_id)
    if start is not None:
        events = events.filter(F.col(time_col) >= timestamp(start))
        if by_date:
            events = events.filter(F.col("event_date") >= F.to_date(timestamp(start)))
    if end is not None:
        events = events.filter(F.col(time_col) <= timestamp(end))
        if by_date:
            events = events.filter(F.col("event_date") <= F.to_date(timestamp(end)))
    return events


def _parse(value: str | dt.datetime) -> dt.datetime:
    parsed = dt.datetime.fromisoformat(value) if isinstance(value, str) else value
    return parsed if parsed.tzinfo else parsed.replace(tzinfo=dt.UTC)
