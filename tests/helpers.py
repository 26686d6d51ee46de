"""Small builders for hand-made events."""

from __future__ import annotations

import datetime as dt

from clickspan.schema import EVENTS

DAY = dt.datetime(2024, 3, 3, tzinfo=dt.UTC)  # a Sunday


def at(*, days: float = 0, hours: float = 0, minutes: float = 0, seconds: float = 0) -> dt.datetime:
    return DAY + dt.timedelta(days=days, hours=hours, minutes=minutes, seconds=seconds)


def event(name="view", time=DAY, user="u", device="d", app="a", **fields):
    row = {
        "app_id": app, "event_id": None, "user_id": user, "device_id": device, "event_name": name,
        "event_time": time, "server_time": time, "session_id": "", "country_code": "US",
        "platform": "web", "app_version": "1", "os_family": "", "browser": "", "city": "",
        "revenue": None, "props": {}, "campaign_id": "", "install_source": "",
    }
    unknown = set(fields) - set(row)
    if unknown:
        raise ValueError(unknown)
    return {**row, **fields}


def events(spark, rows):
    names = [part.strip().split(" ")[0] for part in EVENTS.replace("map<string,string>", "map").split(", ")]
    filled = [
        {**row, "event_id": row["event_id"] if row["event_id"] is not None else f"e{i:05d}"}
        for i, row in enumerate(rows)
    ]
    return spark.createDataFrame([tuple(row[n] for n in names) for row in filled], EVENTS)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
