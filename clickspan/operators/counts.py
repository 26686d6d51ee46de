"""Event counts, breakdowns, the live view and user timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickspan.functions.text import PropertyFilter, all_filters, property_value
from clickspan.functions.time import TimeLike, bucket, scope, seconds, timestamp
from clickspan.operators.active import identity


def event_count(
    events: DataFrame,
    event_names: Sequence[str] | None = None,
    granularity: str = "day",
    group_by: Sequence[str] = (),
    filters: Sequence[PropertyFilter] = (),
) -> DataFrame:
    """Events per bucket, optionally per property; no names means all events."""
    if event_names:
        events = events.filter(F.col("event_name").isin(*event_names))
    if filters:
        events = events.filter(all_filters(filters))
    groups = [
        (F.col(g) if g in events.columns else property_value(g)).alias(g) for g in group_by
    ]
    return events.groupBy("app_id", bucket("event_time", granularity).alias("bucket"), *groups).agg(
        F.count("*").alias("event_count")
    )


def event_total(points: DataFrame) -> DataFrame:
    """Sum over the points of ``event_count``."""
    return points.groupBy("app_id").agg(F.sum("event_count").alias("total"))


def event_overlay(
    events: DataFrame, event_names: Sequence[str], granularity: str = "day"
) -> DataFrame:
    """Several events on one time axis, one column per event; missing stays null."""
    return (
        events.filter(F.col("event_name").isin(*event_names))
        .groupBy("app_id", bucket("event_time", granularity).alias("bucket"))
        .agg(*[
            F.nullif(F.count_if(F.col("event_name") == name), F.lit(0)).alias(name)
            for name in event_names
        ])
    )


def event_breakdown(
    events: DataFrame,
    event_name: str,
    property_name: str,
    granularity: str = "day",
    top_n: int = 20,
) -> DataFrame:
    """The most frequent property values per bucket with unique users and share of the bucket."""
    rows = events.filter(F.col("event_name") == event_name).select(
        "app_id", "user_id", "event_time", property_value(property_name).alias("property_value")
    ).filter(F.col("property_value") != "")
    rank = Window.partitionBy("app_id").orderBy(F.desc("_count"), "property_value")
    top = (
        rows.groupBy("app_id", "property_value").agg(F.count("*").alias("_count"))
        .withColumn("_rank", F.row_number().over(rank))
        .filter(F.col("_rank") <= top_n)
        .select("app_id", "property_value")
    )
    points = (
        rows.join(top, ["app_id", "property_value"])
        .groupBy("app_id", bucket("event_time", granularity).alias("bucket"), "property_value")
        .agg(F.count("*").alias("event_count"), F.countDistinct(identity(False)).alias("unique_users"))
    )
    listed = F.sum("event_count").over(Window.partitionBy("app_id", "bucket"))
    return points.withColumn("percentage", 100.0 * F.col("event_count") / listed)


def realtime(
    events: DataFrame, as_of: TimeLike, window: str | int = "5 minutes", top_n: int = 10
) -> DataFrame:
    """Event rate, active users and the most frequent events of the last minutes.

    Both parts come from one aggregate per (event, user), so the window is read once.
    """
    length = seconds(window)
    end = timestamp(as_of)
    start = F.timestamp_seconds(F.unix_seconds(end) - length)
    recent = scope(events, start=start, end=end)
    per_user = recent.groupBy("app_id", "event_name", "user_id").agg(F.count("*").alias("_n"))
    users = per_user.groupBy("app_id").agg(
        F.sum("_n").alias("_events"), F.countDistinct(identity(False)).alias("active_users")
    )
    rank = Window.partitionBy("app_id").orderBy(F.desc("event_count"), "event_name")
    top = (
        per_user.groupBy("app_id", "event_name").agg(F.sum("_n").alias("event_count"))
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= top_n)
    )
    return users.join(top, "app_id").select(
        "app_id", (F.col("_events") * 60.0 / length).alias("events_per_minute"), "active_users",
        "rank", "event_name", "event_count",
    )


def user_timeline(
    events: DataFrame, user_id: str | None = None, limit: int = 500
) -> DataFrame:
    """The ``limit`` newest events of one user, or of every user."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    columns = ["app_id", "user_id", "event_time", "event_id", "event_name", "platform",
               "country_code", "session_id"]
    if user_id is not None:
        return (
            events.filter(F.col("user_id") == user_id).select(*columns)
            .orderBy(F.desc("event_time"), F.desc("event_id")).limit(limit)
        )
    newest = Window.partitionBy("app_id", "user_id").orderBy(F.desc("event_time"), F.desc("event_id"))
    return (
        events.select(*columns).withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= limit)
    )
