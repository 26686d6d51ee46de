"""Active users and headline numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspan.functions.text import not_blank
from clickspan.functions.time import TimeLike, bucket, seconds, timestamp
from clickspan.operators.sessions import session_summaries
from clickspan.vocabulary import DEFAULT_VOCABULARY, Vocabulary


def identity(device_fallback: bool) -> Column:
    """User id, null where the user is unknown; with the fallback, the device id there.

    So a blank user is nobody wherever users are counted, in exact counts, sketches and bitmaps alike.
    """
    known = F.when(not_blank("user_id"), F.col("user_id"))
    return known.otherwise(F.col("device_id")) if device_fallback else known


def active_users(
    events: DataFrame,
    granularity: str = "day",
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
    device_fallback: bool = False,
    approximate: bool = False,
    rsd: float = 0.02,
) -> DataFrame:
    """Distinct users with an open event per bucket."""
    who = identity(device_fallback)
    counted = F.approx_count_distinct(who, rsd) if approximate else F.countDistinct(who)
    return (
        events.filter(vocabulary.is_open())
        .groupBy("app_id", bucket("event_time", granularity).alias("bucket"))
        .agg(counted.alias("active_users"))
    )


def active_users_kpis(series: DataFrame) -> DataFrame:
    """Latest value, change against seven periods earlier, peak and rounded mean of a series."""
    by_time = Window.partitionBy("app_id").orderBy("bucket")
    lagged = series.withColumn("_past", F.lag("active_users", 7).over(by_time))
    last = F.max_by(F.struct("active_users", "_past"), "bucket")
    return lagged.groupBy("app_id").agg(
        last.alias("_last"), F.max("active_users").alias("peak"),
        F.round(F.avg("active_users")).cast("bigint").alias("average"),
    ).select(
        "app_id", F.col("_last.active_users").alias("current"),
        F.when(F.col("_last._past") > 0,
               100.0 * (F.col("_last.active_users") - F.col("_last._past")) / F.col("_last._past")
               ).alias("change_pct"),
        "peak", "average",
    )


def dau_wau_mau(events: DataFrame, device_fallback: bool = False) -> DataFrame:
    """Distinct users per day and in the trailing 7 and 30 days.

    A user active on day d counts for the days d .. d + w - 1, cut at the user's next active day so
    that no day counts a user twice. Each (user, day) therefore only adds +1 at the start and -1
    after the end of an interval, and a running sum over days gives the distinct counts: no row is
    multiplied by the window length.
    """
    user_days = events.select(
        "app_id", identity(device_fallback).alias("_user"), F.to_date("event_time").alias("_day")
    ).filter("_user is not null").distinct()
    following = F.lead("_day").over(Window.partitionBy("app_id", "_user").orderBy("_day"))
    windows = {"dau": 1, "wau": 7, "mau": 30}
    spans = user_days.withColumn("_next", following)

    def stop(days: int) -> Column:
        return F.least(F.date_add("_day", days), F.col("_next"))

    changes = spans.select(
        "app_id", "_day", F.inline(F.array(
            F.struct(F.col("_day").alias("day"), *[F.lit(1).alias(n) for n in windows]),
            *[
                F.struct(stop(days).alias("day"),
                         *[F.lit(-1 if n == name else 0).alias(n) for n in windows])
                for name, days in windows.items()
            ],
        ))
    )
    daily = changes.groupBy("app_id", "day").agg(*[F.sum(n).alias(n) for n in windows])
    last_day = user_days.groupBy("app_id").agg(
        F.min("_day").alias("_from"), F.max("_day").alias("_to")
    )
    calendar = last_day.select(
        "app_id", F.explode(F.sequence("_from", "_to")).alias("day")
    )
    upto = Window.partitionBy("app_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    filled = calendar.join(daily, ["app_id", "day"], "left")
    return filled.select(
        "app_id", "day", *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(n) for n in windows]
    )


def dashboard_kpis(
    events: DataFrame,
    as_of: TimeLike,
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
    gap: str | int = "30 minutes",
) -> DataFrame:
    """Events, active users, sessions and revenue of the day, with the change against yesterday.

    A session belongs to the day it starts on. Whether an event starts one depends only on the ``gap``
    before it, so sessions are built from one gap before yesterday on, and those that seem to start in that
    margin are left out.
    """
    today = F.to_date(timestamp(as_of))
    yesterday = F.date_sub(today, 1)
    day = F.to_date("event_time")
    margin = yesterday.cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds(gap)))
    near = events.filter((F.col("event_time") >= margin) & (day <= today))
    if "event_date" in events.columns:
        near = near.filter(F.col("event_date").between(F.to_date(margin), today))
    recent = near.filter(day >= yesterday)
    money = F.when(vocabulary.is_purchase(), vocabulary.revenue()).otherwise(F.lit(0.0))
    per_user = recent.groupBy("app_id", "user_id", day.alias("_day")).agg(
        F.count("*").alias("_events"), F.sum(money).alias("_revenue"),
        F.max(vocabulary.is_open() & not_blank("user_id")).alias("_open"),
    )
    is_today = F.col("_day") == today
    numbers = per_user.groupBy("app_id").agg(
        *[
            column
            for suffix, mine in (("", is_today), ("_before", ~is_today))
            for column in (
                F.coalesce(F.sum(F.when(mine, F.col("_events"))), F.lit(0)).alias(f"events{suffix}"),
                F.count_if(mine & F.col("_open")).alias(f"dau{suffix}"),
                F.coalesce(F.sum(F.when(mine, F.col("_revenue"))), F.lit(0.0)).alias(f"revenue{suffix}"),
            )
        ]
    )
    started = F.to_date("started_at")
    sessions = session_summaries(near, gap, vocabulary=vocabulary).groupBy("app_id").agg(
        F.count_if(started == today).alias("sessions"),
        F.count_if(started == yesterday).alias("sessions_before"),
    )

    def change(name: str) -> Column:
        before = F.col(f"{name}_before")
        return F.when(before > 0, 100.0 * (F.col(name) - before) / before).alias(f"{name}_change_pct")

    names = ["events", "dau", "sessions", "revenue"]
    return numbers.join(sessions, "app_id", "left").select(
        "app_id", *names, *[change(name) for name in names]
    )
