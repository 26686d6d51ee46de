"""Rollup tables: build from events, merge, and answer queries without the events.

Distinct users are kept as HLL sketches, which can be merged; sums, counts, minima and maxima are
kept as plain partial columns. ``merge`` is associative, so partial tables may be combined in any
order and split.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickspan.functions.stats import safe_ratio
from clickspan.functions.text import not_blank, prop
from clickspan.functions.time import bucket
from clickspan.operators.counts import event_count
from clickspan.vocabulary import DEFAULT_VOCABULARY, Vocabulary

LOG_K = 14

_MERGE: dict[str, Callable[[str], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "sketch": lambda c: F.hll_union_agg(c),
}


@dataclass(frozen=True)
class Rollup:
    """Grain, partial measures (name -> merge kind) and the query that finishes them."""

    name: str
    keys: tuple[str, ...]
    measures: dict[str, str]
    from_events: Callable[[DataFrame, Vocabulary], DataFrame]
    finish: Callable[[DataFrame], DataFrame]

    def build(self, events: DataFrame, vocabulary: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
        return self.from_events(events, vocabulary)

    def merge(self, *parts: DataFrame) -> DataFrame:
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        return rows.groupBy(*self.keys).agg(
            *[_MERGE[kind](name).alias(name) for name, kind in self.measures.items()]
        )

    def query(self, *parts: DataFrame) -> DataFrame:
        return self.finish(self.merge(*parts))


def _sketch() -> Column:
    return F.hll_sketch_agg("user_id", F.lit(LOG_K))


def _estimate(column: str) -> Column:
    return F.hll_sketch_estimate(column)


def _amount(vocabulary: Vocabulary) -> Column:
    return F.when(vocabulary.is_purchase(), vocabulary.revenue()).otherwise(F.lit(0.0))


def _dau(events: DataFrame, v: Vocabulary) -> DataFrame:
    return events.filter(v.is_open()).groupBy(
        "app_id", F.to_date("event_time").alias("day"), "platform"
    ).agg(
        _sketch().alias("users"), F.sum(F.coalesce("revenue", F.lit(0.0))).alias("revenue"),
        F.count("*").alias("events"),
    )


def _hourly_counts(events: DataFrame, v: Vocabulary) -> DataFrame:
    return events.groupBy(
        "app_id", "event_name", bucket("event_time", "hour").alias("hour")
    ).agg(F.count("*").alias("event_count"))


def _daily_revenue(events: DataFrame, v: Vocabulary) -> DataFrame:
    return events.filter(v.is_purchase() & (v.revenue() > 0)).groupBy(
        "app_id", F.to_date("event_time").alias("day"), "platform"
    ).agg(
        F.sum(v.revenue()).alias("total_revenue"), F.count("*").alias("purchases"),
        _sketch().alias("payers"),
    )


def _hourly_revenue(events: DataFrame, v: Vocabulary) -> DataFrame:
    return events.filter(v.is_purchase()).groupBy(
        "app_id", bucket("event_time", "hour").alias("hour")
    ).agg(
        F.sum(v.revenue()).alias("total_revenue"), F.count("*").alias("tx_count"),
        _sketch().alias("payers"),
    )


CHANNEL = ("utm_source", "utm_medium", "utm_campaign")


def _attribution_daily(events: DataFrame, v: Vocabulary) -> DataFrame:
    return events.filter(prop("utm_source") != "").groupBy(
        "app_id", F.to_date("event_time").alias("day"), *[prop(c).alias(c) for c in CHANNEL]
    ).agg(
        _sketch().alias("users"), F.count_if(v.is_purchase()).alias("conversions"),
        F.sum(_amount(v)).alias("revenue"),
    )


def _user_lifetime(events: DataFrame, v: Vocabulary) -> DataFrame:
    """One row per user and session, so that sessions are counted exactly however parts are merged."""
    return events.filter(not_blank("user_id")).groupBy("app_id", "user_id", "session_id").agg(
        F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"),
        F.count("*").alias("total_events"),
        F.sum(_amount(v)).alias("total_revenue"),
        F.max(F.struct("event_time", "event_id", "country_code", "city")).alias("last_place"),
    )


def _finish(estimates: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    """Replace sketches with their estimates."""
    def apply(rows: DataFrame) -> DataFrame:
        return rows.select(*[
            _estimate(c).alias(estimates[c]) if c in estimates else F.col(c) for c in rows.columns
        ])

    return apply


def _finish_lifetime(rows: DataFrame) -> DataFrame:
    return rows.groupBy("app_id", "user_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("total_events").alias("total_events"), F.count_if(not_blank("session_id")).alias("total_sessions"),
        F.sum("total_revenue").alias("total_revenue"), F.max("last_place").alias("_place"),
    ).select(
        "app_id", "user_id", "first_seen", "last_seen", "total_events", "total_sessions", "total_revenue",
        F.col("_place.country_code").alias("last_country"), F.col("_place.city").alias("last_city"),
    )


ROLLUPS = {
    rollup.name: rollup
    for rollup in (
        Rollup("dau_rollup", ("app_id", "day", "platform"),
               {"users": "sketch", "revenue": "sum", "events": "sum"},
               _dau, _finish({"users": "dau"})),
        Rollup("hourly_counts", ("app_id", "event_name", "hour"), {"event_count": "sum"},
               _hourly_counts, _finish({})),
        Rollup("daily_revenue", ("app_id", "day", "platform"),
               {"total_revenue": "sum", "purchases": "sum", "payers": "sketch"},
               _daily_revenue, _finish({"payers": "paying_users"})),
        Rollup("hourly_revenue", ("app_id", "hour"),
               {"total_revenue": "sum", "tx_count": "sum", "payers": "sketch"},
               _hourly_revenue, _finish({"payers": "unique_payers"})),
        Rollup("attribution_daily", ("app_id", "day", *CHANNEL),
               {"users": "sketch", "conversions": "sum", "revenue": "sum"},
               _attribution_daily, _finish({"users": "unique_users"})),
        Rollup("user_lifetime", ("app_id", "user_id", "session_id"),
               {"first_seen": "min", "last_seen": "max", "total_events": "sum",
                "total_revenue": "sum", "last_place": "max"},
               _user_lifetime, _finish_lifetime),
    )
}


def daily_active_users(dau_rollup: DataFrame) -> DataFrame:
    """Daily users over all platforms from the rollup alone."""
    return dau_rollup.groupBy("app_id", "day").agg(
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("dau"), F.sum("events").alias("events")
    )


def trailing_active_users(dau_rollup: DataFrame, days: int = 30) -> DataFrame:
    """Distinct users of the trailing ``days`` days from daily sketches.

    One merged sketch per day is repeated for the days it counts in; users are never touched.
    """
    daily = dau_rollup.groupBy("app_id", "day").agg(F.hll_union_agg("users").alias("users"))
    span = daily.groupBy("app_id").agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    spread = daily.join(span, "app_id").select(
        "app_id", "users",
        F.explode(F.sequence("day", F.least(F.date_add("day", days - 1), F.col("_last")))).alias("day"),
    )
    counted = spread.groupBy("app_id", "day").agg(
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("active_users")
    )
    calendar = span.select("app_id", F.explode(F.sequence("_first", "_last")).alias("day"))
    return calendar.join(counted, ["app_id", "day"], "left").select(
        "app_id", "day", F.coalesce("active_users", F.lit(0)).alias("active_users")
    )


def counts_from_rollup(hourly_counts: DataFrame, granularity: str = "day") -> DataFrame:
    """``event_count`` answered from the hourly rollup."""
    return hourly_counts.groupBy("app_id", bucket("hour", granularity).alias("bucket")).agg(
        F.sum("event_count").alias("event_count")
    )


def revenue_from_rollup(hourly_revenue: DataFrame, granularity: str = "day") -> DataFrame:
    """Revenue per bucket answered from the hourly rollup."""
    rows = hourly_revenue.groupBy("app_id", bucket("hour", granularity).alias("bucket")).agg(
        F.sum("total_revenue").alias("total_revenue"), F.sum("tx_count").alias("transaction_count"),
        F.hll_sketch_estimate(F.hll_union_agg("payers")).alias("unique_payers"),
    )
    return rows.withColumn("arppu", safe_ratio(F.col("total_revenue"), F.col("unique_payers")))


def events_or_rollup(
    events: DataFrame,
    hourly_counts: DataFrame | None,
    granularity: str = "day",
    event_names: tuple[str, ...] = (),
    group_by: tuple[str, ...] = (),
) -> DataFrame:
    """Event counts from the rollup where its grain allows, else from the events."""
    usable = hourly_counts is not None and granularity != "minute" and set(group_by) <= {"event_name"}
    if not usable:
        return event_count(events, event_names, granularity, group_by)
    rows = hourly_counts
    if event_names:
        rows = rows.filter(F.col("event_name").isin(*event_names))
    return rows.groupBy("app_id", bucket("hour", granularity).alias("bucket"), *group_by).agg(
        F.sum("event_count").alias("event_count")
    )
