"""Exact distinct users that merge, by bitmaps over numbered users.

Every user of an app has a number, given once and kept in a table. A rollup row then holds a bitmap of 2¹⁵ users
for one part of the numbers; bitmaps of any days, platforms or batches are merged by bitwise or and counted by
their bits, so counts are exact at any size, where sketches only estimate. A user is counted by number, hence a blank
user id is nobody.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspan.functions.text import not_blank

#: Independent ranges of numbers: new users of an app are numbered in so many tasks.
RANGES = 16
_RANGE_BITS = 40


def number_users(events: DataFrame, known: DataFrame | None = None, ranges: int = RANGES) -> DataFrame:
    """(app_id, user_id, number) of the users that are not ``known`` yet; numbers go on after the known ones.

    A user falls into a range by hash and is counted up inside it, so numbers are dense in each range and no task
    sees more than a range.
    """
    users = events.filter(not_blank("user_id")).select("app_id", "user_id").distinct()
    users = users.withColumn("_range", F.pmod(F.xxhash64("app_id", "user_id"), F.lit(ranges)))
    place = F.row_number().over(Window.partitionBy("app_id", "_range").orderBy("user_id"))
    taken = F.lit(0)
    if known is not None:
        users = users.join(known.select("app_id", "user_id"), ["app_id", "user_id"], "left_anti")
        last = known.groupBy("app_id", F.shiftright("number", _RANGE_BITS).alias("_range")).agg(
            F.max(F.col("number").bitwiseAND((1 << _RANGE_BITS) - 1)).alias("_taken"))
        users, taken = users.join(last, ["app_id", "_range"], "left"), F.coalesce("_taken", F.lit(0))
    return users.select(
        "app_id", "user_id", (F.shiftleft("_range", _RANGE_BITS) + taken + place).cast("bigint").alias("number"))


def user_bitmaps(events: DataFrame, numbers: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """app_id, ``keys``, ``part`` and ``users``: the bitmap of the numbers of a part that occur under the keys."""
    grain = events.filter(not_blank("user_id")).select(
        "app_id", "user_id", *[c.alias(n) for n, c in keys.items()]).distinct()
    return grain.join(numbers, ["app_id", "user_id"]).groupBy(
        "app_id", *keys, F.bitmap_bucket_number("number").alias("part")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("users"))


def merge_bitmaps(keys: list[str], *parts: DataFrame) -> DataFrame:
    """Rows of one app, keys and part merged; ``keys`` may be fewer than the rows have."""
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy("app_id", *keys, "part").agg(F.bitmap_or_agg("users").alias("users"))


def distinct_users(bitmaps: DataFrame, keys: list[str], name: str = "users") -> DataFrame:
    """Exact number of users per app and ``keys``."""
    return merge_bitmaps(keys, bitmaps).groupBy("app_id", *keys).agg(F.sum(F.bitmap_count("users")).alias(name))


def trailing_users(daily: DataFrame, days: int = 30) -> DataFrame:
    """Exact users of the trailing ``days`` days, on every day between the first and the last one of the app.

    A day's bitmaps are repeated for the days they count in; users are not touched.
    """
    merged = merge_bitmaps(["day"], daily)
    span = merged.groupBy("app_id").agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    spread = merged.join(span, "app_id").select(
        "app_id", "part", "users", F.explode(F.sequence("day", F.least(F.date_add("day", days - 1), F.col("_last")))).alias("day"))
    calendar = span.select("app_id", F.explode(F.sequence("_first", "_last")).alias("day"))
    return calendar.join(distinct_users(spread, ["day"], "active_users"), ["app_id", "day"], "left").select(
        "app_id", "day", F.coalesce("active_users", F.lit(0)).alias("active_users"))
