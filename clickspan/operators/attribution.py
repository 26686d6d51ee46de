"""Marketing attribution: first touch, last touch and linear.

A touch is an event with a non-empty ``utm_source``. No model joins touches with purchases: first
touch is one aggregate per user, the others are running scans over the user's touches and purchases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickspan.functions.scans import Running, in_chunks, running
from clickspan.functions.stats import safe_ratio
from clickspan.functions.text import not_blank, prop
from clickspan.functions.time import bucket
from clickspan.vocabulary import DEFAULT_VOCABULARY, Vocabulary

USER = ["app_id", "user_id"]
CHANNEL = ["source", "medium", "campaign"]
NO_TOUCH = "(none)"
CHUNK_US = 900 * 1_000_000


def _channel() -> list[Column]:
    return [
        prop("utm_source").alias("source"),
        prop("utm_medium").alias("medium"),
        prop("utm_campaign").alias("campaign"),
    ]


def _touched() -> Column:
    return prop("utm_source") != ""


def user_attribution(events: DataFrame) -> DataFrame:
    """First and last touch of every user."""
    touch = F.struct("event_time", "event_id", *_channel())
    touches = events.filter(_touched() & not_blank("user_id")).select(*USER, touch.alias("_touch"))
    return touches.groupBy(*USER).agg(
        F.min("_touch").alias("_first"), F.max("_touch").alias("_last")
    ).select(
        *USER,
        *[F.col(f"_first.{c}").alias(f"first_{c}") for c in CHANNEL],
        F.col("_first.event_time").alias("first_touch_at"),
        *[F.col(f"_last.{c}").alias(f"last_{c}") for c in CHANNEL],
        F.col("_last.event_time").alias("last_touch_at"),
    )


def first_touch(
    events: DataFrame, granularity: str = "day", vocabulary: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """Users, purchases and revenue by the user's first touch and its bucket."""
    paid = vocabulary.is_purchase()
    touch = F.struct("event_time", "event_id", *_channel())
    relevant = events.filter((_touched() | paid) & not_blank("user_id"))
    per_user = relevant.groupBy(*USER).agg(
        F.min(F.when(_touched(), touch)).alias("_touch"),
        F.count_if(paid).alias("_conversions"),
        F.sum(F.when(paid, vocabulary.revenue()).otherwise(F.lit(0.0))).alias("_revenue"),
    ).filter(F.col("_touch").isNotNull())
    points = per_user.groupBy(
        "app_id", bucket(F.col("_touch.event_time"), granularity).alias("bucket"),
        *[F.col(f"_touch.{c}").alias(c) for c in CHANNEL],
    ).agg(
        F.count("*").alias("users"), F.sum("_conversions").alias("conversions"),
        F.sum("_revenue").alias("revenue"),
    )
    return points.withColumn(
        "conversion_pct", 100.0 * safe_ratio(F.col("conversions"), F.col("users"))
    )


def _touches_and_purchases(events: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    paid = vocabulary.is_purchase()
    rows = events.filter((_touched() | paid) & not_blank("user_id")).select(
        *USER, "event_time", "event_id", _touched().alias("_touched"), paid.alias("_paid"),
        F.when(paid, vocabulary.revenue()).alias("_amount"), *_channel(),
    )
    return in_chunks(rows, F.unix_micros("event_time"), CHUNK_US)


def last_touch(
    events: DataFrame, granularity: str = "day", vocabulary: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """Purchases by the latest touch at or before each of them, bucketed by purchase time."""
    touch = F.when(F.col("_touched"), F.struct("_pos", "event_id", *CHANNEL))
    rows = _touches_and_purchases(events, vocabulary)
    seen = running(rows, USER, {"_last": Running("latest", touch)})
    purchases = seen.filter("_paid").select(
        *USER, bucket("event_time", granularity).alias("bucket"), "_amount",
        *[F.coalesce(F.col(f"_last.{c}"), F.lit(NO_TOUCH)).alias(c) for c in CHANNEL],
    )
    per_user = purchases.groupBy("app_id", "bucket", *CHANNEL, "user_id").agg(
        F.count("*").alias("_n"), F.sum("_amount").alias("_revenue")
    )
    return per_user.groupBy("app_id", "bucket", *CHANNEL).agg(
        F.count("*").alias("users"), F.sum("_n").alias("conversions"),
        F.sum("_revenue").alias("revenue"),
    )


def linear(
    events: DataFrame, granularity: str = "day", vocabulary: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """Every touch before a purchase gets an equal part of it, bucketed by touch time.

    With k touches up to a purchase, each gets 1/k. A touch's credit is therefore the sum of 1/k
    over the user's later purchases: a running count forwards, then a running sum backwards. The
    pairs of touches and purchases are never built.
    """
    rows = _touches_and_purchases(events, vocabulary)
    counted = running(rows, USER, {"_k": Running("sum", F.when(F.col("_touched"), F.lit(1)))})
    shared = F.col("_paid") & (F.col("_k") > 0)
    credited = running(
        counted, USER,
        {
            "_conversions": Running("sum", F.when(shared, 1.0 / F.col("_k"))),
            "_revenue": Running("sum", F.when(shared, F.col("_amount") / F.col("_k"))),
        },
        backwards=True,
    )
    orphan = F.col("_paid") & (F.col("_k") == 0)
    return credited.filter((F.col("_touched") & (F.col("_conversions") > 0)) | orphan).select(
        "app_id", bucket("event_time", granularity).alias("bucket"),
        *[F.when(orphan, F.lit(NO_TOUCH)).otherwise(F.col(c)).alias(c) for c in CHANNEL],
        F.when(orphan, F.lit(1.0)).otherwise(F.col("_conversions")).alias("_conversions"),
        F.when(orphan, F.col("_amount")).otherwise(F.col("_revenue")).alias("_revenue"),
    ).groupBy("app_id", "bucket", *CHANNEL).agg(
        F.sum("_conversions").alias("conversions"), F.sum("_revenue").alias("revenue")
    )


MODELS = {"first_touch": first_touch, "last_touch": last_touch, "linear": linear}


def attribution(
    events: DataFrame,
    model: str = "first_touch",
    granularity: str = "day",
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    if model not in MODELS:
        raise ValueError(f"model must be one of {sorted(MODELS)}")
    return MODELS[model](events, granularity, vocabulary)
