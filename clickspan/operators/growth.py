"""Retention, revenue and lifetime value.

Everything starts from one row per (user, day), built with map-side partial aggregation, so a hot
user is one small row per day before any per-user step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickspan.functions.stats import safe_ratio
from clickspan.functions.text import not_blank, prop
from clickspan.functions.time import bucket
from clickspan.vocabulary import DEFAULT_VOCABULARY, Vocabulary

USER = ["app_id", "user_id"]
RETENTION_DAYS = (1, 3, 7, 14, 30)
LTV_DAYS = (1, 7, 14, 30, 60, 90)


def _check_days(days: Sequence[int]) -> None:
    if not days or any(not 1 <= d <= 365 for d in days):
        raise ValueError("days must lie between 1 and 365")


def retention_events(
    events: DataFrame, vocabulary: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """Distinct (user, install day, active day) with the day number; day 0 is the install day."""
    user_days = (
        events.filter((vocabulary.is_install() | vocabulary.is_open()) & not_blank("user_id"))
        .groupBy(*USER, F.to_date("event_time").alias("return_date"))
        .agg(F.max(vocabulary.is_install()).alias("_install"))
    )
    first = F.min(F.when(F.col("_install"), F.col("return_date"))).over(Window.partitionBy(*USER))
    return (
        user_days.withColumn("install_date", first)
        .filter(F.col("return_date") >= F.col("install_date"))
        .select(*USER, "install_date", "return_date",
                F.datediff("return_date", "install_date").alias("day_n"))
    )


def retention(
    events: DataFrame,
    day_ns: Sequence[int] = RETENTION_DAYS,
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Per install-day cohort, the share of users active exactly N days later."""
    return retention_from_events(retention_events(events, vocabulary), day_ns)


def retention_from_events(
    returns: DataFrame, day_ns: Sequence[int] = RETENTION_DAYS
) -> DataFrame:
    """``retention`` on the stored retention rows."""
    _check_days(day_ns)
    cohorts = returns.groupBy("app_id", "install_date").agg(
        F.count_if(F.col("day_n") == 0).alias("cohort_size"),
        *[F.count_if(F.col("day_n") == n).alias(f"_d{n}") for n in day_ns],
    )
    rows = F.array(*[
        F.struct(F.lit(n).alias("day_n"), F.col(f"_d{n}").alias("retained"),
                 safe_ratio(F.col(f"_d{n}"), F.col("cohort_size")).alias("rate"))
        for n in day_ns
    ])
    return cohorts.select("app_id", "install_date", "cohort_size", F.inline(rows))


def retention_summary(cohorts: DataFrame) -> DataFrame:
    """Mean rate over cohorts per day number."""
    return cohorts.groupBy("app_id", "day_n").agg(
        F.avg("rate").alias("mean_rate"), F.count("*").alias("cohorts")
    )


def revenue(
    events: DataFrame,
    granularity: str = "day",
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Revenue, transactions and payers per bucket, per paying user and per active user."""
    paid = vocabulary.is_purchase()
    per_user = events.groupBy(
        "app_id", bucket("event_time", granularity).alias("bucket"), "user_id"
    ).agg(
        F.sum(F.when(paid, vocabulary.revenue()).otherwise(F.lit(0.0))).alias("_revenue"),
        F.count_if(paid).alias("_tx"),
    )
    points = per_user.groupBy("app_id", "bucket").agg(
        F.sum("_revenue").alias("total_revenue"),
        F.sum("_tx").alias("transaction_count"),
        F.count_if(F.col("_tx") > 0).alias("unique_payers"),
        F.count("*").alias("active_users"),
    )
    return points.withColumn(
        "arppu", safe_ratio(F.col("total_revenue"), F.col("unique_payers"))
    ).withColumn("arpu", safe_ratio(F.col("total_revenue"), F.col("active_users")))


def revenue_total(points: DataFrame) -> DataFrame:
    """Sum of all points."""
    return points.groupBy("app_id").agg(F.sum("total_revenue").alias("total_ltv"))


def revenue_by_currency(
    events: DataFrame,
    granularity: str = "day",
    currency_prop: str = "currency",
    default_currency: str = "USD",
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Revenue per bucket and currency of the purchase; amounts are not converted."""
    code = F.when(prop(currency_prop) != "", prop(currency_prop)).otherwise(F.lit(default_currency))
    per_user = events.filter(vocabulary.is_purchase()).groupBy(
        "app_id", bucket("event_time", granularity).alias("bucket"), code.alias("currency"), "user_id"
    ).agg(F.sum(vocabulary.revenue()).alias("_revenue"), F.count("*").alias("_tx"))
    return per_user.groupBy("app_id", "bucket", "currency").agg(
        F.sum("_revenue").alias("total_revenue"),
        F.sum("_tx").alias("transaction_count"),
        F.count("*").alias("unique_payers"),
    )


def _purchase_days(events: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    paid = vocabulary.is_purchase()
    user_days = events.filter((vocabulary.is_install() | paid) & not_blank("user_id")).groupBy(
        *USER, F.to_date("event_time").alias("_day")
    ).agg(
        F.max(vocabulary.is_install()).alias("_install"),
        F.sum(F.when(paid, vocabulary.revenue()).otherwise(F.lit(0.0))).alias("_revenue"),
        F.count_if(paid).alias("_tx"),
    )
    first = F.min(F.when(F.col("_install"), F.col("_day"))).over(Window.partitionBy(*USER))
    return (
        user_days.withColumn("cohort_date", first)
        .filter(F.col("cohort_date").isNotNull())
        .withColumn("day_n", F.datediff("_day", "cohort_date"))
    )


def ltv_per_day(
    events: DataFrame, vocabulary: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """Average purchase amount by install cohort and exact day after install."""
    return _purchase_days(events, vocabulary).filter(F.col("_tx") > 0).groupBy(
        "app_id", "cohort_date", "day_n"
    ).agg(
        F.count("*").alias("users"),
        (F.sum("_revenue") / F.sum("_tx")).alias("avg_ltv"),
    )


def ltv_cumulative(
    events: DataFrame,
    days: Sequence[int] = LTV_DAYS,
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Revenue up to day N per user of the install cohort, paying or not."""
    _check_days(days)
    cohorts = _purchase_days(events, vocabulary).groupBy("app_id", "cohort_date").agg(
        F.count_if((F.col("day_n") == 0) & F.col("_install")).alias("users"),
        *[
            F.coalesce(
                F.sum(F.when(F.col("day_n").between(0, n), F.col("_revenue"))), F.lit(0.0)
            ).alias(f"_d{n}")
            for n in days
        ],
    )
    rows = F.array(*[
        F.struct(F.lit(n).alias("day_n"), F.col(f"_d{n}").alias("revenue"),
                 safe_ratio(F.col(f"_d{n}"), F.col("users")).alias("ltv"))
        for n in days
    ])
    return cohorts.select("app_id", "cohort_date", "users", F.inline(rows))
