"""User profiles, features, segments and cohorts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspan.functions.text import PropertyFilter, all_filters, not_blank
from clickspan.functions.time import TimeLike, timestamp
from clickspan.vocabulary import DEFAULT_VOCABULARY, Vocabulary

USER = ["app_id", "user_id"]


def _latest(column: str) -> Column:
    return F.max(F.struct("event_time", "event_id", column))[column]


def user_profile(
    events: DataFrame,
    user_id: str | None = None,
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """First and last seen, totals and last place, for one user or all."""
    if user_id is not None:
        events = events.filter(F.col("user_id") == user_id)
    per_session = events.groupBy(*USER, "session_id").agg(
        F.min("event_time").alias("_first"), F.max("event_time").alias("_last"),
        F.count("*").alias("_events"),
        F.sum(F.when(vocabulary.is_purchase(), vocabulary.revenue()).otherwise(0.0)).alias("_revenue"),
        F.max(F.struct("event_time", "event_id", "country_code", "city")).alias("_place"),
    )
    return per_session.groupBy(*USER).agg(
        F.min("_first").alias("first_seen"), F.max("_last").alias("last_seen"),
        F.sum("_events").alias("total_events"),
        F.count_if(not_blank("session_id")).alias("total_sessions"),
        F.sum("_revenue").alias("total_revenue"),
        F.max("_place")["country_code"].alias("last_country"),
        F.max("_place")["city"].alias("last_city"),
    )


def user_top_events(
    events: DataFrame, user_id: str | None = None, top_n: int = 10
) -> DataFrame:
    """Most frequent events of one user or of every user."""
    if user_id is not None:
        events = events.filter(F.col("user_id") == user_id)
    rank = Window.partitionBy(*USER).orderBy(F.desc("event_count"), "event_name")
    return (
        events.groupBy(*USER, "event_name").agg(F.count("*").alias("event_count"))
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= top_n)
    )


def user_features(events: DataFrame, as_of: TimeLike) -> DataFrame:
    """Per-user columns that cohort filters can use."""
    day = F.to_date("event_time")
    per_day = events.filter(F.col("event_time") <= timestamp(as_of)).groupBy(
        *USER, day.alias("_day")
    ).agg(
        F.count("*").alias("_n"), F.min("event_time").alias("_first"),
        F.max("event_time").alias("_last"),
        F.max(F.struct("event_time", "event_id", "platform")).alias("_platform"),
    )
    today = F.to_date(timestamp(as_of))
    return per_day.groupBy(*USER).agg(
        F.sum("_n").alias("event_count"),
        F.count_if(F.col("_day") > F.date_sub(today, 7)).alias("days_active_last_7"),
        F.min("_first").alias("first_seen"), F.max("_last").alias("last_seen"),
        F.max("_platform")["platform"].alias("platform"),
    )


def segment_users(
    events: DataFrame,
    has_events: Sequence[str] = (),
    filters: Sequence[PropertyFilter] = (),
) -> DataFrame:
    """Users who did every listed event and have at least one event passing the filters.

    One aggregate per user replaces a semi-join per listed event.
    """
    needed = [F.max(F.col("event_name") == name).alias(f"_has{i}") for i, name in enumerate(has_events)]
    flags = events.groupBy(*USER).agg(*needed, F.max(all_filters(filters)).alias("_match"))
    keep = F.col("_match")
    for i in range(len(has_events)):
        keep = keep & F.col(f"_has{i}")
    return flags.filter(keep).select(*USER)


def segment_count(
    events: DataFrame,
    has_events: Sequence[str] = (),
    filters: Sequence[PropertyFilter] = (),
) -> DataFrame:
    """Number of users in the segment."""
    return segment_users(events, has_events, filters).groupBy("app_id").agg(
        F.count("*").alias("matched_users")
    )


@dataclass(frozen=True)
class Cohort:
    """A stored cohort: a SQL predicate over event (or user feature) columns."""

    id: str
    app_id: str
    filter_sql: str
    user_count: int = 0


def stored_cohorts(definitions: DataFrame, most: int = 10_000) -> list[Cohort]:
    """Cohorts of a definition table, which people write; more than ``most`` rows are refused."""
    rows = definitions.select("id", "app_id", "filter_sql", "user_count").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} cohort definitions")
    return [Cohort(r["id"], r["app_id"], r["filter_sql"], r["user_count"] or 0) for r in rows]


@contextmanager
def _lenient(spark: SparkSession) -> Iterator[None]:
    """Expressions resolved inside give null for a value that does not convert, instead of an error."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def cohort_recompute(
    rows: DataFrame, cohorts: Sequence[Cohort] | DataFrame, as_of: TimeLike
) -> DataFrame:
    """Exact distinct users of every cohort, all in one pass over ``rows``.

    A predicate that does not resolve keeps its old count and an empty computation time. A row for which
    a predicate cannot be computed (a text that is no number, say) is not a member; it harms neither the
    other rows nor the other cohorts.
    """
    if isinstance(cohorts, DataFrame):
        cohorts = stored_cohorts(cohorts)
    spark = rows.sparkSession
    usable, broken = [], []
    with _lenient(spark):
        for cohort in cohorts:
            try:
                rows.filter(F.expr(cohort.filter_sql)).schema
                usable.append(cohort)
            except (AnalysisException, ParseException):
                broken.append(cohort)
        members = rows.select("app_id", "user_id", *[
            ((F.col("app_id") == c.app_id) & F.coalesce(F.expr(c.filter_sql), F.lit(False))).alias(f"_c{i}")
            for i, c in enumerate(usable)
        ])
    layout = "cohort_id string, app_id string, user_count bigint"
    kept = spark.createDataFrame([(c.id, c.app_id, c.user_count) for c in broken], layout).withColumn(
        "last_computed_at", F.lit(None).cast("timestamp")
    )
    if not usable:
        return kept
    per_user = members.groupBy("app_id", "user_id").agg(*[F.max(f"_c{i}").alias(f"_c{i}") for i in range(len(usable))])
    counts = per_user.agg(*[F.count_if(f"_c{i}").alias(f"_c{i}") for i in range(len(usable))])
    listed = F.array(*[
        F.struct(F.lit(c.id).alias("cohort_id"), F.lit(c.app_id).alias("app_id"),
                 F.col(f"_c{i}").alias("user_count"))
        for i, c in enumerate(usable)
    ])
    return counts.select(F.inline(listed)).withColumn(
        "last_computed_at", timestamp(as_of)
    ).unionByName(kept)
