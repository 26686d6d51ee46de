"""User paths: what follows a start event inside a session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickspan.functions.text import PropertyFilter, all_filters, not_blank
from clickspan.functions.time import seconds
from clickspan.operators.sessions import ordered_parts

SESSION = ["app_id", "session_id"]


def path_lists(
    events: DataFrame,
    start_event: str = "session_start",
    max_steps: int = 5,
    end_event: str | None = None,
    filters: Sequence[PropertyFilter] = (),
    chunk: str | int = "15 minutes",
) -> DataFrame:
    """One path per session that holds the start event, from its first occurrence.

    Only the first events of each (session, chunk), and the first ones after the start event there,
    can be part of the path. A session of any size is thus reduced to a few rows per chunk before
    its rows meet.
    """
    events = events.filter(not_blank("session_id"))
    if filters:
        events = events.filter(all_filters(filters))
    within = Window.partitionBy("_chunk", *reversed(SESSION)).orderBy("event_time", "event_id")
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    started = F.max((F.col("event_name") == start_event).cast("int")).over(so_far)
    candidates = (
        events.select(
            *SESSION, "event_time", "event_id", "event_name",
            F.floor(F.unix_seconds("event_time") / seconds(chunk)).alias("_chunk"),
        )
        .withColumn("_row", F.row_number().over(within))
        .withColumn("_started", started)
        .withColumn("_after", F.sum("_started").over(so_far))
        .filter((F.col("_row") <= max_steps) | ((F.col("_started") == 1) & (F.col("_after") <= max_steps)))
    )
    names = F.transform(
        F.sort_array(F.collect_list(F.struct("event_time", "event_id", "event_name"))),
        lambda e: e["event_name"],
    )
    sessions = candidates.groupBy(*SESSION).agg(names.alias("_names")).filter(
        F.array_contains("_names", start_event)
    )
    path = F.slice("_names", F.array_position("_names", start_event), max_steps)
    sessions = sessions.select(*SESSION, path.alias("path"))
    if end_event is not None:
        tail = F.array_position(F.slice("path", 2, max_steps), end_event)
        sessions = sessions.withColumn("_end", tail).filter(F.col("_end") > 0).select(
            *SESSION, F.slice("path", F.lit(1), (F.col("_end") + 1).cast("int")).alias("path")
        )
    return sessions


def path_counts(lists: DataFrame) -> DataFrame:
    """Sessions per distinct path."""
    return lists.groupBy("app_id", "path").agg(F.count("*").alias("session_count"))


def top_paths(counts: DataFrame, top_n: int = 10) -> DataFrame:
    """Most frequent paths with their share of all matching sessions."""
    rank = Window.partitionBy("app_id").orderBy(F.desc("session_count"), "path")
    totals = counts.groupBy("app_id").agg(F.sum("session_count").alias("total_sessions"))
    return (
        counts.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top_n)
        .join(totals, "app_id")
        .withColumn("pct", 100.0 * F.col("session_count") / F.col("total_sessions"))
    )


def paths(
    events: DataFrame,
    start_event: str = "session_start",
    max_steps: int = 5,
    top_n: int = 10,
    end_event: str | None = None,
    filters: Sequence[PropertyFilter] = (),
) -> DataFrame:
    """The most frequent paths from ``start_event``."""
    return top_paths(path_counts(path_lists(events, start_event, max_steps, end_event, filters)), top_n)


def path_nodes(
    events: DataFrame,
    start_event: str = "session_start",
    max_steps: int = 5,
    top_n: int = 10,
) -> DataFrame:
    """One row per step of each top path.

    The drop-off of a step is the share of sessions with the same steps so far that do not go on to
    the next step of this path; the last step has none.
    """
    counts = path_counts(path_lists(events, start_event, max_steps))
    reached = counts.select(
        "app_id", "session_count",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("path")),
                              lambda i: F.slice("path", F.lit(1), i))).alias("prefix"),
    ).groupBy("app_id", "prefix").agg(F.sum("session_count").alias("reached"))
    steps = top_paths(counts, top_n).select(
        "app_id", "rank", "path", "session_count", "pct",
        F.posexplode("path").alias("_pos", "event_name"),
    ).withColumn("step", F.col("_pos") + 1).withColumn(
        "prefix", F.slice("path", F.lit(1), F.col("step"))
    )
    per_path = Window.partitionBy("app_id", "rank").orderBy("step")
    following = F.lead("reached").over(per_path)
    return steps.join(reached, ["app_id", "prefix"]).select(
        "app_id", "rank", "step", "event_name", "session_count", "pct",
        F.coalesce(1.0 - following / F.col("reached"), F.lit(0.0)).alias("drop_off"),
    )


def session_paths(events: DataFrame, part_size: int = 1000) -> DataFrame:
    """Full ordered event names of every session, in parts of at most ``part_size``."""
    known = events.filter(not_blank("session_id"))
    return ordered_parts(known, F.col("event_name"), "path", part_size)
