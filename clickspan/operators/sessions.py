"""Sessions: an inactivity gap strictly longer than ``gap`` starts a new one.

The work is cut into (time chunk, key) groups, the chunk first because a number sorts fastest. A
device that holds a third of all rows is spread
over its chunks; only one small row per chunk or partial session is ordered per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspan.functions.stats import safe_ratio
from clickspan.functions.text import not_blank, prop
from clickspan.functions.time import seconds
from clickspan.schema import EVENT_COLUMNS
from clickspan.vocabulary import DEFAULT_VOCABULARY, Vocabulary

SESSION_KEYS = ("app_id", "device_id")

# Histogram buckets: upper bound in seconds (inclusive) and the label that results must carry (fixed values).
DURATION_BUCKETS = [
    (30, "0-30s"),
    (60, "30-60s"),
    (120, "1-2 min"),
    (300, "2-5 min"),
    (600, "5-10 min"),
    (1200, "10-20 min"),
    (1800, "20-30 min"),
    (None, ">30 min"),
]


def session_id(keys: Sequence[str], start_us: Column) -> Column:
    return F.concat_ws("-", *keys, F.floor(start_us / 1000).cast("bigint"))


def sessionize(
    events: DataFrame,
    gap: str | int = "30 minutes",
    keys: Sequence[str] = SESSION_KEYS,
    time_col: str = "event_time",
    chunk: str | int = "15 minutes",
) -> DataFrame:
    """Attach ``session_id`` and ``session_start`` to every event."""
    keys = list(keys)
    gap_us, chunk_us = seconds(gap) * 1_000_000, seconds(chunk) * 1_000_000
    placed = events.drop("session_id").withColumn("_t", F.unix_micros(time_col)).withColumn(
        "_chunk", F.floor(F.col("_t") / chunk_us)
    )
    within = Window.partitionBy("_chunk", *reversed(keys)).orderBy("_t")
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_break = F.col("_t") - F.lag("_t").over(within) > gap_us

    def with_breaks(df: DataFrame) -> DataFrame:
        return df.withColumn("_break", F.when(is_break, F.col("_t")))

    local = with_breaks(placed).withColumn("_start", F.max("_break").over(so_far))
    chunks = with_breaks(placed.select(*keys, "_chunk", "_t")).groupBy(*keys, "_chunk").agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.max("_break").alias("_break")
    )
    per_key = Window.partitionBy(*keys).orderBy("_chunk")
    previous_last = F.lag("_last").over(per_key)
    carried = (
        chunks
        .withColumn("_new", previous_last.isNull() | (F.col("_first") - previous_last > gap_us))
        .withColumn("_anchor", F.coalesce("_break", F.when(F.col("_new"), F.col("_first"))))
        .select(
            *keys, "_chunk",
            F.when(F.col("_new"), F.col("_first")).otherwise(
                F.max("_anchor").over(per_key.rowsBetween(Window.unboundedPreceding, -1))
            ).alias("_carry"),
        )
    )
    start = F.coalesce("_start", "_carry")
    return (
        local.join(carried, [*keys, "_chunk"], "left")
        .withColumn("session_id", session_id(keys, start))
        .withColumn("session_start", F.timestamp_micros(start))
        .select(*[c for c in events.columns if c != "session_id"], "session_id", "session_start")
    )


def session_summaries(
    events: DataFrame,
    gap: str | int = "30 minutes",
    keys: Sequence[str] = SESSION_KEYS,
    time_col: str = "event_time",
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
    chunk: str | int = "15 minutes",
) -> DataFrame:
    """One row per session; it ends at its own last event.

    Events are reduced to partial sessions inside each (key, chunk) and only those are merged per
    key, so two shuffles carry events once and partial sessions once.
    """
    keys = list(keys)
    gap_us, chunk_us = seconds(gap) * 1_000_000, seconds(chunk) * 1_000_000
    screen = F.when(vocabulary.is_screen() & (prop("screen_name") != ""), prop("screen_name"))
    firsts = [c for c in ("user_id", "device_id", "country_code", "platform") if c not in keys]
    slim = events.select(
        *keys, "event_id", *firsts,
        F.unix_micros(time_col).alias("_t"), screen.alias("_screen"),
    ).withColumn("_chunk", F.floor(F.col("_t") / chunk_us))

    within = Window.partitionBy("_chunk", *reversed(keys)).orderBy("_t")
    is_break = F.col("_t") - F.lag("_t").over(within) > gap_us

    def stamped(col: str) -> Column:
        return F.when(not_blank(col), F.struct("_t", "event_id", F.col(col).alias("value")))

    partial = (
        slim.withColumn("_break", F.when(is_break, F.col("_t")))
        .withColumn("_piece", F.max("_break").over(
            within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*keys, "_chunk", "_piece")
        .agg(
            F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.count("*").alias("_n"),
            *[F.min(stamped(c)).alias(f"_{c}") for c in firsts],
            F.min(stamped("_screen")).alias("_entry"), F.max(stamped("_screen")).alias("_exit"),
            F.count("_screen").alias("_screens"),
        )
    )
    per_key = Window.partitionBy(*keys).orderBy("_first")
    previous_last = F.lag("_last").over(per_key)
    is_new = previous_last.isNull() | (F.col("_first") - previous_last > gap_us)
    merged = (
        partial.withColumn("_new", F.when(is_new, F.col("_first")))
        .withColumn("_start", F.max("_new").over(
            per_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*keys, "_start")
        .agg(
            F.max("_last").alias("_last"), F.sum("_n").alias("event_count"),
            *[F.coalesce(F.min(f"_{c}")["value"], F.lit("")).alias(c) for c in firsts],
            F.coalesce(F.min("_entry")["value"], F.lit("")).alias("entry_screen"),
            F.coalesce(F.max("_exit")["value"], F.lit("")).alias("exit_screen"),
            F.sum("_screens").alias("screen_count"),
        )
    )
    return merged.select(
        *keys, session_id(keys, F.col("_start")).alias("session_id"), *firsts,
        F.timestamp_micros("_start").alias("started_at"),
        F.timestamp_micros("_last").alias("ended_at"),
        F.floor((F.col("_last") - F.col("_start")) / 1_000_000).cast("bigint").alias("duration_s"),
        "event_count", "screen_count", "entry_screen", "exit_screen",
        F.lit("timeout").alias("exit_reason"),
    )


def session_screens(
    sessions_with_events: DataFrame,
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
    part_size: int = 1000,
) -> DataFrame:
    """Ordered screens of every session, in parts of at most ``part_size`` names.

    Almost every session is one part; a session without end has as many parts as it needs.
    """
    screens = sessions_with_events.filter(vocabulary.is_screen() & (prop("screen_name") != ""))
    return ordered_parts(screens, prop("screen_name"), "screens", part_size)


def ordered_parts(events: DataFrame, value: Column, name: str, part_size: int) -> DataFrame:
    """Ordered ``value`` lists per session, split into bounded parts."""
    ranked = rank_in_session(events.select(
        "app_id", "session_id", "event_id", "event_time", value.alias("_value")
    ))
    return (
        ranked.withColumn("part", F.floor((F.col("_rank") - 1) / part_size))
        .groupBy("app_id", "session_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "_value"))).alias("_items"))
        .select("app_id", "session_id", "part",
                F.transform("_items", lambda item: item["_value"]).alias(name))
    )


def rank_in_session(events: DataFrame, chunk: str | int = "15 minutes") -> DataFrame:
    """Position of each event in its session by (event_time, event_id), without one task per session."""
    chunk_us = seconds(chunk) * 1_000_000
    keys = ["app_id", "session_id"]
    placed = events.withColumn("_chunk", F.floor(F.unix_micros("event_time") / chunk_us))
    offsets = placed.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n")).select(
        *keys, "_chunk",
        F.coalesce(F.sum("_n").over(
            Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        ), F.lit(0)).alias("_offset"),
    )
    within = Window.partitionBy("_chunk", *reversed(keys)).orderBy("event_time", "event_id")
    return (
        placed.withColumn("_row", F.row_number().over(within))
        .join(offsets, [*keys, "_chunk"])
        .withColumn("_rank", F.col("_row") + F.col("_offset"))
        .drop("_chunk", "_row", "_offset")
    )


def session_event_rows(summaries: DataFrame) -> DataFrame:
    """Session start and end records in the layout of the fact table, so that they can be added to it.

    A start has the time of the first event, an end that of the last one. What a session does not know is empty, its
    revenue null.
    """
    base = ["app_id", "session_id", "user_id", "device_id", "country_code", "platform"]
    starts = summaries.select(
        *base, F.lit("session_start").alias("event_name"), F.col("started_at").alias("event_time"),
        F.create_map(F.lit("entry_screen"), F.col("entry_screen")).alias("props"),
    )
    ends = summaries.select(
        *base, F.lit("session_end").alias("event_name"), F.col("ended_at").alias("event_time"),
        F.create_map(
            F.lit("session_duration_s"), F.col("duration_s").cast("string"),
            F.lit("event_count"), F.col("event_count").cast("string"),
            F.lit("entry_screen"), F.col("entry_screen"),
            F.lit("exit_screen"), F.col("exit_screen"),
            F.lit("exit_reason"), F.col("exit_reason"),
        ).alias("props"),
    )
    known = starts.unionByName(ends).withColumns({
        "event_id": F.sha2(F.concat_ws("|", "app_id", "session_id", "event_name"), 256),
        "server_time": F.col("event_time"), "revenue": F.lit(None).cast("double"),
    })
    unknown = [c for c in EVENT_COLUMNS if c not in known.columns]
    return known.withColumns({c: F.lit("") for c in unknown}).select(*EVENT_COLUMNS)


def session_metrics(summaries: DataFrame) -> DataFrame:
    """Average and median duration, session count and events per session."""
    return summaries.groupBy("app_id").agg(
        F.avg("duration_s").alias("avg_duration_s"),
        F.median("duration_s").alias("median_duration_s"),
        F.count("*").alias("total_sessions"),
        F.avg("event_count").alias("avg_events_per_session"),
    )


def bounce_rate(summaries: DataFrame) -> DataFrame:
    """Share of sessions with exactly one event."""
    return summaries.groupBy("app_id").agg(
        F.count("*").alias("sessions"),
        F.count_if(F.col("event_count") == 1).alias("bounced"),
    ).withColumn("bounce_rate", safe_ratio(F.col("bounced"), F.col("sessions")))


def session_duration_histogram(summaries: DataFrame) -> DataFrame:
    """Sessions per duration bucket; empty buckets are listed with 0."""
    index = F.lit(len(DURATION_BUCKETS) - 1)
    for i, (upper, _) in reversed(list(enumerate(DURATION_BUCKETS[:-1]))):
        index = F.when(F.col("duration_s") <= upper, F.lit(i)).otherwise(index)
    counts = summaries.groupBy("app_id").agg(*[
        F.count_if(index == i).alias(f"_b{i}") for i in range(len(DURATION_BUCKETS))
    ])
    buckets = F.array(*[
        F.struct(F.lit(i).alias("bucket_no"), F.lit(label).alias("bucket"),
                 F.col(f"_b{i}").alias("sessions"))
        for i, (_, label) in enumerate(DURATION_BUCKETS)
    ])
    return counts.select("app_id", F.inline(buckets))


def session_trend(summaries: DataFrame) -> DataFrame:
    """Sessions and average duration per day."""
    return summaries.groupBy("app_id", F.to_date("started_at").alias("day")).agg(
        F.count("*").alias("sessions"), F.avg("duration_s").alias("avg_duration_s")
    )
