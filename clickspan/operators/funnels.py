"""Funnels: ordered steps within a window of the first step, counted per user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickspan.functions import sequences as seq
from clickspan.functions.greedy import greedy
from clickspan.functions.stats import safe_ratio
from clickspan.functions.text import not_blank
from clickspan.functions.time import seconds, timestamp

USER = ["app_id", "user_id"]
MIN_STEPS, MAX_STEPS = 2, 10
#: Chunks of a block.
CHUNKS = 1024


def check_steps(steps: Sequence[str]) -> list[str]:
    if not MIN_STEPS <= len(steps) <= MAX_STEPS:
        raise ValueError("a funnel has 2 to 10 steps")
    if len(set(steps)) != len(steps):
        raise ValueError("funnel steps must be distinct")
    return list(steps)


def check_window(window: str | int) -> int:
    if seconds(window) < 1:
        raise ValueError("a funnel window is at least one second")
    return seconds(window)


def _chunk_lists(step_events: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """Distinct ``(t, step)`` per (key, chunk); a chunk is no longer than the window."""
    length = F.least(F.col("window"), F.lit(longest))
    return (
        step_events.withColumn("chunk", F.floor(F.col("t") / length).cast("bigint"))
        .groupBy(*keys, "n", "window", "chunk")
        .agg(F.sort_array(F.collect_set(F.struct("t", "step"))).alias("events"))
    )


def _progress(step_events: DataFrame, keys: list[str]) -> DataFrame:
    n, window = F.col("n"), F.col("window")
    chunks = _chunk_lists(step_events, keys, 3600).withColumn(
        "events", seq.condense(F.col("events"), n)
    )
    return (
        chunks.groupBy(*keys, "n", "window")
        .agg(F.sort_array(F.flatten(F.collect_list("events"))).alias("events"))
        .withColumn("starts", seq.progress(F.col("events"), n, window))
        .withColumn("level", seq.level(F.col("starts")))
    )


def _step_number(steps: list[str]) -> Column:
    number = F.when(F.col("event_name") == steps[0], F.lit(0))
    for i, name in enumerate(steps[1:], start=1):
        number = number.when(F.col("event_name") == name, F.lit(i))
    return number


def window_funnel(
    events: DataFrame,
    steps: Sequence[str],
    window: str | int = "7 days",
    time_col: str = "event_time",
) -> DataFrame:
    """Per user, the longest prefix of ``steps`` done in order inside the window (whole seconds)."""
    steps = check_steps(steps)
    step_events = events.filter(F.col("event_name").isin(*steps) & not_blank("user_id")).select(
        *USER,
        F.unix_seconds(time_col).alias("t"),
        _step_number(steps).alias("step"),
        F.lit(len(steps)).alias("n"),
        F.lit(check_window(window)).cast("bigint").alias("window"),
    )
    return _progress(step_events, USER).select(*USER, "level")


def funnel(
    events: DataFrame,
    steps: Sequence[str],
    window: str | int = "7 days",
    time_col: str = "event_time",
) -> DataFrame:
    """Users reaching each step, conversion against step 1 and drop-off to the next step."""
    steps = check_steps(steps)
    counts = window_funnel(events, steps, window, time_col).groupBy("app_id").agg(*[
        F.count_if(F.col("level") >= i + 1).alias(f"_n{i}") for i in range(len(steps))
    ])
    users = [F.col(f"_n{i}") for i in range(len(steps))]

    def row(i: int, name: str) -> Column:
        drop = (
            F.when(users[i] > 0, 1.0 - users[i + 1] / users[i]).otherwise(F.lit(0.0))
            if i + 1 < len(steps) else F.lit(0.0)
        )
        return F.struct(
            F.lit(i + 1).alias("step"), F.lit(name).alias("event_name"),
            users[i].alias("user_count"),
            safe_ratio(users[i], users[0]).alias("conversion_rate"),
            drop.alias("drop_off_rate"),
        )

    return counts.select(
        "app_id", F.inline(F.array(*[row(i, name) for i, name in enumerate(steps)]))
    )


def funnel_overall(
    events: DataFrame,
    steps: Sequence[str],
    window: str | int = "7 days",
    time_col: str = "event_time",
) -> DataFrame:
    """Users who entered, users who finished and their ratio."""
    levels = window_funnel(events, steps, window, time_col)
    return levels.groupBy("app_id").agg(
        F.count_if(F.col("level") >= 1).alias("entered"),
        F.count_if(F.col("level") >= len(steps)).alias("converted"),
    ).withColumn("overall_rate", safe_ratio(F.col("converted"), F.col("entered")))


FUNNEL_USER = ["app_id", "funnel_id", "user_id"]


def definition_steps(definitions: DataFrame, unit: int) -> DataFrame:
    """One row per step; definitions with bad steps or windows are left out."""
    valid = (
        F.size("steps").between(MIN_STEPS, MAX_STEPS)
        & (F.size(F.array_distinct("steps")) == F.size("steps"))
        & (F.col("window_seconds") > 0)
    )
    return definitions.filter(valid).select(
        "app_id", "funnel_id", F.size("steps").alias("n"),
        (F.col("window_seconds") * unit).alias("window"),
        F.posexplode("steps").alias("step", "event_name"),
    )


def _definition_events(events: DataFrame, definitions: DataFrame, t: Column, unit: int) -> DataFrame:
    """Step events of every definition of the app in one pass.

    The join has no forced broadcast: the definition table is small and Spark broadcasts it while
    it stays so.
    """
    by_step = definition_steps(definitions, unit)
    return (
        events.filter(not_blank("user_id"))
        .select("app_id", "user_id", "event_name", t.alias("t"))
        .join(by_step, ["app_id", "event_name"])
    )


def funnel_conversions(
    events: DataFrame, definitions: DataFrame, time_col: str = "server_time"
) -> DataFrame:
    """One row per conversion for every definition; progress starts over after a conversion.

    1. Every (user, chunk) is condensed, chunks are condensed to blocks, and the state that enters a block, and
       then a chunk, is folded from what lies before it. A row holds the chunks of one block, or the blocks of a
       user, whose number depends on the calendar alone.
    2. Chunks list the chains that end in them with the latest start. Conversions are the greedy selection among
       these: the first to end, then the first to end of those that start after it.
    """
    n, window = F.col("n"), F.col("window")
    keys = [*FUNNEL_USER, "n", "window"]
    steps = _definition_events(events, definitions, F.unix_millis(time_col), 1000)
    lists = _chunk_lists(steps, FUNNEL_USER, 300_000)

    blocks = (
        lists.withColumn("events", seq.condense(F.col("events"), n))
        .groupBy(*keys, F.floor(F.col("chunk") / CHUNKS).cast("bigint").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col("chunk").alias("at"), "events"))).alias("chunks"))
    )
    summaries = blocks.select(*keys, "block", seq.condense(F.flatten("chunks.events"), n).alias("events"))
    of_blocks = (
        summaries.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(F.col("block").alias("at"), "events"))).alias("blocks"))
        .select(*keys, F.inline(seq.entries(F.col("blocks"), n, window, seq.no_progress(n))))
        .withColumnRenamed("at", "block")
    )
    of_chunks = (
        blocks.join(of_blocks, [*keys, "block"])
        .select(*keys, F.inline(seq.entries(F.col("chunks"), n, window, F.col("entry"))))
        .withColumnRenamed("at", "chunk")
    )
    chains = lists.join(of_chunks, [*keys, "chunk"]).select(
        *FUNNEL_USER, "n", F.inline(seq.completions(F.col("events"), n, window, F.col("entry"))))
    found = greedy(
        chains.withColumn("start", F.col("start") - 1), [*FUNNEL_USER, "n"], "end", "start", 3_600_000,
    ).withColumn("start", F.col("start") + 1)
    return found.select(
        *FUNNEL_USER,
        F.col("n").alias("steps_complete"), F.col("n").alias("total_steps"),
        F.lit(True).alias("converted"),
        (F.col("end") - F.col("start")).alias("duration_ms"),
        F.timestamp_millis("end").alias("converted_at"),
        F.lit("").alias("campaign_id"),
    )


def funnel_progress(
    events: DataFrame, definitions: DataFrame, time_col: str = "event_time"
) -> DataFrame:
    """Best step reached per (definition, user), with the last time the first step was done."""
    steps = _definition_events(events, definitions, F.unix_seconds(time_col), 1)
    return _progress(steps, FUNNEL_USER).select(
        *FUNNEL_USER, F.col("level").alias("steps_complete"), F.col("n").alias("total_steps"),
        F.timestamp_seconds(F.get("starts", F.lit(0))).alias("last_entered_at"),
        F.col("window").alias("window_seconds"),
    )


def funnel_dropoffs(
    events: DataFrame, definitions: DataFrame, as_of, time_col: str = "event_time"
) -> DataFrame:
    """Users who entered, never finished, and whose last window closed before ``as_of``."""
    closes = F.unix_seconds("last_entered_at") + F.col("window_seconds")
    return funnel_progress(events, definitions, time_col).filter(
        F.col("steps_complete").between(1, F.col("total_steps") - 1)
        & (closes < F.unix_seconds(timestamp(as_of)))
    ).drop("window_seconds")


def funnel_results(conversions: DataFrame, start=None, end=None) -> DataFrame:
    """Rows and users per step count from the stored conversion table."""
    if start is not None:
        conversions = conversions.filter(F.col("converted_at") >= timestamp(start))
    if end is not None:
        conversions = conversions.filter(F.col("converted_at") <= timestamp(end))
    per_user = conversions.groupBy("app_id", "funnel_id", "steps_complete", "user_id").agg(
        F.count("*").alias("_n")
    )
    return per_user.groupBy("app_id", "funnel_id", "steps_complete").agg(
        F.sum("_n").alias("conversions"), F.count("*").alias("users")
    )
