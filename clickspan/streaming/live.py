"""Live counters, rollup upkeep and campaign notifications."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from clickspan.operators.active import identity
from clickspan.operators.campaigns import DEFAULT_COOLDOWN_S, delivery_outbox, match_campaigns
from clickspan.plans.rollups import ROLLUPS
from clickspan.schema import EVENTS
from clickspan.sources import manifest
from clickspan.streaming.base import DELAY, checkpoint_location, with_watermark
from clickspan.streaming.controlled import ControlledProcessor, controlled
from clickspan.streaming.ordered import OrderedProcessor
from clickspan.vocabulary import DEFAULT_VOCABULARY, Vocabulary


def realtime_stream(
    events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", delay: str = DELAY
) -> DataFrame:
    """Events per minute and active users over a sliding window."""
    spans = F.window("event_time", window, slide)
    grouped = with_watermark(events, delay=delay).groupBy("app_id", spans).agg(
        F.count("*").alias("events"), F.approx_count_distinct(identity(False)).alias("active_users")
    )
    minutes = (F.unix_seconds("window.end") - F.unix_seconds("window.start")) / 60
    return grouped.select(
        "app_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        (F.col("events") / minutes).alias("events_per_minute"), "active_users",
    )


def realtime_top_stream(
    events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", delay: str = DELAY
) -> DataFrame:
    """Counts per event over the same window."""
    return _window_counts(events, window, slide, delay).select(
        "app_id", "event_name", F.col("window.end").alias("window_end"), "event_count")


def _window_counts(events: DataFrame, window: str, slide: str, delay: str) -> DataFrame:
    spans = F.window("event_time", window, slide)
    return with_watermark(events, delay=delay).groupBy("app_id", "event_name", spans).agg(F.count("*").alias("event_count"))


def realtime_stats_stream(
    events: DataFrame, top: int = 10, window: str = "5 minutes", slide: str = "1 minute", delay: str = DELAY, buckets: int = 64
) -> DataFrame:
    """The live view, a row per app and window: events per minute and the ``top`` events, largest first, ties by name.

    Counts per event name are ranked inside ``buckets`` of names first, then the best of the buckets: no state row
    holds more than a bucket's names, whatever names clients make up.
    """
    def largest(found: Column) -> Column:
        ordered = F.array_sort(found, lambda a, b: F.when(a["event_count"] != b["event_count"], F.signum(b["event_count"] - a["event_count"]))
                               .when(a["event_name"] < b["event_name"], -1).when(a["event_name"] > b["event_name"], 1).otherwise(0).cast("int"))
        return F.slice(ordered, 1, top)

    item = F.struct("event_name", "event_count")
    bucketed = _window_counts(events, window, slide, delay).groupBy(
        "app_id", "window", F.pmod(F.xxhash64("event_name"), F.lit(buckets)).alias("_bucket")
    ).agg(F.sum("event_count").alias("_events"), largest(F.collect_list(item)).alias("_top"))
    merged = bucketed.groupBy("app_id", "window").agg(
        F.sum("_events").alias("_events"), largest(F.flatten(F.collect_list("_top"))).alias("top_events"))
    minutes = (F.unix_seconds("window.end") - F.unix_seconds("window.start")) / 60
    return merged.select(
        "app_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        (F.col("_events") / minutes).alias("events_per_minute"), "top_events")


def write_partials(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch's partial rows under its own partition; a replay replaces them."""
    rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch_id").parquet(path)


def _rollup_table(spark: SparkSession, name: str) -> tuple[StructType, str, list[str]]:
    """Layout, time column and order of a stored rollup."""
    rollup = ROLLUPS[name]
    schema = rollup.build(spark.createDataFrame([], EVENTS)).schema
    return schema, next((c for c in ("day", "hour") if c in rollup.keys), "first_seen"), list(rollup.keys)


def rollup_stream(
    events: DataFrame,
    names: Sequence[str],
    path: str,
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
    checkpoint: str | None = None,
    available_now: bool = False,
    writer: str = "stream",
) -> DataStreamWriter:
    """Keep rollups current: each batch adds one set of partial rows per rollup, once.

    ``writer`` names the stream in the manifests; a stream that starts over with a new checkpoint needs a new name.
    """
    def update(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name in names:
                _, day, order = _rollup_table(batch.sparkSession, name)
                manifest.append(ROLLUPS[name].build(batch, vocabulary), f"{path}/{name}", writer, batch_id, day, order)
        finally:
            batch.unpersist()

    location = checkpoint_location(events.sparkSession, "rollups", checkpoint)
    query = events.writeStream.option("checkpointLocation", location).foreachBatch(update)
    return query.trigger(availableNow=True) if available_now else query


def read_rollup(spark: SparkSession, name: str, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Merged rollup over the live partial rows, of the days from ``first`` to ``last`` where they are given."""
    return ROLLUPS[name].merge(manifest.read(spark, f"{path}/{name}", _rollup_table(spark, name)[0], first, last))


def compact_rollup(spark: SparkSession, name: str, path: str, before: str) -> bool:
    """Merge the partial rows of the days before ``before`` into one part, while the stream goes on."""
    schema, day, order = _rollup_table(spark, name)
    return manifest.compact(spark, f"{path}/{name}", schema, ROLLUPS[name].merge, day, before, order)


def expire_rollup(spark: SparkSession, name: str, path: str, as_of: dt.date, days: int = 365) -> bool:
    """Take the days older than the retention period out of a rollup; ``manifest.vacuum`` deletes their files later."""
    return manifest.expire(spark, f"{path}/{name}", (as_of - dt.timedelta(days=days)).isoformat())


class CooldownProcessor(OrderedProcessor):
    """Lets a row through when the last one sent is at least its cooldown ago (whole seconds)."""

    row_schema = "t bigint, event_name string, channel string, app_id string, wait bigint"
    state_schema = "last bigint, wait bigint"
    columns = ["t", "event_name", "channel", "app_id", "wait"]

    def millis(self, row) -> int:
        return -(-row[0] // 1000)

    def expires(self, state):
        return None if state is None else (state[0] + state[1]) * 1000

    def consume(self, key, state, rows, watermark):
        out = []
        for t, event_name, channel, app_id, wait in rows:
            second = t // 1_000_000
            if state is None or second - state[0] >= wait:
                state = (second, wait)
                out.append({"campaign_id": key[0], "user_id": key[1], "app_id": app_id,
                            "event_name": event_name, "channel": channel, "t": t})
        if state is not None and (state[0] + state[1]) * 1000 <= watermark:
            state = None
        return state, out


class LiveCampaignProcessor(ControlledProcessor):
    """Notifications of the campaigns in effect at each trigger; an edit keeps the last sent moment."""

    progress_schema = "last bigint, wait bigint"

    def consume(self, key, versions, rows):
        out = []
        for t, user, name, segments in sorted(rows):
            for campaign, found in sorted(versions.items()):
                body = (self.at(found, t) or (0, {"active": False}))[1]
                if not body.get("active", True) or body["trigger_conf"].get("topic") != name:
                    continue
                if body.get("segment_id") and body["segment_id"] not in segments:
                    continue
                wait, own = body.get("cooldown_seconds"), (campaign, found[0][0], user)
                wait = DEFAULT_COOLDOWN_S if wait is None else wait
                last = self.progress.getValue(own)[0] if self.progress.containsKey(own) else None
                second = t // 1_000_000
                if last is None or second - last >= wait:
                    self.put(own, (second, wait), t + wait * 1_000_000)
                    out.append({"campaign_id": campaign, "user_id": user, "app_id": key[0], "event_name": name,
                                "channel": body["channel"], "t": t})
        return out

    def dead(self, value, watermark, version):
        return (value[0] + value[1]) * 1_000_000 < watermark


def campaign_stream(
    triggers: DataFrame, campaigns: DataFrame, segment_members: DataFrame | None = None, delay: str = DELAY
) -> DataFrame:
    """Outbox rows of a trigger stream (events, session ends, conversions).

    A table of campaigns stays as it was at the start; a stream of campaign versions (with ``valid_from``) is kept in
    state, and edits take effect while the stream runs. Segment members are a table in both cases.
    """
    if campaigns.isStreaming:
        segments = None
        if segment_members is not None:
            of_user = segment_members.groupBy("app_id", "user_id").agg(F.collect_set("segment_id").alias("_segments"))
            triggers = triggers.join(of_user, ["app_id", "user_id"], "left")
            segments = F.coalesce("_segments", F.array().cast("array<string>"))
        found = controlled(triggers, campaigns.withColumnRenamed("id", "campaign_id"), "campaign_id", delay=delay, segments=segments)
        sent = found.groupBy("app_id", "shard").transformWithStateInPandas(
            LiveCampaignProcessor(),
            "campaign_id string, user_id string, app_id string, event_name string, channel string, t bigint", "Append", "EventTime")
        return delivery_outbox(sent.withColumn("event_time", F.timestamp_micros("t")))
    matched = match_campaigns(with_watermark(triggers, delay=delay), campaigns, segment_members)
    rows = matched.select(
        "campaign_id", "user_id", "event_time", F.unix_micros("event_time").alias("t"), "event_name",
        "channel", "app_id", F.col("cooldown_seconds").cast("bigint").alias("wait"),
    )
    sent = rows.groupBy("campaign_id", "user_id").transformWithStateInPandas(
        CooldownProcessor(),
        "campaign_id string, user_id string, app_id string, event_name string, channel string, t bigint",
        "Append", "EventTime",
    )
    return delivery_outbox(sent.withColumn("event_time", F.timestamp_micros("t")))
