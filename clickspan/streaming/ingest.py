"""Streaming ingest: raw messages to the fact table, the archive and the dead letters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from clickspan.operators import ingest
from clickspan.sources.events import archive_raw, write_events_batch
from clickspan.streaming.base import DELAY, checkpoint_location, split_late


def dedup_stream(
    events: DataFrame,
    ttl: str = "24 hours",
    keys: Sequence[str] = ingest.EVENT_KEY,
    time_col: str = "server_time",
) -> DataFrame:
    """Exact deduplication within ``ttl``; the state forgets older ids by watermark."""
    return events.withWatermark(time_col, ttl).dropDuplicatesWithinWatermark(list(keys))


def event_rows(raw: DataFrame, ip_ranges: DataFrame, ttl: str = "24 hours", **limits: str | int) -> DataFrame:
    """Raw message stream to deduplicated fact rows; what is left out comes from ``rejected_rows`` and ``late_rows``."""
    usable, _ = ingest.dead_letter_split(raw)
    valid, _ = ingest.validate(ingest.explode_batches(usable), **limits)
    return dedup_stream(ingest.enrich(valid, ip_ranges), ttl)


def _payload(rows: DataFrame, error: Column, ts: Column) -> DataFrame:
    return rows.select(F.base64(F.to_json(F.struct("*")).cast("binary")).alias("original_payload"), error.alias("error"), ts.alias("ts"))


def rejected_rows(raw: DataFrame, **limits: str | int) -> DataFrame:
    """Events that break a rule, in the layout of the dead letters; ``error`` names the rules."""
    usable, _ = ingest.dead_letter_split(raw)
    _, rejected = ingest.validate(ingest.explode_batches(usable), **limits)
    return _payload(
        rejected.withColumn("raw_props", F.to_json("raw_props")), F.array_join("failed", ","), F.timestamp_millis("server_ts"))


def late_rows(raw: DataFrame, ip_ranges: DataFrame, delay: str = DELAY, **limits: str | int) -> DataFrame:
    """Valid events that the stateful streams may pass over because they came later than ``delay``."""
    usable, _ = ingest.dead_letter_split(raw)
    valid, _ = ingest.validate(ingest.explode_batches(usable), **limits)
    return split_late(ingest.enrich(valid, ip_ranges), delay)[1]


def write_left_out_stream(
    rows: DataFrame, path: str, name: str, checkpoint: str | None = None, available_now: bool = False
) -> DataStreamWriter:
    """Rejected or late rows to a table of their own, by day; ``name`` tells their checkpoints apart."""
    location = checkpoint_location(rows.sparkSession, name, checkpoint)
    writer = (
        rows.withColumn("day", F.to_date("ts")).writeStream.format("parquet").outputMode("append")
        .partitionBy("day").option("path", path).option("checkpointLocation", location)
    )
    return writer.trigger(availableNow=True) if available_now else writer


def write_events_stream(
    events: DataFrame, path: str, trigger: str = "1 minute", checkpoint: str | None = None,
    available_now: bool = False, writer: str = "stream",
) -> DataStreamWriter:
    """Append fact rows batch by batch, sorted and in files of measured size; a repeated batch adds nothing.

    A day of an app gets one file or few per trigger, so ``trigger`` bounds how many there are.
    """
    location = checkpoint_location(events.sparkSession, "events", checkpoint)
    query = events.writeStream.option("checkpointLocation", location).foreachBatch(
        lambda batch, batch_id: write_events_batch(batch, path, batch_id, writer) and None)
    return query.trigger(availableNow=True) if available_now else query.trigger(processingTime=trigger)


def write_dead_letters_stream(
    raw: DataFrame, path: str, checkpoint: str | None = None, available_now: bool = False
) -> DataStreamWriter:
    """Dead letters to their own table."""
    dead = ingest.dead_letters(ingest.parse_messages(raw))
    location = checkpoint_location(raw.sparkSession, "dead_letters", checkpoint)
    return write_left_out_stream(dead, path, "dead_letters", location, available_now)


def archive_stream(
    events: DataFrame, path: str, checkpoint: str | None = None, available_now: bool = False
) -> DataStreamWriter:
    """Archive every batch; ids already stored are skipped, so a replayed batch adds nothing."""
    location = checkpoint_location(events.sparkSession, "archive", checkpoint)
    writer = events.writeStream.option("checkpointLocation", location).foreachBatch(
        lambda batch, _id: archive_raw(batch, path)
    )
    return writer.trigger(availableNow=True) if available_now else writer
