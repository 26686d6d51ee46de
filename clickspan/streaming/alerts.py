"""Alerts by the clock.

Two kinds of streams meet in tables. ``minute_stream`` adds mergeable minute rows for each batch of events or
sessions, without state and without a watermark, so the last minutes before a silence are there too.
``alert_stream`` follows a clock (a rate source, or any stream with ``timestamp``): whatever the events do, every
minute that has closed since the last tick is judged on its own, so silence is seen and a clock that was
stopped catches up minute by minute. All writes are keyed by batch id; a repeated batch replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from clickspan.operators.alerts import MINUTE, apply_cooldown, breached, minute_metrics, rule_values, session_minutes
from clickspan.operators.campaigns import alert_outbox
from clickspan.operators.funnels import funnel_overall
from clickspan.sources.events import path_exists
from clickspan.streaming.base import checkpoint_location
from clickspan.streaming.live import write_partials
from clickspan.vocabulary import DEFAULT_VOCABULARY, Vocabulary

KINDS = ("events", "sessions")
FUNNEL_METRIC = "funnel_conversion_rate"


def clock(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A stream of ``timestamp`` that goes on without events."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def _started(writer: DataStreamWriter, available_now: bool, trigger: str) -> DataStreamWriter:
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)


def minute_stream(
    rows: DataFrame,
    path: str,
    kind: str = "events",
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
    trigger: str = "10 seconds",
    checkpoint: str | None = None,
    available_now: bool = False,
) -> DataStreamWriter:
    """Add minute rows of an event stream, or of session summaries (``kind`` sessions), by day and batch."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")

    def update(batch: DataFrame, batch_id: int) -> None:
        found = minute_metrics(batch, vocabulary) if kind == "events" else session_minutes(batch)
        found.withColumn("day", F.to_date("minute")).withColumn("batch_id", F.lit(batch_id)).write.mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(f"{path}/minutes-{kind}")

    location = checkpoint_location(rows.sparkSession, f"minutes-{kind}", checkpoint)
    writer = rows.writeStream.option("checkpointLocation", location).foreachBatch(update)
    return _started(writer, available_now, trigger)


def read_minutes(spark: SparkSession, path: str, after: int | None = None) -> DataFrame:
    """Minute rows of all kinds, of the days and minutes after a second since the epoch."""
    found = spark.createDataFrame([], MINUTE)
    for kind in KINDS:
        if path_exists(spark, f"{path}/minutes-{kind}"):
            rows = spark.read.schema(f"{MINUTE}, day date, batch_id bigint").parquet(f"{path}/minutes-{kind}")
            if after is not None:
                since = F.timestamp_seconds(F.lit(after))
                rows = rows.filter((F.col("day") >= F.to_date(since)) & (F.col("minute") > since))
            found = found.unionByName(rows.drop("day", "batch_id"))
    return found


def _earlier(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch_id bigint").parquet(path).filter(F.col("batch_id") < batch_id).drop("batch_id")


SENT = ("rule_id string, app_id string, metric_name string, condition string, threshold double, window_mins int, "
        "fired_at timestamp, value double")


def _funnel_values(values: DataFrame, rules: DataFrame, events: DataFrame, steps: list[str], window: str | int, until: int) -> DataFrame:
    """``values`` with the funnel rate of the last judged minute, from the event table."""
    lengths = [r[0] for r in rules.filter("active").filter(F.col("metric_name") == FUNNEL_METRIC).select("window_mins").distinct().collect()]
    for length in lengths:  # windows of the rules, not rows
        inside = events.filter((F.unix_seconds("event_time") >= until - length * 60) & (F.unix_seconds("event_time") < until))
        rate = funnel_overall(inside, steps, window).select("app_id", F.col("overall_rate").alias("_rate"))
        mine = (F.col("metric_name") == FUNNEL_METRIC) & (F.col("window_mins") == length) & (F.unix_seconds("as_of") == until)
        values = values.join(rate, "app_id", "left").withColumn("value", F.when(mine, F.col("_rate")).otherwise(F.col("value"))).drop("_rate")
    return values


def alert_stream(
    ticks: DataFrame,
    rules: Callable[[], DataFrame],
    path: str,
    cooldown_s: int = 1800,
    delay_s: int = 60,
    events: Callable[[], DataFrame] | None = None,
    funnel_steps: list[str] | None = None,
    funnel_window: str | int = "7 days",
    contacts: Callable[[], DataFrame] | None = None,
    trigger: str = "10 seconds",
    checkpoint: str | None = None,
    available_now: bool = False,
) -> DataStreamWriter:
    """Judge the active rules at every minute that has closed by the clock, and record the alerts to send.

    A minute is closed ``delay_s`` after its end. Rules are read again at each tick. The funnel rate is no sum of
    minutes: with ``events`` and ``funnel_steps`` it is computed from the event table, at the last of the minutes.
    With ``contacts`` the alerts also become outbox rows, a row for each channel and recipient.
    """
    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = batch.agg(F.max(F.unix_seconds("timestamp"))).first()[0]
        if now is None:
            return
        until = (now - delay_s) // 60 * 60
        judged = _earlier(spark, f"{path}/judged", batch_id, "until bigint").agg(F.max("until")).first()[0]
        since = until - 60 if judged is None else judged
        if until <= since:
            return
        current = rules()
        longest = current.agg(F.max("window_mins")).first()[0] or 0
        minutes = read_minutes(spark, path, since - max(60 * longest, 86_400))
        closed = F.explode(F.transform(F.sequence(F.lit(since + 60), F.lit(until), F.lit(60)), F.timestamp_seconds))
        values = rule_values(current, minutes, closed)
        if events is not None and funnel_steps is not None:
            values = _funnel_values(values, current, events(), funnel_steps, funnel_window, until)
        fired = values.filter(breached(F.col("value"), F.col("condition"), F.col("threshold"))).withColumnRenamed("as_of", "fired_at")
        names = [c.split(" ")[0] for c in SENT.split(", ")]
        known = _earlier(spark, f"{path}/sent", batch_id, SENT).filter(F.unix_seconds("fired_at") > since - cooldown_s)
        both = fired.select(*names, F.lit(True).alias("_new")).unionByName(known.select(*names, F.lit(False).alias("_new")))
        write_partials(apply_cooldown(both, cooldown_s).filter("_new").select(*names), batch_id, f"{path}/sent")
        if contacts is not None:
            sent = spark.read.schema(f"{SENT}, batch_id bigint").parquet(f"{path}/sent").filter(F.col("batch_id") == batch_id)
            write_partials(alert_outbox(sent.drop("batch_id"), current, contacts()), batch_id, f"{path}/outbox")
        write_partials(spark.createDataFrame([(until,)], "until bigint"), batch_id, f"{path}/judged")

    location = checkpoint_location(ticks.sparkSession, "alerts", checkpoint)
    writer = ticks.writeStream.option("checkpointLocation", location).foreachBatch(update)
    return _started(writer, available_now, trigger)
