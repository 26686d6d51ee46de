"""Campaign triggers, the delivery outbox and delivery statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspan.functions.stats import safe_ratio
from clickspan.functions.text import not_blank
from clickspan.functions.time import TimeLike, timestamp
from clickspan.operators.alerts import apply_cooldown

DEFAULT_COOLDOWN_S = 1800


def conversion_triggers(conversions: DataFrame) -> DataFrame:
    """Funnel conversions as ``goal_reached`` trigger rows."""
    return conversions.select(
        "app_id", "user_id", F.lit("goal_reached").alias("event_name"),
        F.col("converted_at").alias("event_time"),
        F.create_map(F.lit("funnel_id"), F.col("funnel_id")).alias("props"),
    )


def dropoff_triggers(dropoffs: DataFrame) -> DataFrame:
    """Funnel drop-offs as ``funnel_drop`` trigger rows."""
    return dropoffs.select(
        "app_id", "user_id", F.lit("funnel_drop").alias("event_name"),
        F.col("last_entered_at").alias("event_time"),
        F.create_map(
            F.lit("funnel_id"), F.col("funnel_id"),
            F.lit("steps_complete"), F.col("steps_complete").cast("string"),
        ).alias("props"),
    )


def match_campaigns(
    triggers: DataFrame, campaigns: DataFrame, segment_members: DataFrame | None = None
) -> DataFrame:
    """Trigger rows of active campaigns of the same app, before cooldown."""
    active = campaigns.filter("active").select(
        "app_id", F.col("id").alias("campaign_id"),
        F.col("trigger_conf")["topic"].alias("event_name"), "channel",
        F.coalesce("segment_id", F.lit("")).alias("segment_id"),
        F.coalesce("cooldown_seconds", F.lit(DEFAULT_COOLDOWN_S)).alias("cooldown_seconds"),
    )
    matched = triggers.select("app_id", "user_id", "event_name", "event_time").join(
        active, ["app_id", "event_name"]
    )
    if segment_members is None:
        return matched.filter(F.col("segment_id") == "")
    members = segment_members.select("segment_id", "app_id", "user_id").distinct().withColumn(
        "_member", F.lit(True)
    )
    return (
        matched.join(members, ["segment_id", "app_id", "user_id"], "left")
        .filter((F.col("segment_id") == "") | F.col("_member"))
        .drop("_member")
    )


def campaign_triggers(
    triggers: DataFrame, campaigns: DataFrame, segment_members: DataFrame | None = None
) -> DataFrame:
    """Notifications to send: matched rows after each campaign's cooldown per user."""
    matched = match_campaigns(triggers, campaigns, segment_members)
    return apply_cooldown(
        matched, F.col("cooldown_seconds"), ("campaign_id", "user_id"), "event_time"
    )


def scheduled_notifications(
    campaigns: DataFrame, segment_members: DataFrame, as_of: TimeLike
) -> DataFrame:
    """A run of the scheduled campaigns: one notification per member of the segment."""
    due = campaigns.filter(F.col("active") & (F.col("trigger_type") == "scheduled")).select(
        "app_id", "segment_id", F.col("id").alias("campaign_id"), "channel"
    )
    members = segment_members.select("segment_id", "app_id", "user_id").distinct()
    return members.join(due, ["app_id", "segment_id"]).select(
        "campaign_id", "app_id", "user_id", F.lit("scheduled").alias("event_name"), "channel",
        timestamp(as_of).alias("event_time"),
    )


def delivery_outbox(notifications: DataFrame) -> DataFrame:
    """Outbox rows, still to be delivered; the id repeats on replay so a consumer can drop doubles."""
    payload = F.to_json(F.struct(
        "campaign_id", "app_id", "user_id", "event_name",
        F.unix_millis("event_time").alias("event_time_ms"),
    ))
    key = F.concat_ws("|", "campaign_id", "user_id", F.unix_millis("event_time"))
    return notifications.select(
        F.sha2(key, 256).alias("id"), "campaign_id", "app_id", "user_id", "channel",
        payload.alias("payload"), F.lit("pending").alias("status"),
        F.col("event_time").alias("created_at"),
    )


def alert_outbox(fired: DataFrame, rules: DataFrame, contacts: DataFrame) -> DataFrame:
    """Outbox rows of alerts: one for each channel of the rule and each contact of the app on it.

    ``contacts`` has app_id, channel and recipient. A channel without a contact gives a row that failed, with the
    reason, so no alert vanishes. Ids repeat on replay.
    """
    payload = F.to_json(F.struct(
        "rule_id", "app_id", "metric_name", "condition", "threshold", "value", "window_mins",
        F.unix_millis("fired_at").alias("fired_at_ms"),
    ))
    channels = rules.select(F.col("id").alias("rule_id"), F.explode(F.array_distinct("channels")).alias("channel"))
    known = contacts.filter(not_blank("recipient")).select("app_id", "channel", "recipient").distinct()
    rows = fired.withColumn("payload", payload).join(channels, "rule_id").join(known, ["app_id", "channel"], "left")
    missing = F.col("recipient").isNull()
    key = F.concat_ws("|", "rule_id", "channel", F.coalesce("recipient", F.lit("")), F.unix_millis("fired_at"))
    return rows.select(
        F.sha2(key, 256).alias("id"), "rule_id", "app_id", "channel", F.coalesce("recipient", F.lit("")).alias("recipient"),
        "payload", F.when(missing, "failed").otherwise("pending").alias("status"),
        F.when(missing, "no recipient").otherwise("").alias("error"), F.col("fired_at").alias("created_at"),
    )


def undelivered(outbox: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Pending outbox rows that no delivery reports on, each id once however often it was appended."""
    reported = deliveries.select("id").distinct()
    return outbox.filter("status = 'pending'").dropDuplicates(["id"]).join(reported, "id", "left_anti")


def campaign_stats(deliveries: DataFrame) -> DataFrame:
    """Deliveries per status and their rates against sent."""
    counts = deliveries.groupBy("campaign_id").agg(*[
        F.count_if(F.col("status") == status).alias(status)
        for status in ("sent", "delivered", "failed", "opened", "clicked")
    ])
    sent = F.col("sent")
    return counts.select(
        "*",
        (100.0 * safe_ratio(F.col("delivered"), sent)).alias("delivery_pct"),
        (100.0 * safe_ratio(F.col("opened"), sent)).alias("open_pct"),
        (100.0 * safe_ratio(F.col("clicked"), sent)).alias("click_pct"),
    )
