"""Record layouts as Spark DDL."""

from __future__ import annotations

EVENT_COLUMNS = [
    "app_id", "event_id", "user_id", "device_id", "event_name", "event_time", "server_time",
    "session_id", "country_code", "platform", "app_version", "os_family", "browser", "city",
    "revenue", "props", "campaign_id", "install_source",
]

EVENTS = (
    "app_id string, event_id string, user_id string, device_id string, event_name string, "
    "event_time timestamp, server_time timestamp, session_id string, country_code string, "
    "platform string, app_version string, os_family string, browser string, city string, "
    "revenue double, props map<string,string>, campaign_id string, install_source string"
)

_DEVICE = (
    "device_model: string, os: string, os_version: string, manufacturer: string, "
    "screen_size: string, network_type: string, language: string, timezone: string, "
    "carrier: string, is_tablet: boolean, user_agent: string"
)
_APP = "version: string, build: string, platform: string, environment: string"
_EVENT = (
    "event_id: string, event_name: string, event_time: bigint, props: map<string,variant>, "
    f"device: struct<{_DEVICE}>, app: struct<{_APP}>, revenue: double"
)
_BATCH = (
    "app_id: string, device_id: string, user_id: string, sdk_version: string, "
    f"sent_at_ms: bigint, events: array<struct<{_EVENT}>>"
)

# One ingest message; `_corrupt` holds the payload of a message that does not parse.
ENVELOPE = (
    f"batch struct<{_BATCH}>, client_ip string, x_forwarded_for string, "
    "remote_addr string, authenticated_app string, server_ts bigint, _corrupt string"
)

FUNNEL_DEFINITIONS = (
    "funnel_id string, app_id string, name string, steps array<string>, window_seconds bigint"
)
EXPERIMENTS = (
    "id string, app_id string, name string, status string, "
    "variants array<struct<name: string, weight: int>>, "
    "metric_goals array<struct<metric: string, type: string>>"
)
ASSIGNMENTS = (
    "experiment_id string, user_id string, app_id string, variant string, assigned_at timestamp"
)
ALERT_RULES = (
    "id string, app_id string, name string, metric_name string, condition string, "
    "threshold double, window_mins int, channels array<string>, active boolean, "
    "last_fired_at timestamp"
)
CAMPAIGNS = (
    "id string, app_id string, name string, trigger_type string, "
    "trigger_conf map<string,string>, channel string, channel_conf map<string,string>, "
    "active boolean, segment_id string, cooldown_seconds int"
)
CONTACTS = "app_id string, channel string, recipient string"
DELIVERIES = (
    "id string, campaign_id string, app_id string, user_id string, channel string, "
    "status string, sent_at timestamp"
)
COHORTS = (
    "id string, app_id string, name string, filter_sql string, user_count bigint, "
    "last_computed_at timestamp"
)
APPS = "id string, org_id string, name string, rps double, burst int, active boolean"
IP_RANGES = (
    "start_ip bigint, end_ip bigint, country_code string, country_name string, region string, "
    "city string, latitude double, longitude double"
)
USER_TRAITS = "app_id string, user_id string, traits map<string,string>, ts timestamp"

DEFINITIONS = {
    "funnels": FUNNEL_DEFINITIONS,
    "experiments": EXPERIMENTS,
    "alert_rules": ALERT_RULES,
    "campaigns": CAMPAIGNS,
    "contacts": CONTACTS,
    "cohorts": COHORTS,
    "apps": APPS,
    "ip_ranges": IP_RANGES,
}
