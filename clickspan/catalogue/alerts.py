"""Alerts and campaigns."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickspan.catalogue.base import EV, ORACLES, query, sessions_cte
from clickspan.catalogue.funnels import CONVERSIONS, definitions, levels
from clickspan.functions.text import PropertyFilter
from clickspan.operators import alerts, campaigns, funnels, sessions, users
from clickspan.sources.testdata import TEST_VOCABULARY as V

AS_OF = "2024-01-15 12:00:00"
WINDOWS = [60, 1440, 10080]

RULES = """SELECT id, app_id, id AS name, metric_name, condition, CAST(threshold AS DOUBLE) AS threshold,
  window_mins, array('email') AS channels, active, CAST(NULL AS TIMESTAMP) AS last_fired_at
FROM VALUES
 ('r1', 'app_0', 'event_count', 'gt', 10, 1440, true), ('r2', 'app_0', 'event_count', 'lt', 10, 60, true),
 ('r3', 'app_1', 'error_rate', '>=', 15, 10080, true), ('r4', 'app_1', 'p99_latency', '>', 1, 10080, true),
 ('r5', 'app_2', 'dau', 'gte', 1, 60, true), ('r6', 'app_2', 'active_users', 'lte', 100000, 1440, true),
 ('r7', 'app_2', 'revenue_total', 'eq', -1, 1440, true), ('r8', 'app_0', 'event_count', 'gt', 0, 1440, false),
 ('r9', 'app_9', 'event_count', '=', 0, 60, true), ('r10', 'app_9', 'error_rate', 'gte', 0, 60, true)
 AS t(id, app_id, metric_name, condition, threshold, window_mins, active)"""

METRICS = f""", win(window_mins) AS (VALUES (60), (1440), (10080)),
r AS (SELECT ev.*, window_mins FROM ev JOIN win ON event_time <= TIMESTAMP '{AS_OF}'
        AND event_time >= TIMESTAMP '{AS_OF}' - to_minutes(window_mins)),
agg AS (SELECT app_id, window_mins, count(*) AS n, count(*) FILTER (event_name = 'error') AS errors,
               coalesce(sum(revenue), 0) AS revenue, count(DISTINCT device_id) AS devices FROM r GROUP BY 1, 2),
lat AS (SELECT app_id, window_mins, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99
        FROM r WHERE event_name = 'click' GROUP BY 1, 2),
dau AS (SELECT app_id, count(DISTINCT user_id) AS dau FROM ev WHERE event_name = 'view'
        AND event_time >= date_trunc('day', TIMESTAMP '{AS_OF}') AND event_time <= TIMESTAMP '{AS_OF}' GROUP BY 1),
metrics AS (
  SELECT app_id, window_mins, 'event_count' AS metric, n::DOUBLE AS value FROM agg
  UNION ALL SELECT app_id, window_mins, 'event_rate', n / window_mins FROM agg
  UNION ALL SELECT app_id, window_mins, 'error_rate', 100.0 * errors / n FROM agg
  UNION ALL SELECT app_id, window_mins, 'error_fraction', errors / n FROM agg
  UNION ALL SELECT app_id, window_mins, 'active_users', devices FROM agg
  UNION ALL SELECT app_id, window_mins, 'revenue_total', revenue FROM agg
  UNION ALL SELECT app_id, window_mins, 'p95_latency', p95 FROM lat
  UNION ALL SELECT app_id, window_mins, 'p99_latency', p99 FROM lat
  UNION ALL SELECT app_id, window_mins, 'dau', dau FROM dau CROSS JOIN win)"""


@query("alert_metrics", EV + METRICS + """
SELECT app_id, window_mins::BIGINT AS window_mins, metric, round(value, 6) AS value FROM metrics""")
def alert_metrics(events, spark, sf_dir):
    return alerts.alert_metrics(events, WINDOWS, AS_OF, V)


@query("alert_session_metrics", EV + sessions_cte(1800) + f"""
, win(window_mins) AS (VALUES (60), (1440), (10080)),
r AS (SELECT s.*, window_mins FROM summary s JOIN win ON started_at <= TIMESTAMP '{AS_OF}'
        AND started_at >= TIMESTAMP '{AS_OF}' - to_minutes(window_mins)),
agg AS (SELECT app_id, window_mins, count(*) AS n, count(*) FILTER (event_count = 1) AS b FROM r GROUP BY 1, 2)
SELECT app_id, window_mins::BIGINT AS window_mins, 'session_count' AS metric, n::DOUBLE AS value FROM agg
UNION ALL SELECT app_id, window_mins, 'bounce_rate', round(b / n, 6) FROM agg""")
def alert_session_metrics(events, spark, sf_dir):
    found = alerts.alert_metrics(
        events, WINDOWS, AS_OF, V, sessions=sessions.session_summaries(events)
    )
    return found.filter(F.col("metric").isin("session_count", "bounce_rate"))


RECENT = EV.replace("FROM raw\n)", f"""FROM raw WHERE ts <= TIMESTAMP '{AS_OF}' AND ts >= TIMESTAMP '{AS_OF}' - to_minutes(10080)
)""")


@query("alert_funnel_rate", RECENT + levels(["signup", "click", "purchase"], 604800) + """
SELECT app_id, 10080::BIGINT AS window_mins, 'funnel_conversion_rate' AS metric,
       round(count(*) FILTER (level >= 3) / count(*) FILTER (level >= 1), 6) AS value FROM levels GROUP BY 1""")
def alert_funnel_rate(events, spark, sf_dir):
    found = alerts.alert_metrics(events, [10080], AS_OF, V, funnel_steps=["signup", "click", "purchase"])
    return found.filter(F.col("metric") == "funnel_conversion_rate")


FIRED = METRICS + """, rules(rule_id, app_id, metric_name, condition, threshold, window_mins) AS (VALUES
 ('r1', 'app_0', 'event_count', 'gt', 10, 1440), ('r2', 'app_0', 'event_count', 'lt', 10, 60),
 ('r3', 'app_1', 'error_rate', '>=', 15, 10080), ('r4', 'app_1', 'p99_latency', '>', 1, 10080),
 ('r5', 'app_2', 'dau', 'gte', 1, 60), ('r6', 'app_2', 'active_users', 'lte', 100000, 1440),
 ('r7', 'app_2', 'revenue_total', 'eq', -1, 1440),
 ('r9', 'app_9', 'event_count', '=', 0, 60), ('r10', 'app_9', 'error_rate', 'gte', 0, 60)),
judged AS (SELECT rules.*, coalesce(value, CASE WHEN metric_name IN ('event_count', 'event_rate', 'dau', 'active_users',
             'session_count', 'revenue_total') THEN 0 END) AS val
  FROM rules LEFT JOIN metrics m ON m.app_id = rules.app_id AND m.metric = metric_name AND m.window_mins = rules.window_mins),
fired AS (SELECT * FROM judged WHERE CASE WHEN condition IN ('gt', '>') THEN val > threshold
  WHEN condition IN ('lt', '<') THEN val < threshold WHEN condition IN ('eq', '=') THEN val = threshold
  WHEN condition IN ('gte', '>=') THEN val >= threshold WHEN condition IN ('lte', '<=') THEN val <= threshold END)"""


@query("evaluate_alerts", EV + FIRED + f"""
SELECT rule_id, app_id, metric_name, window_mins::BIGINT AS window_mins, condition, threshold::DOUBLE AS threshold,
       round(val, 6) AS value, TIMESTAMP '{AS_OF}' AS fired_at FROM fired""")
def evaluate_alerts(events, spark, sf_dir):
    return alerts.evaluate_alerts(
        spark.sql(RULES), alerts.alert_metrics(events, WINDOWS, AS_OF, V), AS_OF
    )


@query("alert_minutes", EV + """
SELECT app_id, date_trunc('minute', event_time) + INTERVAL 1 MINUTE AS minute, count(*) AS n,
       count(*) FILTER (event_name = 'error') AS errors, round(coalesce(sum(revenue), 0), 4) AS revenue,
       count(DISTINCT device_id) AS devices, count(DISTINCT user_id) FILTER (event_name = 'view') AS opened,
       quantile_disc(value, 0.95) FILTER (event_name = 'click') AS p95_latency
FROM ev GROUP BY 1, 2""")
def alert_minutes(events, spark, sf_dir):
    """Minute rows, with what their sketches say of a single minute."""
    return alerts.minute_metrics(events, V).select(
        "app_id", F.col("minute").cast("timestamp_ntz").alias("minute"), "n", "errors", F.round("revenue", 4).alias("revenue"),
        F.hll_sketch_estimate("devices").alias("devices"), F.hll_sketch_estimate("opened").alias("opened"),
        alerts.latency_quantile(F.col("latency"), 0.95).alias("p95_latency"))


EVERY_METRIC = """SELECT concat_ws('/', app_id, metric_name, window_mins) AS id, app_id, metric_name, 'gt' AS condition,
  0D AS threshold, window_mins, true AS active
FROM (SELECT explode(array('app_0', 'app_1', 'app_2', 'app_9')) AS app_id)
  LATERAL VIEW explode(array('event_count', 'event_rate', 'error_rate', 'error_fraction', 'active_users', 'revenue_total',
    'p95_latency', 'p99_latency', 'dau', 'session_count', 'bounce_rate')) AS metric_name
  LATERAL VIEW explode(array(60, 1440, 10080)) AS window_mins"""


@query("alert_rule_values", EV + sessions_cte(1800) + METRICS + f""",
sr AS (SELECT s.*, window_mins FROM summary s JOIN win ON started_at <= TIMESTAMP '{AS_OF}'
        AND started_at >= TIMESTAMP '{AS_OF}' - to_minutes(window_mins)),
sessions AS (SELECT app_id, window_mins, count(*) AS n, count(*) FILTER (event_count = 1) AS b FROM sr GROUP BY 1, 2),
every AS (SELECT * FROM metrics UNION ALL SELECT app_id, window_mins, 'session_count', n FROM sessions
  UNION ALL SELECT app_id, window_mins, 'bounce_rate', b / n FROM sessions),
asked AS (SELECT app_id, metric, window_mins FROM (VALUES ('app_0'), ('app_1'), ('app_2'), ('app_9')) a(app_id), win,
  (VALUES ('event_count'), ('event_rate'), ('error_rate'), ('error_fraction'), ('active_users'), ('revenue_total'),
    ('p95_latency'), ('p99_latency'), ('dau'), ('session_count'), ('bounce_rate')) m(metric))
SELECT app_id || '/' || metric || '/' || window_mins AS rule_id, round(coalesce(value, CASE WHEN metric IN ('event_count', 'event_rate', 'dau',
  'active_users', 'session_count', 'revenue_total') THEN 0 END), 6) AS value
FROM asked LEFT JOIN every USING (app_id, metric, window_mins)""")
def alert_rule_values(events, spark, sf_dir):
    """Every metric of every window, merged from minute rows."""
    minutes = alerts.minute_metrics(events, V).unionByName(alerts.session_minutes(sessions.session_summaries(events)))
    return alerts.rule_values(spark.sql(EVERY_METRIC), minutes, F.lit(AS_OF).cast("timestamp")).select(
        "rule_id", F.round("value", 6).alias("value"))


@query("last_fired", EV + FIRED + f"""
, ids(id) AS (VALUES ('r1'), ('r2'), ('r3'), ('r4'), ('r5'), ('r6'), ('r7'), ('r8'), ('r9'), ('r10'))
SELECT id, CASE WHEN id IN (SELECT rule_id FROM fired) THEN TIMESTAMP '{AS_OF}' END AS last_fired_at FROM ids""")
def last_fired(events, spark, sf_dir):
    fired = alerts.evaluate_alerts(
        spark.sql(RULES), alerts.alert_metrics(events, WINDOWS, AS_OF, V), AS_OF
    )
    return alerts.last_fired(spark.sql(RULES), fired).select("id", "last_fired_at")


def cooldown_sql(rows: str, keys: str) -> str:
    """Greedy selection of sent rows by recursion; ``rows`` yields keys, t and sec."""
    on = " AND ".join(f"r.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    return EV.replace("WITH raw", "WITH RECURSIVE raw") + f"""
, rows_in AS ({rows}),
succ AS (SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, s.sec, min(r.sec) AS nxt
         FROM (SELECT DISTINCT {keys}, sec, wait FROM rows_in) s JOIN rows_in r ON {on} AND r.sec >= s.sec + s.wait
         GROUP BY {', '.join('s.' + k.strip() for k in keys.split(','))}, s.sec),
sent AS (SELECT {keys}, min(sec) AS sec FROM rows_in GROUP BY {keys}
         UNION ALL SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, r.nxt FROM sent s JOIN succ r ON {on} AND r.sec = s.sec)"""


@query("apply_cooldown", cooldown_sql(
    "SELECT app_id AS rule_id, event_time AS t, epoch_us(event_time) // 1000000 AS sec, 7200 AS wait FROM ev WHERE event_name = 'error'",
    "rule_id") + """
SELECT rule_id, min(t) AS fired_at FROM rows_in JOIN sent USING (rule_id, sec) GROUP BY rule_id, sec""")
def apply_cooldown(events, spark, sf_dir):
    fired = events.filter(V.is_error()).select(
        F.col("app_id").alias("rule_id"), F.col("event_time").alias("fired_at")
    )
    return alerts.apply_cooldown(fired, 7200)


CAMPAIGNS = """SELECT id, app_id, id AS name, 'event' AS trigger_type, map('topic', topic) AS trigger_conf, channel,
  map('to', 'x') AS channel_conf, active, segment_id, cooldown_seconds
FROM VALUES ('c1', 'app_0', 'purchase', 'push', true, NULL, 86400), ('c2', 'app_1', 'signup', 'email', true, NULL, 1800),
  ('c3', 'app_2', 'view', 'push', true, 'buyers', 172800), ('c4', 'app_2', 'view', 'push', false, NULL, 1800)
  AS t(id, app_id, topic, channel, active, segment_id, cooldown_seconds)"""

TRIGGERED = cooldown_sql("""
  SELECT id AS campaign_id, user_id, e.app_id, event_name, channel, event_time AS t,
         epoch_us(event_time) // 1000000 AS sec, wait FROM ev e
  JOIN (VALUES ('c1', 'app_0', 'purchase', 'push', 86400), ('c2', 'app_1', 'signup', 'email', 1800),
               ('c3', 'app_2', 'view', 'push', 172800)) c(id, app_id, topic, channel, wait)
    ON c.app_id = e.app_id AND c.topic = e.event_name
  WHERE id <> 'c3' OR user_id IN (SELECT user_id FROM ev GROUP BY app_id, user_id
     HAVING bool_or(event_name = 'purchase') AND bool_or(platform = 'ios'))""", "campaign_id, user_id")


def triggered(events, spark):
    buyers = users.segment_users(events, ["purchase"], [PropertyFilter("platform", "eq", "ios")])
    members = buyers.withColumn("segment_id", F.lit("buyers"))
    return campaigns.campaign_triggers(events, spark.sql(CAMPAIGNS), members)


@query("campaign_triggers", TRIGGERED + """
SELECT campaign_id, user_id, app_id, event_name, channel, min(t) AS event_time
FROM rows_in JOIN sent USING (campaign_id, user_id, sec) GROUP BY 1, 2, 3, 4, 5, sec""")
def campaign_triggers(events, spark, sf_dir):
    return triggered(events, spark).select(
        "campaign_id", "user_id", "app_id", "event_name", "channel", "event_time"
    )


@query("delivery_outbox", TRIGGERED + """
, d AS (SELECT campaign_id, user_id, app_id, event_name, channel, min(t) AS created_at
        FROM rows_in JOIN sent USING (campaign_id, user_id, sec) GROUP BY 1, 2, 3, 4, 5, sec)
SELECT sha256(campaign_id || '|' || user_id || '|' || (epoch_us(created_at) // 1000)) AS id, campaign_id, app_id, user_id, channel,
  '{"campaign_id":"' || campaign_id || '","app_id":"' || app_id || '","user_id":"' || user_id || '","event_name":"' ||
  event_name || '","event_time_ms":' || (epoch_us(created_at) // 1000) || '}' AS payload, 'pending' AS status, created_at FROM d""")
def delivery_outbox(events, spark, sf_dir):
    return campaigns.delivery_outbox(triggered(events, spark))


CONTACTS = "SELECT * FROM VALUES ('app_0', 'email', 'ops@zero.example'), ('app_0', 'email', 'on-call@zero.example'), " \
    "('app_2', 'email', 'two@two.example'), ('app_1', 'webhook', 'https://one.example/hook') AS t(app_id, channel, recipient)"


@query("alert_outbox", EV + FIRED + f"""
, contacts(app_id, recipient) AS (VALUES ('app_0', 'ops@zero.example'), ('app_0', 'on-call@zero.example'), ('app_2', 'two@two.example'))
SELECT sha256(rule_id || '|email|' || coalesce(recipient, '') || '|' || epoch_ms(TIMESTAMP '{AS_OF}')) AS id, rule_id, app_id,
  'email' AS channel, coalesce(recipient, '') AS recipient, round(val, 6) AS value, epoch_ms(TIMESTAMP '{AS_OF}') AS fired_at_ms,
  CASE WHEN recipient IS NULL THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN recipient IS NULL THEN 'no recipient' ELSE '' END AS error, TIMESTAMP '{AS_OF}' AS created_at
FROM fired LEFT JOIN contacts USING (app_id)""")
def alert_outbox(events, spark, sf_dir):
    fired = alerts.evaluate_alerts(spark.sql(RULES), alerts.alert_metrics(events, WINDOWS, AS_OF, V), AS_OF)
    rows = campaigns.alert_outbox(fired, spark.sql(RULES), spark.sql(CONTACTS))
    body = F.from_json("payload", "value double, fired_at_ms bigint")
    return rows.withColumn("value", body["value"]).withColumn("fired_at_ms", body["fired_at_ms"]).drop("payload")


@query("campaign_stats", EV + """
, d AS (SELECT campaign_id, CASE event_name WHEN 'signup' THEN 'sent' WHEN 'click' THEN 'clicked' WHEN 'view' THEN 'opened'
          WHEN 'purchase' THEN 'delivered' ELSE 'failed' END AS status FROM ev),
c AS (SELECT campaign_id, count(*) FILTER (status = 'sent') AS sent, count(*) FILTER (status = 'delivered') AS delivered,
        count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'opened') AS opened,
        count(*) FILTER (status = 'clicked') AS clicked FROM d GROUP BY 1)
SELECT *, round(100.0 * delivered / sent, 6) AS delivery_pct, round(100.0 * opened / sent, 6) AS open_pct,
       round(100.0 * clicked / sent, 6) AS click_pct FROM c""")
def campaign_stats(events, spark, sf_dir):
    status = (
        F.when(F.col("event_name") == "signup", "sent").when(F.col("event_name") == "click", "clicked")
        .when(F.col("event_name") == "view", "opened").when(F.col("event_name") == "purchase", "delivered")
        .otherwise("failed")
    )
    return campaigns.campaign_stats(events.select("campaign_id", status.alias("status")))


def _funnel_triggers() -> str:
    """Conversions of app_0 and drop-offs of app_2, then the cooldown by recursion."""
    picked = cooldown_sql("""
      SELECT 'g0' AS campaign_id, user_id, app_id, 'goal_reached' AS event_name, make_timestamp(e * 1000) AS t,
             e // 1000 AS sec, 3600 AS wait FROM conv WHERE app_id = 'app_0'
      UNION ALL
      SELECT 'd2', user_id, app_id, 'funnel_drop', last_entered_at, epoch_us(last_entered_at) // 1000000, 3600
      FROM dropped WHERE app_id = 'app_2'""", "campaign_id, user_id")
    after = picked.split("FROM raw\n)", 1)[1]
    return CONVERSIONS + f", dropped AS ({ORACLES['funnel_dropoffs']})" + after


@query("funnel_campaign_triggers", _funnel_triggers() + """
SELECT campaign_id, user_id, app_id, event_name, min(t) AS event_time
FROM rows_in JOIN sent USING (campaign_id, user_id, sec) GROUP BY 1, 2, 3, 4, sec""")
def funnel_campaign_triggers(events, spark, sf_dir):
    """Goal-reached and funnel-drop triggers through the same matching and cooldown."""
    rows = campaigns.conversion_triggers(
        funnels.funnel_conversions(events, definitions(spark))
    ).unionByName(campaigns.dropoff_triggers(
        funnels.funnel_dropoffs(events, definitions(spark), "2024-01-31 00:00:00")
    ))
    active = spark.sql("""SELECT id, app_id, id AS name, topic AS trigger_type, map('topic', topic) AS trigger_conf,
      'push' AS channel, map('to', 'x') AS channel_conf, true AS active, CAST(NULL AS STRING) AS segment_id, 3600 AS cooldown_seconds
      FROM VALUES ('g0', 'app_0', 'goal_reached'), ('d2', 'app_2', 'funnel_drop') AS t(id, app_id, topic)""")
    return campaigns.campaign_triggers(rows, active).select(
        "campaign_id", "user_id", "app_id", "event_name", "event_time"
    )


@query("scheduled_notifications", EV + """
SELECT 'weekly' AS campaign_id, app_id, user_id, 'scheduled' AS event_name, 'email' AS channel,
       TIMESTAMP '2024-01-31' AS event_time
FROM ev WHERE app_id = 'app_1' GROUP BY app_id, user_id HAVING bool_or(event_name = 'purchase')""")
def scheduled_notifications(events, spark, sf_dir):
    weekly = spark.sql("""SELECT 'weekly' AS id, 'app_1' AS app_id, 'weekly' AS name, 'scheduled' AS trigger_type,
      map('topic', '') AS trigger_conf, 'email' AS channel, map('to', 'x') AS channel_conf, true AS active,
      'buyers' AS segment_id, 0 AS cooldown_seconds""")
    members = users.segment_users(events, ["purchase"]).withColumn("segment_id", F.lit("buyers"))
    return campaigns.scheduled_notifications(weekly, members, "2024-01-31")
