"""Counts, breakdowns, the live view and active users."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickspan.catalogue.base import EV, query, sessions_cte
from clickspan.functions.text import PropertyFilter
from clickspan.operators import active, counts
from clickspan.sources.testdata import TEST_VOCABULARY as V

COLUMNS = ("app_id", "event_id", "user_id", "device_id", "event_name", "event_time", "session_id",
           "country_code", "platform", "app_version", "os_family", "browser", "city", "revenue",
           "event_date")


@query("read_events", EV + f" SELECT {', '.join(COLUMNS)} FROM ev")
def read_events(events, spark, sf_dir):
    return events.select(*COLUMNS)


@query("event_count_daily", EV + """
SELECT app_id, date_trunc('day', event_time)::TIMESTAMP AS bucket, count(*) AS event_count FROM ev GROUP BY 1, 2""")
def event_count_daily(events, spark, sf_dir):
    return counts.event_count(events)


@query("event_count_weekly", EV + """
SELECT app_id, (event_date - CAST(dayofweek(event_date) AS INTEGER))::TIMESTAMP AS bucket, count(*) AS event_count
FROM ev WHERE event_name = 'purchase' GROUP BY 1, 2""")
def event_count_weekly(events, spark, sf_dir):
    return counts.event_count(events, ["purchase"], "week")


@query("event_count_monthly", EV + """
SELECT app_id, date_trunc('month', event_time)::TIMESTAMP AS bucket, count(*) AS event_count
FROM ev WHERE event_name IN ('view', 'click') GROUP BY 1, 2""")
def event_count_monthly(events, spark, sf_dir):
    return counts.event_count(events, ["view", "click"], "month")


@query("event_count_grouped", EV + """
SELECT app_id, date_trunc('hour', event_time)::TIMESTAMP AS bucket, platform, plan, count(*) AS event_count
FROM ev WHERE plan <> 'free' GROUP BY 1, 2, 3, 4""")
def event_count_grouped(events, spark, sf_dir):
    keep = [PropertyFilter("plan", "neq", "free")]
    return counts.event_count(events, None, "hour", ["platform", "plan"], keep)


@query("event_total", EV + " SELECT app_id, count(*) AS total FROM ev GROUP BY 1")
def event_total(events, spark, sf_dir):
    return counts.event_total(counts.event_count(events, granularity="minute"))


@query("event_overlay", EV + """
SELECT app_id, date_trunc('hour', event_time)::TIMESTAMP AS bucket,
       nullif(count(*) FILTER (event_name = 'signup'), 0) AS signup,
       nullif(count(*) FILTER (event_name = 'purchase'), 0) AS purchase
FROM ev WHERE event_name IN ('signup', 'purchase') GROUP BY 1, 2""")
def event_overlay(events, spark, sf_dir):
    return counts.event_overlay(events, ["signup", "purchase"], "hour")


@query("event_breakdown", EV + """
, r AS (SELECT app_id, user_id, event_time, app_version AS property_value FROM ev WHERE event_name = 'click'),
top AS (
  SELECT app_id, property_value FROM (
    SELECT app_id, property_value, row_number() OVER (PARTITION BY app_id ORDER BY count(*) DESC, property_value) AS rk
    FROM r GROUP BY 1, 2) WHERE rk <= 3),
pts AS (
  SELECT app_id, date_trunc('day', event_time)::TIMESTAMP AS bucket, property_value, count(*) AS event_count,
         count(DISTINCT user_id) AS unique_users
  FROM r JOIN top USING (app_id, property_value) GROUP BY 1, 2, 3)
SELECT *, round(100.0 * event_count / sum(event_count) OVER (PARTITION BY app_id, bucket), 6) AS percentage FROM pts""")
def event_breakdown(events, spark, sf_dir):
    return counts.event_breakdown(events, "click", "app_version", "day", 3)


@query("event_breakdown_property", EV + """
, r AS (SELECT app_id, user_id, event_time, plan AS property_value FROM ev WHERE event_name = 'view' AND plan <> ''),
pts AS (
  SELECT app_id, (event_date_(event_time))::TIMESTAMP AS bucket, property_value, count(*) AS event_count,
         count(DISTINCT user_id) AS unique_users FROM r GROUP BY 1, 2, 3)
SELECT *, round(100.0 * event_count / sum(event_count) OVER (PARTITION BY app_id, bucket), 6) AS percentage FROM pts
""".replace("event_date_(event_time)", "CAST(event_time AS DATE) - CAST(dayofweek(event_time) AS INTEGER)"))
def event_breakdown_property(events, spark, sf_dir):
    return counts.event_breakdown(events, "view", "plan", "week")


@query("realtime", EV + """
, r AS (SELECT * FROM ev WHERE event_time BETWEEN TIMESTAMP '2024-01-15 00:00:00' AND TIMESTAMP '2024-01-15 12:00:00'),
u AS (SELECT app_id, count(*) AS n, count(DISTINCT user_id) AS active_users FROM r GROUP BY 1),
t AS (SELECT app_id, event_name, count(*) AS event_count,
             row_number() OVER (PARTITION BY app_id ORDER BY count(*) DESC, event_name) AS rank
      FROM r GROUP BY 1, 2)
SELECT app_id, round(n / 720.0, 6) AS events_per_minute, active_users, rank, event_name, event_count
FROM u JOIN t USING (app_id) WHERE rank <= 10""")
def realtime(events, spark, sf_dir):
    return counts.realtime(events, "2024-01-15 12:00:00", "12 hours")


@query("user_timeline", EV + """
SELECT app_id, user_id, event_time, event_id, event_name, platform, country_code, session_id,
       row_number() OVER (PARTITION BY app_id, user_id ORDER BY event_time DESC, event_id DESC) AS position
FROM ev QUALIFY position <= 50""")
def user_timeline(events, spark, sf_dir):
    return counts.user_timeline(events, limit=50)


ACTIVE = """SELECT app_id, {bucket} AS bucket, count(DISTINCT user_id) AS active_users
FROM ev WHERE event_name = 'view' GROUP BY 1, 2"""
SUNDAY = "(event_date - CAST(dayofweek(event_date) AS INTEGER))::TIMESTAMP"


@query("active_users_daily", EV + ACTIVE.format(bucket="event_date::TIMESTAMP"))
def active_users_daily(events, spark, sf_dir):
    return active.active_users(events, "day", V)


@query("active_users_weekly", EV + ACTIVE.format(bucket=SUNDAY))
def active_users_weekly(events, spark, sf_dir):
    return active.active_users(events, "week", V, device_fallback=True)


@query("active_users_approx", EV + f"""
SELECT app_id, bucket, true AS within_bound FROM ({ACTIVE.format(bucket="event_date::TIMESTAMP")})""")
def active_users_approx(events, spark, sf_dir):
    """The sketch stays within 10 % of the exact count (its standard error is below 3 %)."""
    exact = active.active_users(events, "day", V)
    guessed = active.active_users(events, "day", V, approximate=True).withColumnRenamed("active_users", "_guess")
    near = F.abs(F.col("_guess") - F.col("active_users")) <= F.ceil(0.1 * F.col("active_users"))
    return exact.join(guessed, ["app_id", "bucket"], "full").select("app_id", "bucket", F.coalesce(near, F.lit(False)).alias("within_bound"))


@query("active_users_kpis", EV + f"""
, s AS ({ACTIVE.format(bucket="event_date::TIMESTAMP")}),
l AS (SELECT *, lag(active_users, 7) OVER (PARTITION BY app_id ORDER BY bucket) AS past FROM s)
SELECT app_id, arg_max(active_users, bucket) AS current,
       round(max(CASE WHEN bucket = last AND past > 0 THEN 100.0 * (active_users - past) / past END), 6) AS change_pct,
       max(active_users) AS peak, CAST(round(avg(active_users)) AS BIGINT) AS average
FROM (SELECT *, max(bucket) OVER (PARTITION BY app_id) AS last FROM l) GROUP BY app_id""")
def active_users_kpis(events, spark, sf_dir):
    return active.active_users_kpis(active.active_users(events, "day", V))


@query("dau_wau_mau", EV + """
, ud AS (SELECT DISTINCT app_id, user_id, event_date AS d FROM ev),
days AS (SELECT app_id, unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM ud GROUP BY app_id)
SELECT days.app_id, days.day,
       count(DISTINCT CASE WHEN d = day THEN user_id END) AS dau,
       count(DISTINCT CASE WHEN d > day - 7 THEN user_id END) AS wau,
       count(DISTINCT user_id) AS mau
FROM days LEFT JOIN ud ON ud.app_id = days.app_id AND ud.d <= days.day AND ud.d > days.day - 30
GROUP BY 1, 2""")
def dau_wau_mau(events, spark, sf_dir):
    return active.dau_wau_mau(events)


@query("dashboard_kpis", EV + sessions_cte(21600) + """
, n AS (
  SELECT app_id,
    count(*) FILTER (event_date = DATE '2024-01-15') AS events, count(*) FILTER (event_date <> DATE '2024-01-15') AS events0,
    count(DISTINCT user_id) FILTER (event_date = DATE '2024-01-15' AND event_name = 'view') AS dau,
    count(DISTINCT user_id) FILTER (event_date <> DATE '2024-01-15' AND event_name = 'view') AS dau0,
    coalesce(sum(revenue) FILTER (event_date = DATE '2024-01-15'), 0) AS revenue,
    coalesce(sum(revenue) FILTER (event_date <> DATE '2024-01-15'), 0) AS revenue0
  FROM ev WHERE event_date BETWEEN DATE '2024-01-14' AND DATE '2024-01-15' GROUP BY 1),
s AS (SELECT app_id, count(*) FILTER (CAST(started_at AS DATE) = DATE '2024-01-15') AS sessions,
             count(*) FILTER (CAST(started_at AS DATE) = DATE '2024-01-14') AS sessions0 FROM summary GROUP BY 1)
SELECT app_id, events, dau, sessions, round(revenue, 6) AS revenue,
  round(CASE WHEN events0 > 0 THEN 100.0 * (events - events0) / events0 END, 6) AS events_change_pct,
  round(CASE WHEN dau0 > 0 THEN 100.0 * (dau - dau0) / dau0 END, 6) AS dau_change_pct,
  round(CASE WHEN sessions0 > 0 THEN 100.0 * (sessions - sessions0) / sessions0 END, 6) AS sessions_change_pct,
  round(CASE WHEN revenue0 > 0 THEN 100.0 * (revenue - revenue0) / revenue0 END, 6) AS revenue_change_pct
FROM n JOIN s USING (app_id)""")
def dashboard_kpis(events, spark, sf_dir):
    """With a gap of six hours many sessions run over midnight; the oracle builds them from all events."""
    return active.dashboard_kpis(events, "2024-01-15 23:59:59", V, gap="6 hours")
