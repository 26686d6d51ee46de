"""Sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickspan.catalogue.base import EV, query, sessions_cte
from clickspan.operators import sessions
from clickspan.sources.testdata import TEST_VOCABULARY as V

GAPS = {"30m": 1800, "6h": 21600, "24h": 86400}

for label, gap in GAPS.items():
    @query(f"sessionize_{label}", EV + sessions_cte(gap) + """
SELECT app_id, device_id, event_id, event_time, session_id, session_start FROM located""")
    def sessionize(events, spark, sf_dir, gap=gap):
        return sessions.sessionize(events, gap).select(
            "app_id", "device_id", "event_id", "event_time", "session_id", "session_start"
        )


SUMMARY = """SELECT app_id, device_id, session_id, user_id, country_code, platform, started_at, ended_at,
  duration_s, event_count, screen_count, entry_screen, exit_screen, 'timeout' AS exit_reason FROM summary"""


@query("session_summaries_30m", EV + sessions_cte(1800) + SUMMARY)
def session_summaries_30m(events, spark, sf_dir):
    return sessions.session_summaries(events, vocabulary=V)


@query("session_summaries_24h", EV + sessions_cte(86400) + SUMMARY)
def session_summaries_24h(events, spark, sf_dir):
    return sessions.session_summaries(events, "24 hours", vocabulary=V)


@query("session_screens", EV + sessions_cte(86400) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY app_id, session_id ORDER BY event_time, event_id) - 1 AS n
        FROM located WHERE event_name = 'view')
SELECT app_id, session_id, n // 4 AS part, string_agg(screen_name, '>' ORDER BY n) AS screens FROM r GROUP BY 1, 2, 3""")
def session_screens(events, spark, sf_dir):
    found = sessions.session_screens(sessions.sessionize(events, "24 hours"), V, part_size=4)
    return found.withColumn("screens", F.array_join("screens", ">"))


@query("session_event_rows", EV + sessions_cte(21600) + """
, records AS (
  SELECT *, 'session_start' AS event_name, started_at AS event_time, false AS ended FROM summary
  UNION ALL SELECT *, 'session_end', ended_at, true FROM summary)
SELECT app_id, sha256(app_id || '|' || session_id || '|' || event_name) AS event_id, session_id, user_id, device_id, event_name,
       event_time, event_time AS server_time, country_code, platform, '' AS app_version, '' AS os_family, '' AS browser, '' AS city,
       NULL::DOUBLE AS revenue, '' AS campaign_id, '' AS install_source,
       CASE WHEN ended THEN duration_s::VARCHAR END AS duration, CASE WHEN ended THEN event_count::VARCHAR END AS n_events,
       entry_screen, CASE WHEN ended THEN exit_screen END AS exit_screen, CASE WHEN ended THEN 'timeout' END AS exit_reason
FROM records""")
def session_event_rows(events, spark, sf_dir):
    found = sessions.session_event_rows(sessions.session_summaries(events, "6 hours", vocabulary=V))
    props = {"duration": "session_duration_s", "n_events": "event_count", "entry_screen": "entry_screen",
             "exit_screen": "exit_screen", "exit_reason": "exit_reason"}
    return found.select(
        *[c for c in found.columns if c != "props"], *[F.col("props")[key].alias(name) for name, key in props.items()])


@query("session_metrics", EV + sessions_cte(21600) + """
SELECT app_id, round(avg(duration_s), 6) AS avg_duration_s, round(median(duration_s), 6) AS median_duration_s,
       count(*) AS total_sessions, round(avg(event_count), 6) AS avg_events_per_session FROM summary GROUP BY 1""")
def session_metrics(events, spark, sf_dir):
    return sessions.session_metrics(sessions.session_summaries(events, "6 hours"))


@query("bounce_rate", EV + sessions_cte(21600) + """
SELECT app_id, count(*) AS sessions, count(*) FILTER (event_count = 1) AS bounced,
       round(count(*) FILTER (event_count = 1) / count(*), 6) AS bounce_rate FROM summary GROUP BY 1""")
def bounce_rate(events, spark, sf_dir):
    return sessions.bounce_rate(sessions.session_summaries(events, "6 hours"))


@query("session_duration_histogram", EV + sessions_cte(21600) + """
, b(bucket_no, bucket, lo, hi) AS (VALUES (0, '0-30s', -1, 30), (1, '30-60s', 30, 60), (2, '1-2 min', 60, 120),
  (3, '2-5 min', 120, 300), (4, '5-10 min', 300, 600), (5, '10-20 min', 600, 1200), (6, '20-30 min', 1200, 1800),
  (7, '>30 min', 1800, 1000000000)),
apps AS (SELECT DISTINCT app_id FROM summary)
SELECT apps.app_id, bucket_no::BIGINT AS bucket_no, bucket, count(s.session_id) AS sessions
FROM apps CROSS JOIN b LEFT JOIN summary s ON s.app_id = apps.app_id AND duration_s > lo AND duration_s <= hi
GROUP BY 1, 2, 3""")
def session_duration_histogram(events, spark, sf_dir):
    return sessions.session_duration_histogram(sessions.session_summaries(events, "6 hours"))


@query("session_trend", EV + sessions_cte(1800) + """
SELECT app_id, CAST(started_at AS DATE) AS day, count(*) AS sessions, round(avg(duration_s), 6) AS avg_duration_s
FROM summary GROUP BY 1, 2""")
def session_trend(events, spark, sf_dir):
    return sessions.session_trend(sessions.session_summaries(events))
