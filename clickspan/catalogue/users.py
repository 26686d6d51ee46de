"""Profiles, segments, cohorts and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickspan.catalogue.base import EV, query, sessions_cte
from clickspan.functions.text import PropertyFilter
from clickspan.operators import paths, sessions, users
from clickspan.sources.testdata import TEST_VOCABULARY as V


@query("user_profile", EV + """
SELECT app_id, user_id, min(event_time) AS first_seen, max(event_time) AS last_seen, count(*) AS total_events,
       count(DISTINCT session_id) AS total_sessions, round(coalesce(sum(revenue), 0), 6) AS total_revenue,
       arg_max(country_code, event_time) AS last_country, arg_max(city, event_time) AS last_city
FROM ev GROUP BY 1, 2""")
def user_profile(events, spark, sf_dir):
    return users.user_profile(events, vocabulary=V)


@query("user_top_events", EV + """
SELECT app_id, user_id, event_name, count(*) AS event_count,
       row_number() OVER (PARTITION BY app_id, user_id ORDER BY count(*) DESC, event_name) AS rank
FROM ev GROUP BY 1, 2, 3 QUALIFY rank <= 3""")
def user_top_events(events, spark, sf_dir):
    return users.user_top_events(events, top_n=3)


@query("user_features", EV + """
SELECT app_id, user_id, count(*) AS event_count,
       count(DISTINCT event_date) FILTER (event_date > DATE '2024-01-18') AS days_active_last_7,
       min(event_time) AS first_seen, max(event_time) AS last_seen, arg_max(platform, event_time) AS platform
FROM ev WHERE event_time <= TIMESTAMP '2024-01-25 12:00:00' GROUP BY 1, 2""")
def user_features(events, spark, sf_dir):
    return users.user_features(events, "2024-01-25 12:00:00")


HAS = ["signup", "purchase", "error"]
SEGMENT = """, s AS (
  SELECT app_id, user_id FROM ev GROUP BY 1, 2
  HAVING bool_or(event_name = 'signup') AND bool_or(event_name = 'purchase') AND bool_or(event_name = 'error')
     AND bool_or(plan <> 'free' AND source ILIKE '%GOO%' AND country_code <> 'US'))"""
FILTERS = [PropertyFilter("plan", "neq", "free"), PropertyFilter("utm_source", "contains", "GOO"),
           PropertyFilter("country", "neq", "US")]


@query("segment_users", EV + SEGMENT + " SELECT * FROM s")
def segment_users(events, spark, sf_dir):
    return users.segment_users(events, HAS, FILTERS)


@query("segment_count", EV + SEGMENT + " SELECT app_id, count(*) AS matched_users FROM s GROUP BY 1")
def segment_count(events, spark, sf_dir):
    return users.segment_count(events, HAS, FILTERS)


@query("cohort_recompute", EV + """
SELECT 'buyers' AS cohort_id, 'app_0' AS app_id, count(DISTINCT user_id) AS user_count, TIMESTAMP '2024-01-31' AS last_computed_at
FROM ev WHERE app_id = 'app_0' AND event_name = 'purchase' AND revenue > 100
UNION ALL
SELECT 'ios', 'app_1', count(DISTINCT user_id), TIMESTAMP '2024-01-31' FROM ev WHERE app_id = 'app_1' AND platform = 'ios'
UNION ALL SELECT 'broken', 'app_2', 17, NULL""")
def cohort_recompute(events, spark, sf_dir):
    cohorts = [
        users.Cohort("buyers", "app_0", "event_name = 'purchase' AND revenue > 100"),
        users.Cohort("ios", "app_1", "platform = 'ios'"),
        users.Cohort("broken", "app_2", "no_such_column > 1", 17),
    ]
    return users.cohort_recompute(events, cohorts, "2024-01-31")


@query("cohort_templates", EV + """
, f AS (SELECT app_id, user_id, count(*) AS event_count,
               count(DISTINCT event_date) FILTER (event_date > DATE '2024-01-23') AS days_active_last_7,
               min(event_time) AS first_seen FROM ev GROUP BY 1, 2)
SELECT 'power' AS cohort_id, 'app_0' AS app_id, count(*) AS user_count, TIMESTAMP '2024-01-31' AS last_computed_at
FROM f WHERE app_id = 'app_0' AND event_count > 20 AND days_active_last_7 >= 5
UNION ALL
SELECT 'late', 'app_1', count(*), TIMESTAMP '2024-01-31' FROM f WHERE app_id = 'app_1' AND first_seen >= TIMESTAMP '2024-01-02'""")
def cohort_templates(events, spark, sf_dir):
    cohorts = [
        users.Cohort("power", "app_0", "event_count > 20 AND days_active_last_7 >= 5"),
        users.Cohort("late", "app_1", "first_seen >= TIMESTAMP '2024-01-02'"),
    ]
    return users.cohort_recompute(users.user_features(events, "2024-01-30 23:59:59"), cohorts, "2024-01-31")


PATHS = sessions_cte(86400) + """
, named AS (SELECT app_id, session_id, list(event_name ORDER BY event_time, event_id) AS names FROM located GROUP BY 1, 2),
lists AS (SELECT app_id, session_id, list_slice(names, list_position(names, 'signup'), list_position(names, 'signup') + 3) AS path
          FROM named WHERE list_contains(names, 'signup'))"""
COUNTED = """
, counted AS (SELECT app_id, path, count(*) AS session_count FROM lists GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY session_count DESC, path) AS rank,
                  sum(session_count) OVER (PARTITION BY app_id) AS total FROM counted)"""


def with_sessions(events):
    return sessions.sessionize(events, "24 hours")


@query("paths", EV + PATHS + COUNTED + """
SELECT app_id, array_to_string(path, '>') AS path, session_count, rank, total::BIGINT AS total_sessions,
       round(100.0 * session_count / total, 6) AS pct FROM ranked WHERE rank <= 10""")
def top_paths(events, spark, sf_dir):
    found = paths.paths(with_sessions(events), "signup", max_steps=4)
    return found.withColumn("path", F.array_join("path", ">"))


@query("paths_to_event", EV + PATHS.replace("FROM located", "FROM located WHERE country_code <> 'US'") + """
, cut AS (SELECT app_id, list_slice(path, 1, 1 + list_position(list_slice(path, 2, 4), 'purchase')) AS path
          FROM lists WHERE list_contains(list_slice(path, 2, 4), 'purchase'))""" + COUNTED.replace("FROM lists", "FROM cut") + """
SELECT app_id, array_to_string(path, '>') AS path, session_count, rank, total::BIGINT AS total_sessions,
       round(100.0 * session_count / total, 6) AS pct FROM ranked WHERE rank <= 10""")
def paths_to_event(events, spark, sf_dir):
    found = paths.paths(with_sessions(events), "signup", max_steps=4, end_event="purchase",
                        filters=[PropertyFilter("country", "neq", "US")])
    return found.withColumn("path", F.array_join("path", ">"))


@query("path_nodes", EV + PATHS + COUNTED + """
, steps AS (SELECT app_id, rank, path, session_count, round(100.0 * session_count / total, 6) AS pct,
                   unnest(generate_series(1, len(path))) AS step FROM ranked WHERE rank <= 10),
hit AS (SELECT s.*, (SELECT sum(c.session_count) FROM counted c WHERE c.app_id = s.app_id
                       AND len(c.path) >= s.step AND list_slice(c.path, 1, s.step) = list_slice(s.path, 1, s.step)) AS reached
        FROM steps s)
SELECT app_id, rank, step, path[step] AS event_name, session_count, pct,
       round(coalesce(1 - lead(reached) OVER (PARTITION BY app_id, rank ORDER BY step) / reached, 0), 6) AS drop_off FROM hit""")
def path_nodes(events, spark, sf_dir):
    return paths.path_nodes(with_sessions(events), "signup", max_steps=4)


@query("session_paths", EV + """
, r AS (SELECT *, row_number() OVER (PARTITION BY app_id, session_id ORDER BY event_time, event_id) - 1 AS n FROM ev)
SELECT app_id, session_id, n // 2 AS part, string_agg(event_name, '>' ORDER BY n) AS path FROM r GROUP BY 1, 2, 3""")
def session_paths(events, spark, sf_dir):
    return paths.session_paths(events, part_size=2).withColumn("path", F.array_join("path", ">"))
