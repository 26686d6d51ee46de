"""Attribution and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickspan.catalogue.base import EV, query
from clickspan.functions.stats import ERF_A, ERF_P
from clickspan.functions.time import scope
from clickspan.operators import attribution, experiments
from clickspan.sources.testdata import TEST_VOCABULARY as V


@query("user_attribution", EV + """
SELECT app_id, user_id, arg_min(source, event_time) AS first_source, arg_min(medium, event_time) AS first_medium,
       arg_min(campaign, event_time) AS first_campaign, min(event_time) AS first_touch_at,
       arg_max(source, event_time) AS last_source, arg_max(medium, event_time) AS last_medium,
       arg_max(campaign, event_time) AS last_campaign, max(event_time) AS last_touch_at
FROM ev WHERE source <> '' GROUP BY 1, 2""")
def user_attribution(events, spark, sf_dir):
    return attribution.user_attribution(events)


@query("attribution_first_touch", EV + """
, t AS (SELECT app_id, user_id, arg_min(source, event_time) AS source, arg_min(medium, event_time) AS medium,
               arg_min(campaign, event_time) AS campaign, min(event_time) AS touched
        FROM ev WHERE source <> '' GROUP BY 1, 2)
SELECT app_id, date_trunc('day', touched)::TIMESTAMP AS bucket, t.source, t.medium, t.campaign,
       count(DISTINCT user_id) AS users, count(*) FILTER (event_name = 'purchase') AS conversions,
       round(coalesce(sum(ev.revenue), 0), 6) AS revenue,
       round(100.0 * count(*) FILTER (event_name = 'purchase') / count(DISTINCT user_id), 6) AS conversion_pct
FROM t JOIN ev USING (app_id, user_id) GROUP BY 1, 2, 3, 4, 5""")
def attribution_first_touch(events, spark, sf_dir):
    return attribution.attribution(events, "first_touch", vocabulary=V)


PAIRS = """, p AS (SELECT app_id, user_id, event_id AS pid, event_time AS pt, revenue AS amount FROM ev WHERE event_name = 'purchase'),
t AS (SELECT app_id, user_id, event_time AS tt, source, medium, campaign FROM ev WHERE source <> ''),
pairs AS (SELECT p.*, t.tt, t.source, t.medium, t.campaign
          FROM p LEFT JOIN t ON t.app_id = p.app_id AND t.user_id = p.user_id AND t.tt <= p.pt)"""


@query("attribution_last_touch", EV + PAIRS + """
, last AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY app_id, pid ORDER BY tt DESC NULLS LAST) = 1)
SELECT app_id, date_trunc('day', pt)::TIMESTAMP AS bucket, coalesce(source, '(none)') AS source,
       coalesce(medium, '(none)') AS medium, coalesce(campaign, '(none)') AS campaign,
       count(DISTINCT user_id) AS users, count(*) AS conversions, round(sum(amount), 6) AS revenue
FROM last GROUP BY 1, 2, 3, 4, 5""")
def attribution_last_touch(events, spark, sf_dir):
    return attribution.attribution(events, "last_touch", vocabulary=V)


@query("attribution_linear", EV + PAIRS + """
, w AS (SELECT *, count(*) OVER (PARTITION BY app_id, pid) AS n FROM pairs)
SELECT app_id, date_trunc('week', coalesce(tt, pt) + INTERVAL 1 DAY)::TIMESTAMP - INTERVAL 1 DAY AS bucket,
       coalesce(source, '(none)') AS source, coalesce(medium, '(none)') AS medium,
       coalesce(campaign, '(none)') AS campaign,
       round(sum(1.0::DOUBLE / n), 6) AS conversions, round(sum(amount / n), 6) AS revenue
FROM w GROUP BY 1, 2, 3, 4, 5""")
def attribution_linear(events, spark, sf_dir):
    return attribution.attribution(events, "linear", "week", V)


EXPERIMENTS = """SELECT * FROM VALUES
 ('button', 'app_0', 'button', 'running', array(named_struct('name', 'control', 'weight', 50), named_struct('name', 'green', 'weight', 30), named_struct('name', 'red', 'weight', 20)),
  array(named_struct('metric', 'purchase', 'type', 'primary'), named_struct('metric', 'error', 'type', 'guardrail'))),
 ('price', 'app_1', 'price', 'running', array(named_struct('name', 'control', 'weight', 1), named_struct('name', 'low', 'weight', 2)),
  array(named_struct('metric', 'purchase', 'type', 'primary')))
 AS t(id, app_id, name, status, variants, metric_goals)"""

ASSIGNED = """, u AS (SELECT DISTINCT app_id, user_id FROM ev),
e(experiment_id, app_id, variant, lo, hi) AS (VALUES
  ('button', 'app_0', 'control', 0, 5000), ('button', 'app_0', 'green', 5000, 8000), ('button', 'app_0', 'red', 8000, 10000),
  ('price', 'app_1', 'control', 0, 10000 / 3.0), ('price', 'app_1', 'low', 10000 / 3.0, 10000)),
assigned AS (SELECT e.experiment_id, u.app_id, u.user_id, e.variant FROM u JOIN e ON e.app_id = u.app_id
  AND CAST('0x' || substr(md5(e.experiment_id || ':' || u.user_id), 1, 8) AS BIGINT) % 10000 >= lo
  AND CAST('0x' || substr(md5(e.experiment_id || ':' || u.user_id), 1, 8) AS BIGINT) % 10000 < hi)"""


def assigned(events, spark):
    return experiments.assign_variant(
        events.select("app_id", "user_id").distinct(), spark.sql(EXPERIMENTS)
    )


def exposure_log(events):
    """Every sign-up re-assigns its user, so the newest row has to win."""
    return events.filter(F.col("event_name") == "signup").select(
        F.concat(F.lit("exp_"), "app_id").alias("experiment_id"), "user_id", "app_id",
        F.when(F.col("browser").isin("Chrome", "Safari"), "control").otherwise("treatment").alias("variant"),
        F.col("event_time").alias("assigned_at"),
    )


LATEST = """, a AS (
  SELECT 'exp_' || app_id AS experiment_id, user_id, app_id,
         CASE WHEN browser IN ('Chrome', 'Safari') THEN 'control' ELSE 'treatment' END AS variant, event_time AS assigned_at
  FROM ev WHERE event_name = 'signup'
  QUALIFY row_number() OVER (PARTITION BY app_id, user_id ORDER BY event_time DESC) = 1)"""


@query("assign_variant", EV + ASSIGNED + " SELECT * FROM assigned")
def assign_variant(events, spark, sf_dir):
    return assigned(events, spark)


@query("latest_assignments", EV + LATEST + " SELECT * FROM a")
def latest_assignments(events, spark, sf_dir):
    return experiments.latest_assignments(exposure_log(events))


def compare_sql(by: str) -> str:
    """Conversion, lift and p-value over ``pts``, with erfc by the same rational polynomial."""
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"(({poly}) + {a}) * tt"
    return f""", c AS (SELECT *, 100.0 * converting_users / users AS pct,
  max(CASE WHEN variant = 'control' THEN converting_users END) OVER w AS x0,
  max(CASE WHEN variant = 'control' THEN users END) OVER w AS n0,
  max(CASE WHEN variant = 'control' THEN 100.0 * converting_users / users END) OVER w AS pct0
  FROM pts WINDOW w AS (PARTITION BY {by})),
z AS (SELECT *, (converting_users + x0) / (users + n0) AS pool FROM c),
se AS (SELECT *, sqrt(pool * (1.0 - pool) * (1.0 / users + 1.0 / n0)) AS err FROM z),
x AS (SELECT *, abs((converting_users / users - x0 / n0) / nullif(err, 0)) / sqrt(2.0) AS ax FROM se),
q AS (SELECT *, 1.0 / (1.0 + {ERF_P} * ax) AS tt FROM x),
compared AS (SELECT *, round(pct, 6) AS conversion_pct,
  round(CASE WHEN variant <> 'control' AND pct0 > 0 THEN 100.0 * (pct - pct0) / pct0 END, 6) AS lift_pct,
  round(CASE WHEN variant <> 'control' AND n0 IS NOT NULL THEN
    CASE WHEN err > 0 THEN {poly} * exp(-ax * ax) ELSE 1.0 END END, 6) AS p_value FROM q)"""


@query("experiment_results", EV + LATEST + """
, pu AS (SELECT app_id, user_id, count(*) FILTER (event_name = 'error') AS goals, coalesce(sum(revenue), 0) AS rev
         FROM ev WHERE event_time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' GROUP BY 1, 2),
pts AS (SELECT experiment_id, a.app_id, variant, count(*) AS users, coalesce(sum(goals), 0)::BIGINT AS goal_events,
               count(*) FILTER (goals > 0) AS converting_users, coalesce(sum(rev), 0) AS rev
        FROM a LEFT JOIN pu USING (app_id, user_id) GROUP BY 1, 2, 3)""" + compare_sql("experiment_id") + """
SELECT experiment_id, app_id, variant, users, goal_events, converting_users, round(rev, 6) AS revenue,
       conversion_pct, lift_pct, p_value FROM compared""")
def experiment_results(events, spark, sf_dir):
    in_range = scope(events, start="2024-01-10", end="2024-01-12")
    return experiments.experiment_results(in_range, exposure_log(events), "error", V)


@query("experiment_goals", EV + ASSIGNED + """
, g(experiment_id, app_id, goal, goal_type) AS (VALUES ('button', 'app_0', 'purchase', 'primary'),
   ('button', 'app_0', 'error', 'guardrail'), ('price', 'app_1', 'purchase', 'primary')),
pu AS (SELECT app_id, user_id, event_name AS goal, count(*) AS goals FROM ev
       WHERE event_time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' GROUP BY 1, 2, 3),
pts AS (SELECT s.experiment_id, s.app_id, g.goal, g.goal_type, s.variant, count(*) AS users,
               coalesce(sum(goals), 0)::BIGINT AS goal_events, count(*) FILTER (goals > 0) AS converting_users
        FROM assigned s JOIN g ON g.experiment_id = s.experiment_id AND g.app_id = s.app_id
        LEFT JOIN pu ON pu.app_id = s.app_id AND pu.user_id = s.user_id AND pu.goal = g.goal
        GROUP BY 1, 2, 3, 4, 5)""" + compare_sql("experiment_id, goal") + """
SELECT experiment_id, app_id, goal, goal_type, variant, users, goal_events, converting_users, conversion_pct, lift_pct, p_value
FROM compared""")
def experiment_goals(events, spark, sf_dir):
    log = assigned(events, spark).withColumn("assigned_at", F.lit("2024-01-01").cast("timestamp"))
    in_range = scope(events, start="2024-01-10", end="2024-01-12")
    return experiments.experiment_goals(in_range, log, spark.sql(EXPERIMENTS))
