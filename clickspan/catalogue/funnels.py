"""Funnels."""

from __future__ import annotations

from clickspan.catalogue.base import EV, query
from clickspan.operators import funnels

STEPS = ["signup", "click", "purchase"]


def levels(steps: list[str], window: int) -> str:
    """Level per user by chaining, from every first-step event, the earliest next step."""
    parts = [f""", step_events AS (SELECT app_id, user_id, event_name, epoch_us(event_time) // 1000000 AS sec FROM ev
  WHERE event_name IN ({', '.join(repr(s) for s in steps)})),
c1 AS (SELECT app_id, user_id, sec AS s0, sec AS s1 FROM step_events WHERE event_name = '{steps[0]}')"""]
    for i, step in enumerate(steps[1:], start=2):
        parts.append(f""",
c{i} AS (SELECT c.app_id, c.user_id, s0, min(e.sec) AS s{i} FROM c{i - 1} c JOIN step_events e
  ON e.app_id = c.app_id AND e.user_id = c.user_id AND e.event_name = '{step}' AND e.sec >= c.s{i - 1} AND e.sec <= s0 + {window}
  GROUP BY 1, 2, 3)""")
    union = " UNION ALL ".join(
        f"SELECT app_id, user_id, {i} AS level FROM c{i}" for i in range(1, len(steps) + 1)
    )
    parts.append(f""",
levels AS (SELECT app_id, user_id, max(level)::BIGINT AS level FROM (
  SELECT DISTINCT app_id, user_id, 0 AS level FROM step_events UNION ALL {union}) GROUP BY 1, 2)""")
    return "".join(parts)


@query("window_funnel", EV + levels(STEPS, 86400) + " SELECT * FROM levels")
def window_funnel(events, spark, sf_dir):
    return funnels.window_funnel(events, STEPS, "1 day")


FOUR = ["view", "click", "signup", "purchase"]


@query("window_funnel_four_steps", EV + levels(FOUR, 21600) + " SELECT * FROM levels")
def window_funnel_four_steps(events, spark, sf_dir):
    return funnels.window_funnel(events, FOUR, "6 hours")


FUNNEL = """, n AS (
  SELECT app_id, s.step, s.event_name, count(*) FILTER (level >= s.step) AS user_count
  FROM levels CROSS JOIN (VALUES (1, 'signup'), (2, 'click'), (3, 'purchase')) s(step, event_name) GROUP BY 1, 2, 3),
f AS (SELECT *, first_value(user_count) OVER w AS n0, lead(user_count) OVER w AS nx FROM n
      WINDOW w AS (PARTITION BY app_id ORDER BY step))
SELECT app_id, step::BIGINT AS step, event_name, user_count,
  round(CASE WHEN n0 > 0 THEN user_count / n0 ELSE 0 END, 6) AS conversion_rate,
  round(CASE WHEN nx IS NOT NULL AND user_count > 0 THEN 1 - nx / user_count ELSE 0 END, 6) AS drop_off_rate FROM f"""


@query("funnel_7d", EV + levels(STEPS, 604800) + FUNNEL)
def funnel_7d(events, spark, sf_dir):
    return funnels.funnel(events, STEPS, "7 days")


@query("funnel_12h", EV + levels(STEPS, 43200) + FUNNEL)
def funnel_12h(events, spark, sf_dir):
    return funnels.funnel(events, STEPS, "12 hours")


@query("funnel_overall", EV + levels(STEPS, 86400) + """
SELECT app_id, count(*) FILTER (level >= 1) AS entered, count(*) FILTER (level >= 3) AS converted,
       round(count(*) FILTER (level >= 3) / count(*) FILTER (level >= 1), 6) AS overall_rate FROM levels GROUP BY 1""")
def funnel_overall(events, spark, sf_dir):
    return funnels.funnel_overall(events, STEPS, "1 day")


DEFINITIONS = [
    ("checkout", "app_0", ["signup", "click", "purchase"], 86400),
    ("quick_buy", "app_0", ["view", "purchase"], 21600),
    ("checkout", "app_1", ["signup", "click", "purchase"], 172800),
    ("recover", "app_2", ["error", "view", "click", "purchase"], 259200),
]


def definitions(spark):
    rows = ", ".join(
        f"('{funnel}', '{app}', '{funnel}', array({', '.join(repr(s) for s in steps)}), {window}L)"
        for funnel, app, steps, window in DEFINITIONS
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(funnel_id, app_id, name, steps, window_seconds)")


def _intervals() -> str:
    """Per definition: minimal (start, end) chains in milliseconds, for the greedy selection."""
    found = []
    for funnel, app, steps, window in DEFINITIONS:
        chain = [f"(SELECT app_id, user_id, (epoch_us(event_time) // 1000) AS t FROM ev WHERE app_id = '{app}' AND event_name = '{steps[0]}')"]
        sql = f"SELECT user_id, t AS s0, t AS s FROM {chain[0]}"
        for step in steps[1:]:
            sql = f"""SELECT c.user_id, c.s0, min((epoch_us(e.event_time) // 1000)) AS s FROM ({sql}) c JOIN ev e
  ON e.app_id = '{app}' AND e.user_id = c.user_id AND e.event_name = '{step}' AND (epoch_us(e.event_time) // 1000) >= c.s
  AND (epoch_us(e.event_time) // 1000) <= c.s0 + {window * 1000} GROUP BY 1, 2"""
        found.append(
            f"SELECT '{app}' AS app_id, '{funnel}' AS funnel_id, {len(steps)} AS n, user_id, s0, s AS e FROM ({sql})"
        )
    return " UNION ALL ".join(found)


CONVERSIONS = EV.replace("WITH raw", "WITH RECURSIVE raw") + f"""
, chains AS ({_intervals()}),
best AS (SELECT app_id, funnel_id, n, user_id, max(s0) AS s0, e FROM chains GROUP BY 1, 2, 3, 4, 6),
nxt AS (SELECT b.app_id, b.funnel_id, b.user_id, b.e, min(c.e) AS ne FROM best b JOIN best c
  ON c.app_id = b.app_id AND c.funnel_id = b.funnel_id AND c.user_id = b.user_id AND c.s0 > b.e GROUP BY 1, 2, 3, 4),
picked AS (
  SELECT app_id, funnel_id, user_id, min(e) AS e FROM best GROUP BY 1, 2, 3
  UNION ALL
  SELECT p.app_id, p.funnel_id, p.user_id, nxt.ne FROM picked p JOIN nxt
    ON nxt.app_id = p.app_id AND nxt.funnel_id = p.funnel_id AND nxt.user_id = p.user_id AND nxt.e = p.e),
conv AS (SELECT b.* FROM best b JOIN picked p USING (app_id, funnel_id, user_id, e))
"""


@query("funnel_conversions", CONVERSIONS + """
SELECT app_id, funnel_id, user_id, n::BIGINT AS steps_complete, n::BIGINT AS total_steps, true AS converted,
       (e - s0)::BIGINT AS duration_ms, make_timestamp(e * 1000) AS converted_at, '' AS campaign_id FROM conv""")
def funnel_conversions(events, spark, sf_dir):
    return funnels.funnel_conversions(events, definitions(spark))


@query("funnel_results", CONVERSIONS + """
SELECT app_id, funnel_id, n::BIGINT AS steps_complete, count(*) AS conversions, count(DISTINCT user_id) AS users
FROM conv GROUP BY 1, 2, 3""")
def funnel_results(events, spark, sf_dir):
    return funnels.funnel_results(funnels.funnel_conversions(events, definitions(spark)))


def _dropoffs() -> str:
    selects = []
    for funnel, app, steps, window in DEFINITIONS:
        body = EV + levels(steps, window) + f"""
SELECT l.app_id, '{funnel}' AS funnel_id, l.user_id, l.level AS steps_complete, {len(steps)}::BIGINT AS total_steps,
       make_timestamp(max(c1.s0) * 1000000) AS last_entered_at
FROM levels l JOIN c1 USING (app_id, user_id)
WHERE l.app_id = '{app}' AND l.level BETWEEN 1 AND {len(steps) - 1}
GROUP BY 1, 2, 3, 4, 5
HAVING max(c1.s0) + {window} < epoch(TIMESTAMP '2024-01-31 00:00:00')"""
        selects.append(f"SELECT * FROM ({body})")
    return " UNION ALL ".join(selects)


@query("funnel_dropoffs", _dropoffs())
def funnel_dropoffs(events, spark, sf_dir):
    return funnels.funnel_dropoffs(events, definitions(spark), "2024-01-31 00:00:00")
