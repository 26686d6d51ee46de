"""Retention, revenue and lifetime value."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickspan.catalogue.base import EV, query
from clickspan.operators import growth
from clickspan.sources import events as event_store
from clickspan.sources.testdata import TEST_VOCABULARY as V

RETURNS = """, inst AS (SELECT app_id, user_id, min(event_date) AS install_date FROM ev WHERE event_name = 'signup' GROUP BY 1, 2),
returns AS (SELECT DISTINCT app_id, user_id, install_date, event_date AS return_date,
                   datediff('day', install_date, event_date) AS day_n
            FROM inst JOIN ev USING (app_id, user_id)
            WHERE event_name IN ('signup', 'view') AND event_date >= install_date)"""

RETENTION = RETURNS + """, sized AS (SELECT app_id, install_date, count(*) AS cohort_size FROM inst GROUP BY 1, 2),
cohorts AS (
  SELECT s.app_id, s.install_date, s.cohort_size, d.day_n::BIGINT AS day_n, count(DISTINCT r.user_id) AS retained,
         count(DISTINCT r.user_id) / s.cohort_size AS rate
  FROM sized s CROSS JOIN (VALUES (1), (3), (7), (14), (30)) d(day_n)
  LEFT JOIN returns r ON r.app_id = s.app_id AND r.install_date = s.install_date AND r.day_n = d.day_n
  GROUP BY 1, 2, 3, 4)"""


@query("retention_events", EV + RETURNS + " SELECT * FROM returns")
def retention_events(events, spark, sf_dir):
    return growth.retention_events(events, V)


@query("retention", EV + RETENTION + """
SELECT app_id, install_date, cohort_size, day_n, retained, round(rate, 6) AS rate FROM cohorts""")
def retention(events, spark, sf_dir):
    return growth.retention(events, vocabulary=V)


@query("retention_summary", EV + RETENTION + """
SELECT app_id, day_n, round(avg(rate), 6) AS mean_rate, count(*) AS cohorts FROM cohorts GROUP BY 1, 2""")
def retention_summary(events, spark, sf_dir):
    return growth.retention_summary(growth.retention(events, vocabulary=V))


@query("retention_csv", EV + RETENTION + """
SELECT app_id, install_date, cohort_size,
       max(CASE WHEN day_n = 1 THEN printf('%.1f', round(rate * 100.0, 1)) || '%' END) AS day_1,
       max(CASE WHEN day_n = 7 THEN printf('%.1f', round(rate * 100.0, 1)) || '%' END) AS day_7
FROM cohorts GROUP BY 1, 2, 3""")
def retention_csv(events, spark, sf_dir):
    rows = event_store.retention_csv_rows(growth.retention(events, vocabulary=V))
    return rows.selectExpr("app_id", "install_date", "cohort_size",
                           "_rates['day_1'] AS day_1", "_rates['day_7'] AS day_7")


REVENUE = """SELECT app_id, {bucket} AS bucket, round(coalesce(sum(revenue), 0), 6) AS total_revenue,
  count(*) FILTER (event_name = 'purchase') AS transaction_count,
  count(DISTINCT user_id) FILTER (event_name = 'purchase') AS unique_payers,
  count(DISTINCT user_id) AS active_users,
  round(CASE WHEN unique_payers > 0 THEN coalesce(sum(revenue), 0) / unique_payers ELSE 0 END, 6) AS arppu,
  round(coalesce(sum(revenue), 0) / count(DISTINCT user_id), 6) AS arpu
FROM ev GROUP BY 1, 2"""


@query("revenue_daily", EV + REVENUE.format(bucket="event_date::TIMESTAMP"))
def revenue_daily(events, spark, sf_dir):
    return growth.revenue(events, "day", V)


@query("revenue_hourly", EV + REVENUE.format(bucket="date_trunc('hour', event_time)::TIMESTAMP"))
def revenue_hourly(events, spark, sf_dir):
    return growth.revenue(events, "hour", V)


@query("revenue_total", EV + " SELECT app_id, round(sum(revenue), 4) AS total_ltv FROM ev GROUP BY 1")
def revenue_total(events, spark, sf_dir):


    total = growth.revenue_total(growth.revenue(events, "month", V))
    return total.withColumn("total_ltv", F.round("total_ltv", 4))


@query("revenue_by_currency", EV + """
SELECT app_id, event_date::TIMESTAMP AS bucket, currency, round(sum(revenue), 6) AS total_revenue,
       count(*) AS transaction_count, count(DISTINCT user_id) AS unique_payers
FROM ev WHERE event_name = 'purchase' GROUP BY 1, 2, 3""")
def revenue_by_currency(events, spark, sf_dir):
    return growth.revenue_by_currency(events, "day", vocabulary=V)


INSTALLS = """, inst AS (SELECT app_id, user_id, min(event_date) AS cohort_date FROM ev WHERE event_name = 'signup' GROUP BY 1, 2)"""


@query("ltv_per_day", EV + INSTALLS + """
SELECT app_id, cohort_date, datediff('day', cohort_date, event_date) AS day_n, count(DISTINCT user_id) AS users,
       round(avg(revenue), 6) AS avg_ltv
FROM inst JOIN ev USING (app_id, user_id) WHERE event_name = 'purchase' GROUP BY 1, 2, 3""")
def ltv_per_day(events, spark, sf_dir):
    return growth.ltv_per_day(events, V)


@query("ltv_cumulative", EV + INSTALLS + """
, sized AS (SELECT app_id, cohort_date, count(*) AS users FROM inst GROUP BY 1, 2),
paid AS (SELECT app_id, cohort_date, datediff('day', cohort_date, event_date) AS day_n, revenue
         FROM inst JOIN ev USING (app_id, user_id) WHERE event_name = 'purchase')
SELECT s.app_id, s.cohort_date, s.users, d.n::BIGINT AS day_n, round(coalesce(sum(p.revenue), 0), 6) AS revenue,
       round(coalesce(sum(p.revenue), 0) / s.users, 6) AS ltv
FROM sized s CROSS JOIN (VALUES (1), (7), (14), (30), (60), (90)) d(n)
LEFT JOIN paid p ON p.app_id = s.app_id AND p.cohort_date = s.cohort_date AND p.day_n BETWEEN 0 AND d.n
GROUP BY 1, 2, 3, 4""")
def ltv_cumulative(events, spark, sf_dir):
    return growth.ltv_cumulative(events, vocabulary=V)
