"""Registry and the SQL form of the test-data adapter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickspan.sources.testdata import load_events

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The adapter in ``sources.testdata`` as a common table expression.
EV = """
WITH raw AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
  FROM events
), ev AS (
  SELECT 'app_' || (user_id % 3) AS app_id,
         CAST(event_id AS VARCHAR) AS event_id,
         'u_' || user_id AS user_id,
         'd_' || user_id || '_' || (k % 2) AS device_id,
         event_type AS event_name,
         ts AS event_time,
         CAST(ts AS DATE) AS event_date,
         's_' || user_id || '_' || strftime(ts, '%Y%m%d') AS session_id,
         ['SE','US','KE','NL','PL','NZ','MX','TR'][(user_id % 8) + 1] AS country_code,
         ['web','ios','android'][(k % 3) + 1] AS platform,
         '1.' || (k % 4) AS app_version,
         ['Windows','iOS','Android'][(k % 3) + 1] AS os_family,
         ['Chrome','Firefox','Safari','Edge'][(k % 4) + 1] AS browser,
         'city_' || (user_id % 8) AS city,
         CASE WHEN event_type = 'purchase' THEN value END AS revenue,
         k, value,
         ['','free','Pro','Team'][(k % 4) + 1] AS plan,
         ['','google','facebook','email','partner'][(k % 5) + 1] AS source,
         CASE WHEN k % 5 = 0 THEN '' ELSE ['cpc','social','referral'][(k % 3) + 1] END AS medium,
         CASE WHEN k % 5 = 0 THEN '' ELSE ['spring','summer','autumn','winter'][(k % 4) + 1] END AS campaign,
         ['USD','EUR'][(k % 2) + 1] AS currency,
         'screen_' || (k % 5) AS screen_name,
         ['spring','summer','autumn','winter'][(k % 4) + 1] AS campaign_id
  FROM raw
)"""


def sessions_cte(gap_seconds: int, key: str = "device_id") -> str:
    """Events with session numbers and ids, as further common table expressions after ``EV``."""
    return f""", stepped AS (
  SELECT *, CASE WHEN lag(event_time) OVER w IS NULL
                   OR epoch_us(event_time) - epoch_us(lag(event_time) OVER w) > {gap_seconds * 1_000_000}
                 THEN 1 ELSE 0 END AS is_new
  FROM ev WINDOW w AS (PARTITION BY app_id, {key} ORDER BY event_time)
), numbered AS (
  SELECT *, sum(is_new) OVER (PARTITION BY app_id, {key} ORDER BY event_time) AS session_no FROM stepped
), located AS (
  SELECT * EXCLUDE (session_id),
         app_id || '-' || {key} || '-' || (epoch_us(min(event_time) OVER (PARTITION BY app_id, {key}, session_no)) // 1000) AS session_id,
         min(event_time) OVER (PARTITION BY app_id, {key}, session_no) AS session_start
  FROM numbered
), summary AS (
  SELECT app_id, device_id, session_id, min(user_id) AS user_id,
         arg_min(country_code, event_time) AS country_code, arg_min(platform, event_time) AS platform,
         min(event_time) AS started_at, max(event_time) AS ended_at,
         CAST(floor((epoch_us(max(event_time)) - epoch_us(min(event_time))) / 1000000) AS BIGINT) AS duration_s,
         count(*) AS event_count,
         count(*) FILTER (event_name = 'view') AS screen_count,
         coalesce(arg_min(screen_name, event_time) FILTER (event_name = 'view'), '') AS entry_screen,
         coalesce(arg_max(screen_name, event_time) FILTER (event_name = 'view'), '') AS exit_screen
  FROM located GROUP BY app_id, device_id, session_id
)"""


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: UTC timestamps without zone, long integers, doubles to 6 places."""
    columns = []
    for field in df.schema.fields:
        kind, col = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind == "timestamp":
            col = col.cast("timestamp_ntz")
        elif kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        elif kind == "double":
            col = F.round(col, 6)
        columns.append(col.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Query]:
    """Register ``f(events, spark, sf_dir)`` under a name, with its oracle."""
    def register(build: Callable[..., DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(build(load_events(spark, sf_dir), spark, sf_dir))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return register
