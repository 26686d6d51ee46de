"""Ingest transforms over messages built from the events, archive and identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickspan.catalogue.base import EV, query
from clickspan.operators import ingest, users
from clickspan.plans.ingest import ingest_batch, with_session_ids
from clickspan.sources import events as event_store
from clickspan.sources.testdata import TEST_VOCABULARY as V
from clickspan.sources.testdata import raw_batches, raw_envelopes

# The message derivation in ``sources.testdata`` as SQL: one event per message, ``k = 70`` is cut.
MSG = """
WITH base AS (
  SELECT event_id AS id, user_id, event_type, value, (epoch_us(ts) // 1000) AS ms, ts,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
  FROM events
), msg AS (
  SELECT *, 'app_' || (user_id % 3) AS app_id, 'u_' || user_id AS uid, 'd_' || user_id || '_' || (k % 2) AS device_id,
    CASE WHEN k = 60 THEN '' ELSE CAST(id AS VARCHAR) END AS event_id,
    CASE WHEN k = 50 THEN '' ELSE event_type END AS event_name,
    ms + CASE WHEN k % 25 = 1 THEN -691200000 WHEN k % 25 = 2 THEN 90000000 WHEN k % 10 = 0 THEN -400000 ELSE 1500 END AS event_ts,
    CASE k % 4 WHEN 0 THEN '81.2.' || (user_id % 256) || '.' || k WHEN 3 THEN '24.' || (user_id % 200) || '.' || k || '.7'
         ELSE '203.0.' || (user_id % 256) || '.9' END AS client_ip,
    ['Chrome', 'Edge', 'Safari', 'Safari', 'Chrome', 'Firefox', ''][(k % 7) + 1] AS browser,
    ['Windows', 'Windows', 'macOS', 'iOS', 'Android', 'Linux', ''][(k % 7) + 1] AS os_family,
    ['android', 'ios', 'web', 'react_native', 'flutter', 'server', 'unknown'][(k % 7) + 1] AS platform,
    ['','google','facebook','email','partner'][(k % 5) + 1] AS install_source,
    ['spring','summer','autumn','winter'][(k % 4) + 1] AS campaign_id,
    CASE WHEN event_type = 'purchase' THEN value END AS revenue,
    concat_ws(',', CASE WHEN k = 50 THEN 'event_name_empty' END, CASE WHEN k % 25 = 1 THEN 'event_too_old' END,
              CASE WHEN k % 25 = 2 THEN 'event_in_future' END) AS failed
  FROM base
), arrived AS (SELECT * FROM msg WHERE k <> 70),
valid AS (SELECT * FROM arrived WHERE failed = '')"""

IP_RANGES = """SELECT start_ip, end_ip, country_code, country_name, region, city,
  CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude FROM VALUES
 (1359085568L, 1359101951L, 'GB', 'United Kingdom', 'England', 'London', 51.5, -0.1),
 (1359101952L, 1359216639L, 'FR', 'France', 'Normandy', 'Rouen', 49.4, 1.1),
 (402653184L, 408420351L, 'US', 'United States', 'Ohio', 'Dayton', 39.8, -84.2),
 (3405774848L, 3405807615L, 'AU', 'Australia', 'Victoria', 'Geelong', -38.1, 144.4)
 AS t(start_ip, end_ip, country_code, country_name, region, city, latitude, longitude)"""

GEO = """, geo(start_ip, end_ip, country_code, country_name, region, city, latitude, longitude) AS (VALUES
 (1359085568, 1359101951, 'GB', 'United Kingdom', 'England', 'London', 51.5, -0.1),
 (1359101952, 1359216639, 'FR', 'France', 'Normandy', 'Rouen', 49.4, 1.1),
 (402653184, 408420351, 'US', 'United States', 'Ohio', 'Dayton', 39.8, -84.2),
 (3405774848, 3405807615, 'AU', 'Australia', 'Victoria', 'Geelong', -38.1, 144.4)),
addressed AS (SELECT *, split_part(client_ip, '.', 1)::BIGINT * 16777216 + split_part(client_ip, '.', 2)::BIGINT * 65536
   + split_part(client_ip, '.', 3)::BIGINT * 256 + split_part(client_ip, '.', 4)::BIGINT AS ip FROM valid),
located AS (SELECT a.*, coalesce(g.country_code, '') AS country_code, coalesce(g.country_name, '') AS country_name,
   coalesce(g.region, '') AS region, coalesce(g.city, '') AS city, g.latitude::DOUBLE AS latitude, g.longitude::DOUBLE AS longitude
   FROM addressed a LEFT JOIN geo g ON a.ip BETWEEN g.start_ip AND g.end_ip)"""


def received(spark, sf_dir):
    usable, _ = ingest.dead_letter_split(raw_envelopes(spark, sf_dir))
    return ingest.explode_batches(usable)


def accepted(spark, sf_dir):
    return ingest.validate(received(spark, sf_dir))[0]


@query("dead_letters", MSG + """
SELECT CASE WHEN k = 70 THEN 'unparsable payload' WHEN k = 60 THEN 'empty event_id' ELSE 'empty event_name' END AS error,
       make_timestamp(ms * 1000) AS ts FROM msg WHERE k IN (50, 60, 70)""")
def dead_letters(events, spark, sf_dir):
    _, dead = ingest.dead_letter_split(raw_envelopes(spark, sf_dir))
    return dead.select("error", "ts")


@query("dead_letter_rate", MSG + """
SELECT count(*) AS messages, count(*) FILTER (k IN (50, 60, 70)) AS dead,
       round(count(*) FILTER (k IN (50, 60, 70)) / count(*), 6) AS dead_rate FROM msg""")
def dead_letter_rate(events, spark, sf_dir):
    return ingest.dead_letter_rate(raw_envelopes(spark, sf_dir))


@query("explode_batches", MSG + """
SELECT app_id, device_id, uid AS user_id, event_id, event_name, event_ts, ms AS server_ts, revenue FROM arrived""")
def explode_batches(events, spark, sf_dir):
    return received(spark, sf_dir).select(
        "app_id", "device_id", "user_id", "event_id", "event_name", "event_ts", "server_ts", "revenue"
    )


@query("validate_rejected", MSG + """
SELECT app_id, device_id, event_ts, failed FROM arrived WHERE failed <> ''""")
def validate_rejected(events, spark, sf_dir):
    _, rejected = ingest.validate(received(spark, sf_dir))
    return rejected.select("app_id", "device_id", "event_ts", F.array_join("failed", ",").alias("failed"))


@query("fill_defaults", MSG + """
SELECT app_id, device_id, event_name, event_ts,
       CASE WHEN event_id = '' THEN 64 ELSE length(event_id) END AS id_length FROM valid""")
def fill_defaults(events, spark, sf_dir):
    filled = ingest.fill_defaults(accepted(spark, sf_dir))
    return filled.select("app_id", "device_id", "event_name", "event_ts",
                         F.length("event_id").alias("id_length"))


@query("dedup_events", EV + """ SELECT app_id, event_id, user_id, event_name, event_time FROM ev
UNION ALL SELECT app_id || '_b', event_id, user_id, event_name, event_time FROM ev""")
def dedup_events(events, spark, sf_dir):
    """Every event arrives three times; the first arrival stays."""
    others = events.withColumn("app_id", F.concat("app_id", F.lit("_b")))  # ids are used again by other tenants
    events = events.unionByName(others)
    late = [
        events.withColumn("server_time", F.col("server_time") + F.expr(f"INTERVAL {n} HOURS"))
        .withColumn("event_name", F.lit("copy"))
        for n in (1, 2)
    ]
    copies = events.unionByName(late[0]).unionByName(late[1])
    return ingest.dedup_events(copies).select(
        "app_id", "event_id", "user_id", "event_name", "event_time"
    )


@query("ingest_report", MSG + """
SELECT app_id, count(*) AS received, count(*) FILTER (failed = '') AS accepted, count(*) FILTER (failed <> '') AS filtered
FROM arrived GROUP BY 1""")
def ingest_report(events, spark, sf_dir):
    every = received(spark, sf_dir)
    return ingest.ingest_report(every, ingest.validate(every)[0])


@query("client_ip", MSG + " SELECT app_id, device_id, event_ts, client_ip FROM arrived")
def client_ip(events, spark, sf_dir):
    address = ingest.client_ip(F.col("x_forwarded_for"), F.col("remote_addr"))
    return received(spark, sf_dir).select(
        "app_id", "device_id", "event_ts", address.alias("client_ip")
    )


@query("geo_enrich", MSG + GEO + """
SELECT app_id, device_id, event_ts, client_ip, country_code, country_name, region, city, latitude, longitude FROM located""")
def geo_enrich(events, spark, sf_dir):
    address = ingest.client_ip(F.col("x_forwarded_for"), F.col("remote_addr"))
    rows = accepted(spark, sf_dir).select("app_id", "device_id", "event_ts", address.alias("client_ip"))
    return ingest.geo_enrich(rows, spark.sql(IP_RANGES))


@query("ua_enrich", MSG + " SELECT app_id, device_id, event_ts, browser, os_family FROM arrived")
def ua_enrich(events, spark, sf_dir):
    rows = received(spark, sf_dir)
    return ingest.ua_enrich(rows, F.col("device.user_agent")).select(
        "app_id", "device_id", "event_ts", "browser", "os_family"
    )


@query("correct_time", MSG + """
SELECT app_id, device_id, ms - event_ts AS client_offset_ms,
       CASE WHEN abs(ms - event_ts) > 300000 THEN ms ELSE event_ts END AS event_ts FROM arrived""")
def correct_time(events, spark, sf_dir):
    return ingest.correct_time(received(spark, sf_dir)).select(
        "app_id", "device_id", "client_offset_ms", "event_ts"
    )


@query("normalize_platform", MSG + " SELECT app_id, device_id, event_ts, platform FROM arrived")
def normalize_platform(events, spark, sf_dir):
    return received(spark, sf_dir).select(
        "app_id", "device_id", "event_ts",
        ingest.normalize_platform(F.col("app.platform")).alias("platform"),
    )


FLAT = """SELECT app_id, device_id, event_ts, unnest(['k', 'ratio', 'flag', 'big', 'nested', 'install_source', 'campaign_id']) AS key,
  unnest([k::VARCHAR, (k // 4) || ['', '.25', '.5', '.75'][(k % 4) + 1], CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END,
          '1000000000000000000000', '{"a":' || k || '}', install_source, campaign_id]) AS value FROM arrived"""


@query("flatten_props", MSG + FLAT)
def flatten_props(events, spark, sf_dir):
    return received(spark, sf_dir).select(
        "app_id", "device_id", "event_ts", F.explode(ingest.flatten_props(F.col("raw_props")))
    )


@query("limit_props", EV + """
SELECT event_id, 50::BIGINT AS n_keys, 10::BIGINT AS dropped, 'key_01' AS first_key, 'key_50' AS last_key, least(1024, 20 * k) AS value_length FROM ev""")
def limit_props(events, spark, sf_dir):
    long = F.repeat(F.lit("x"), F.col("props")["k"].cast("int") * 20)
    names = [f"key_{i:02d}" for i in range(60, 0, -1)]
    wide = F.create_map(*[part for n in names for part in (F.lit(n), long if n == "key_07" else F.lit(n))])
    limited = events.select("event_id", ingest.limit_props(wide, 50, 256, 1024).alias("l")).select(
        "event_id", "l.dropped", F.col("l.props").alias("p"))
    keys = F.sort_array(F.map_keys("p"))
    return limited.select(
        "event_id", "dropped", F.size("p").alias("n_keys"), F.get(keys, F.lit(0)).alias("first_key"),
        F.element_at(keys, -1).alias("last_key"), F.length(F.col("p")["key_07"]).alias("value_length"),
    )


@query("extract_attribution", MSG + """
SELECT app_id, device_id, event_ts, install_source, campaign_id, '' AS adset_id FROM arrived""")
def extract_attribution(events, spark, sf_dir):
    rows = received(spark, sf_dir).withColumn("props", ingest.flatten_props(F.col("raw_props")))
    return ingest.extract_attribution(rows).select(
        "app_id", "device_id", "event_ts", "install_source", "campaign_id", "adset_id"
    )


@query("ingest_events", MSG + GEO + """
SELECT app_id, uid AS user_id, device_id, event_name,
  make_timestamp(1000 * CASE WHEN abs(ms - event_ts) > 300000 THEN ms ELSE event_ts END) AS event_time,
  make_timestamp(ms * 1000) AS server_time, '' AS session_id, country_code, platform, '1.0' AS app_version, os_family,
  browser, city, revenue, campaign_id, install_source, k::VARCHAR AS prop_k,
  CAST(make_timestamp(1000 * CASE WHEN abs(ms - event_ts) > 300000 THEN ms ELSE event_ts END) AS DATE) AS event_date
FROM located""")
def ingest_events(events, spark, sf_dir):
    """The whole batch chain from messages to fact rows."""
    rows = ingest_batch(raw_envelopes(spark, sf_dir), spark.sql(IP_RANGES)).events
    return rows.withColumn("prop_k", F.col("props")["k"]).drop("props", "event_id")


BATCHES = """
WITH base AS (
  SELECT event_id AS id, user_id, event_type, (epoch_us(ts) // 1000) AS ms,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
  FROM events
), sent AS (
  SELECT *, max(ms) OVER (PARTITION BY user_id, k % 2, ms // 86400000) AS server_ts FROM base
), arrived AS (
  SELECT app || (user_id % 3) AS app_id, id::VARCHAR AS event_id, 'u_' || user_id AS user_id,
         'd_' || user_id || '_' || (k % 2) AS device_id, event_type AS event_name, k, server_ts,
         CASE WHEN server_ts - ms > 300000 THEN server_ts ELSE ms END AS event_ts
  FROM sent, unnest(['app_', 'b_']) AS t(app))"""


@query("explode_many", BATCHES + """
SELECT app_id, event_id, event_name, count(*) * CASE WHEN app_id[1] = 'a' THEN 2 ELSE 1 END AS n FROM arrived GROUP BY 1, 2, 3""")
def explode_many(events, spark, sf_dir):
    """Messages with many events each, some of them sent twice."""
    usable, _ = ingest.dead_letter_split(raw_batches(spark, sf_dir))
    return ingest.explode_batches(usable).groupBy("app_id", "event_id", "event_name").agg(F.count("*").alias("n"))


@query("ingest_many", BATCHES + """
SELECT app_id, event_id, user_id, device_id, event_name, make_timestamp(event_ts * 1000) AS event_time,
  make_timestamp(server_ts * 1000) AS server_time, '' AS session_id, '' AS country_code, 'web' AS platform, '1.0' AS app_version,
  '' AS os_family, '' AS browser, '' AS city, CAST(NULL AS DOUBLE) AS revenue, '' AS campaign_id,
  ['','google','facebook','email','partner'][(k % 5) + 1] AS install_source,
  62::BIGINT AS n_props, k || '-60' AS last_prop, CAST(make_timestamp(event_ts * 1000) AS DATE) AS event_date
FROM arrived""")
def ingest_many(events, spark, sf_dir):
    """Doubles go, another tenant's equal ids stay, and all 62 properties come through."""
    rows = ingest_batch(raw_batches(spark, sf_dir), spark.sql(IP_RANGES)).events
    return rows.withColumn("n_props", F.size("props")).withColumn("last_prop", F.col("props")["a60"]).drop("props")


@query("ingest_many_report", BATCHES + """
SELECT app_id, count(*) * CASE WHEN app_id[1] = 'a' THEN 2 ELSE 1 END AS received, count(*) AS accepted,
       count(*) * CASE WHEN app_id[1] = 'a' THEN 1 ELSE 0 END AS filtered FROM arrived GROUP BY 1""")
def ingest_many_report(events, spark, sf_dir):
    return ingest_batch(raw_batches(spark, sf_dir), spark.sql(IP_RANGES)).report


INGESTED = MSG + """, e AS (
  SELECT app_id, uid AS user_id, device_id, event_name, coalesce(revenue, 0) AS revenue,
         make_timestamp(1000 * CASE WHEN abs(ms - event_ts) > 300000 THEN ms ELSE event_ts END) AS t FROM valid
), stepped AS (
  SELECT *, CASE WHEN lag(t) OVER w IS NULL OR epoch_us(t) - epoch_us(lag(t) OVER w) > 86400000000 THEN 1 ELSE 0 END AS begins
  FROM e WINDOW w AS (PARTITION BY app_id, device_id ORDER BY t))"""


@query("ingested_user_profile", INGESTED + """
SELECT app_id, user_id, min(t) AS first_seen, max(t) AS last_seen, count(*) AS total_events,
       sum(begins)::BIGINT AS total_sessions, round(sum(revenue), 6) AS total_revenue
FROM stepped GROUP BY 1, 2""")
def ingested_user_profile(events, spark, sf_dir):
    """From raw messages to profiles: sessions are counted on ids that the chain itself gave."""
    rows = with_session_ids(ingest_batch(raw_envelopes(spark, sf_dir), spark.sql(IP_RANGES)).events, "24 hours")
    return users.user_profile(rows, vocabulary=V).drop("last_country", "last_city")


@query("ingested_session_sizes", INGESTED + """
, numbered AS (SELECT *, sum(begins) OVER (PARTITION BY app_id, device_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS no FROM stepped)
SELECT app_id, app_id || '-' || device_id || '-' || (epoch_us(min(t)) // 1000) AS session_id, count(*) AS event_count
FROM numbered GROUP BY app_id, device_id, no""")
def ingested_session_sizes(events, spark, sf_dir):
    rows = with_session_ids(ingest_batch(raw_envelopes(spark, sf_dir), spark.sql(IP_RANGES)).events, "24 hours")
    return rows.groupBy("app_id", "session_id").agg(F.count("*").alias("event_count"))


@query("replay_dead_letters", MSG + """
SELECT app_id, uid AS user_id, device_id, event_name, make_timestamp(ms * 1000) AS event_time FROM valid WHERE k = 60""")
def replay_dead_letters(events, spark, sf_dir):
    """Dead letters through the chain again: only those without an id become events."""
    _, dead = ingest.dead_letter_split(raw_envelopes(spark, sf_dir))
    rows = event_store.replay(dead, spark.sql(IP_RANGES), events)
    return rows.select("app_id", "user_id", "device_id", "event_name", "event_time")


@query("archive_new_rows", EV + """
SELECT app_id, event_id, event_name, event_time FROM ev WHERE event_time >= TIMESTAMP '2024-01-10'
UNION ALL SELECT app_id || '_b', event_id, event_name, event_time FROM ev""")
def archive_new_rows(events, spark, sf_dir):
    """Another tenant's events with the same ids are new."""
    stored = events.filter(F.col("event_time") < F.lit("2024-01-10").cast("timestamp"))
    others = events.withColumn("app_id", F.concat("app_id", F.lit("_b")))
    twice = events.unionByName(events).unionByName(others)
    return event_store.new_rows(twice, stored).select("app_id", "event_id", "event_name", "event_time")


@query("raw_events_lookup", EV + """
SELECT app_id, event_id, event_name, event_time FROM ev
WHERE event_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY event_time DESC, event_id DESC LIMIT 100""")
def raw_events_lookup(events, spark, sf_dir):
    return event_store.raw_events_lookup(events, start="2024-01-05", end="2024-01-20").select(
        "app_id", "event_id", "event_name", "event_time"
    )


@query("unexpired", EV + " SELECT app_id, event_id, event_date FROM ev WHERE event_date >= DATE '2024-01-30' - 14")
def unexpired(events, spark, sf_dir):
    return event_store.unexpired(events, 14, "2024-01-30").select("app_id", "event_id", "event_date")


def traits(events):
    return events.select(
        "app_id", "user_id", "device_id",
        F.create_map(F.lit("plan"), F.col("props")["plan"], F.lit("last_event"), F.col("event_name"),
                     F.concat(F.lit("on_"), "platform"), F.col("props")["k"]).alias("traits"),
        F.col("event_time").alias("ts"),
    )


@query("identify_events", EV + """
SELECT app_id, user_id, device_id, 'user_updated' AS event_name, event_time, event_time AS server_time, '' AS session_id,
       '' AS platform, CAST(NULL AS DOUBLE) AS revenue, plan, event_name AS last_event FROM ev
UNION ALL
SELECT app_id, user_id, device_id, event_name, event_time, event_time, session_id, platform, revenue, plan, NULL FROM ev""")
def identify_events(events, spark, sf_dir):
    """Identify calls have the layout of the fact table and can be put with its rows."""
    both = ingest.identify_events(traits(events)).unionByName(events.drop("event_date"))
    return both.select(
        "app_id", "user_id", "device_id", "event_name", "event_time", "server_time", "session_id", "platform", "revenue",
        F.col("props")["plan"].alias("plan"), F.col("props")["last_event"].alias("last_event"),
    )


@query("merge_profiles", EV + """
, e AS (SELECT app_id, user_id, event_time, unnest(['plan', 'last_event', 'on_' || platform]) AS key,
               unnest([plan, event_name, k::VARCHAR]) AS value FROM ev)
SELECT app_id, user_id, key, arg_max(value, event_time) AS value,
       min(min(event_time)) OVER (PARTITION BY app_id, user_id) AS created_at,
       max(max(event_time)) OVER (PARTITION BY app_id, user_id) AS updated_at FROM e GROUP BY 1, 2, 3""")
def merge_profiles(events, spark, sf_dir):
    return ingest.merge_profiles(traits(events)).select(
        "app_id", "user_id", F.explode("traits"), "created_at", "updated_at"
    )


@query("resolve_identity", EV + """
SELECT app_id, device_id, arg_max(user_id, event_time) AS user_id, min(event_time) AS first_seen, max(event_time) AS last_seen
FROM ev GROUP BY 1, 2""")
def resolve_identity(events, spark, sf_dir):
    return ingest.resolve_identity(events)


@query("quota_usage", EV + """
, apps(app_id, rps, burst) AS (VALUES ('app_0', 0.001, 6), ('app_1', 0.0005, 4), ('app_3', 0.002, 8)),
s AS (SELECT app_id, epoch_us(event_time) // 3600000000 AS slot, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT app_id, sum(n)::BIGINT AS events, count(*) AS active_intervals, max(n) AS peak_events,
       sum((n > rps * 3600)::BIGINT)::BIGINT AS intervals_over_rate, sum((n > burst)::BIGINT)::BIGINT AS intervals_over_burst,
       sum(CASE WHEN burst IS NOT NULL THEN greatest(n - burst, 0) END)::BIGINT AS events_over_burst
FROM s LEFT JOIN apps USING (app_id) GROUP BY 1""")
def quota_usage(events, spark, sf_dir):
    """One app has no limits and stays in the result."""
    apps = spark.sql("""SELECT id, 'org' AS org_id, id AS name, CAST(rps AS DOUBLE) AS rps, burst, true AS active
      FROM VALUES ('app_0', 0.001, 6), ('app_1', 0.0005, 4), ('app_3', 0.002, 8) AS t(id, rps, burst)""")
    return ingest.quota_usage(events, apps, "1 hour")
