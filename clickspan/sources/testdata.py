"""Adapter from the driver's ``events`` table to the event schema.

Every derived column is a plain expression over the table, so an oracle can repeat it in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickspan.session import configure
from clickspan.vocabulary import Vocabulary

TEST_VOCABULARY = Vocabulary(
    install=("signup",),
    open=("view",),
    purchase=("purchase",),
    error=("error",),
    api_call=("click",),
    screen=("view",),
    session_start="signup",
)

COUNTRIES = ["SE", "US", "KE", "NL", "PL", "NZ", "MX", "TR"]
# Browser and platform names equal the labels of the enrichment (fixed values).
PLATFORMS = ["web", "ios", "android"]
SYSTEMS = ["Windows", "iOS", "Android"]
BROWSERS = ["Chrome", "Firefox", "Safari", "Edge"]
SOURCES = ["", "google", "facebook", "email", "partner"]
MEDIUMS = ["cpc", "social", "referral"]
CAMPAIGNS = ["spring", "summer", "autumn", "winter"]


RAW_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _pick(values: list[str], index: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), CAST({index} + 1 AS INT))"


def read_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's event table with ``k``, the number inside ``props``."""
    configure(spark)
    return spark.read.schema(RAW_EVENTS).parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "user_id", "event_type", "value", "CAST(ts AS timestamp) AS ts",
        "CAST(get_json_object(props, '$.k') AS bigint) AS k",
    )


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as 18-column fact rows plus ``event_date``."""
    source = _pick(SOURCES, "k % 5")
    return read_raw(spark, sf_dir).selectExpr(
        "concat('app_', user_id % 3) AS app_id",
        "CAST(event_id AS string) AS event_id",
        "concat('u_', user_id) AS user_id",
        "concat('d_', user_id, '_', k % 2) AS device_id",
        "event_type AS event_name",
        "ts AS event_time",
        "ts AS server_time",
        "concat('s_', user_id, '_', date_format(ts, 'yyyyMMdd')) AS session_id",
        f"{_pick(COUNTRIES, 'user_id % 8')} AS country_code",
        f"{_pick(PLATFORMS, 'k % 3')} AS platform",
        "concat('1.', k % 4) AS app_version",
        f"{_pick(SYSTEMS, 'k % 3')} AS os_family",
        f"{_pick(BROWSERS, 'k % 4')} AS browser",
        "concat('city_', user_id % 8) AS city",
        "CASE WHEN event_type = 'purchase' THEN value END AS revenue",
        f"""map(
          'k', CAST(k AS string),
          'plan', {_pick(["", "free", "Pro", "Team"], "k % 4")},
          'utm_source', {source},
          'utm_medium', CASE WHEN k % 5 = 0 THEN '' ELSE {_pick(MEDIUMS, "k % 3")} END,
          'utm_campaign', CASE WHEN k % 5 = 0 THEN '' ELSE {_pick(CAMPAIGNS, "k % 4")} END,
          'revenue', CASE WHEN event_type = 'purchase' THEN CAST(value AS string) ELSE '' END,
          'currency', {_pick(["USD", "EUR"], "k % 2")},
          'screen_name', concat('screen_', k % 5),
          'latency_ms', CAST(value AS string)) AS props""",
        f"{_pick(CAMPAIGNS, 'k % 4')} AS campaign_id",
        f"{source} AS install_source",
        "to_date(ts) AS event_date",
    )


# Raw-message derivation: user agents, forwarded addresses and platform spellings by ``k``.
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/124.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/124.0 Safari/537.36 Edg/124.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 Version/17.4 Safari/605.1.15",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_4 like Mac OS X) AppleWebKit/605.1.15 Mobile Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 Chrome/124.0 Mobile Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64; rv:125.0) Gecko/20100101 Firefox/125.0",
    "",
]
RAW_PLATFORMS = [" Android ", "iPhone", "browser", "ReactNative", "flutter", "backend", "toaster"]


def raw_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest messages (``value``) built from the events, one event per message.

    Some messages are broken on purpose: event time far off, blank names, truncated JSON.
    """
    raw = read_raw(spark, sf_dir).withColumn("ms", F.unix_millis("ts"))
    user, k = F.col("user_id"), F.col("k")
    shift = (
        F.when(k % 25 == 1, -8 * 86_400_000).when(k % 25 == 2, 25 * 3_600_000)
        .when(k % 10 == 0, -400_000).otherwise(F.lit(1500))
    )
    forwarded = (
        F.when(k % 4 == 0, F.concat(F.lit("10.0.0.1, 81.2."), user % 256, F.lit("."), k))
        .when(k % 4 == 1, F.lit("192.168.1.5"))
        .when(k % 4 == 2, F.lit(""))
        .otherwise(F.concat(F.lit("unknown, 24."), user % 200, F.lit("."), k, F.lit(".7")))
    )
    event = F.struct(
        F.when(k == 60, F.lit("")).otherwise(F.col("event_id").cast("string")).alias("event_id"),
        F.when(k == 50, F.lit("")).otherwise(F.col("event_type")).alias("event_name"),
        (F.col("ms") + shift).alias("event_time"),
        F.struct(
            k.alias("k"), (k / 4.0).alias("ratio"), (k % 2 == 0).alias("flag"),
            F.lit(1e21).alias("big"), F.struct(k.alias("a")).alias("nested"),
            pick(SOURCES, k % 5).alias("install_source"),
            pick(CAMPAIGNS, k % 4).alias("campaign_id"),
        ).alias("props"),
        F.struct(pick(USER_AGENTS, k % 7).alias("user_agent")).alias("device"),
        F.struct(F.lit("1.0").alias("version"), pick(RAW_PLATFORMS, k % 7).alias("platform")).alias("app"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("revenue"),
    )
    batch = F.struct(
        F.lit("spoofed").alias("app_id"),
        F.concat(F.lit("d_"), user, F.lit("_"), k % 2).alias("device_id"),
        F.concat(F.lit("u_"), user).alias("user_id"),
        F.array(event).alias("events"),
    )
    envelope = F.to_json(F.struct(
        batch.alias("batch"),
        forwarded.alias("x_forwarded_for"),
        F.concat(F.lit("203.0."), user % 256, F.lit(".9:5123")).alias("remote_addr"),
        F.concat(F.lit("app_"), user % 3).alias("authenticated_app"),
        F.col("ms").alias("server_ts"),
    ))
    broken = F.when(k == 70, F.substring(envelope, 1, 40)).otherwise(envelope)
    # A topic has several partitions, filled by message key.
    return raw.select(
        F.concat(F.lit("app_"), user % 3, F.lit(":d_"), user, F.lit("_"), k % 2).alias("key"),
        broken.alias("value"),
        F.timestamp_millis("ms").alias("timestamp"),
    ).repartition("key")


def raw_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest messages with all events of a device's day, 60 properties each.

    Every message arrives twice, and once more from another tenant that uses the same ids.
    """
    raw = read_raw(spark, sf_dir).withColumn("ms", F.unix_millis("ts"))
    user, k = F.col("user_id"), F.col("k")
    # The properties are added behind the shuffle, which makes a partition many times larger than what adaptive execution
    # would measure there: their number is the configured one.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = raw.select("user_id", (k % 2).alias("d"), F.floor(F.col("ms") / 86_400_000).alias("day"), "event_id", "event_type", "ms", "k")
    days = slim.repartition(partitions, "user_id", "d", "day").groupBy("user_id", "d", "day").agg(F.collect_list(F.struct("event_id", "event_type", "ms", "k")).alias("sent"), F.max("ms").alias("server_ts"))

    def event(row: Column) -> Column:
        wide = [part for i in range(1, 61) for part in (F.lit(f"a{i:02d}"), F.concat(row["k"].cast("string"), F.lit(f"-{i}")))]
        return F.struct(
            row["event_id"].cast("string").alias("event_id"), row["event_type"].alias("event_name"), row["ms"].alias("event_time"),
            F.create_map(*wide, F.lit("install_source"), pick(SOURCES, row["k"] % 5), F.lit("utm_source"), F.lit("x")).alias("props"),
            F.struct(F.lit("1.0").alias("version"), F.lit("web").alias("platform")).alias("app"))

    batch = F.struct(
        F.concat(F.lit("d_"), user, F.lit("_"), F.col("d")).alias("device_id"),
        F.concat(F.lit("u_"), user).alias("user_id"), F.transform("sent", event).alias("events"))
    copies = F.explode(F.array(*[
        F.struct(F.lit(app).alias("app"), F.lit(later).alias("later")) for app, later in (("app_", 0), ("app_", 5000), ("b_", 0))]))
    received = F.col("server_ts") + F.col("c.later")
    around = F.to_json(F.struct(
        F.lit("8.8.4.4:1").alias("remote_addr"),
        F.concat(F.col("c.app"), (user % 3).cast("string")).alias("authenticated_app"), received.alias("server_ts")))
    # The copies differ in what stands around the batch, which is written once.
    return days.select("user_id", "server_ts", F.to_json(batch).alias("batch")).select("*", copies.alias("c")).select(
        F.concat(F.lit('{"batch":'), "batch", F.lit(","), F.substring(around, 2, 2**31 - 1)).alias("value"),
        F.timestamp_millis(received).alias("timestamp"))
