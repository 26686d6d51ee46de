"""Alert metrics, rule evaluation and cooldown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspan.functions.greedy import greedy
from clickspan.functions.stats import safe_ratio
from clickspan.functions.text import prop
from clickspan.functions.time import TimeLike, scope, timestamp
from clickspan.operators.active import identity
from clickspan.operators.funnels import funnel_overall
from clickspan.vocabulary import DEFAULT_VOCABULARY, Vocabulary

# Metrics whose value over an empty window is 0; the others have none.
ZERO_WHEN_EMPTY = ["event_count", "event_rate", "dau", "active_users", "session_count", "revenue_total"]


def _long(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
        for name, value in metrics.items()
    ])
    return df.select("app_id", "window_mins", F.inline(rows))


def _in_windows(rows: DataFrame, time_col: str, windows: Sequence[int], as_of: TimeLike) -> DataFrame:
    """Repeat each row for the windows that contain it; rows outside all windows go first."""
    end = F.unix_micros(timestamp(as_of))
    age = end - F.unix_micros(time_col)
    recent = scope(
        rows, end=as_of,
        start=F.timestamp_micros(end - max(windows) * 60_000_000), time_col=time_col,
    )
    lengths = F.array(*[F.lit(w) for w in sorted(set(windows))])
    return recent.withColumn("window_mins", F.explode(F.filter(lengths, lambda w: age <= w.cast("bigint") * 60_000_000)))


def alert_metrics(
    events: DataFrame,
    windows: Sequence[int],
    as_of: TimeLike,
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
    sessions: DataFrame | None = None,
    funnel_steps: Sequence[str] | None = None,
    funnel_window: str | int = "7 days",
) -> DataFrame:
    """Every metric of every app for every window, as (app_id, window_mins, metric, value)."""
    rows = _in_windows(events, "event_time", windows, as_of)
    per_device = rows.groupBy("app_id", "window_mins", "device_id").agg(
        F.count("*").alias("_n"), F.count_if(vocabulary.is_error()).alias("_errors"),
        F.sum(F.when(vocabulary.is_purchase(), vocabulary.revenue()).otherwise(0.0)).alias("_revenue"),
    )
    counts = per_device.groupBy("app_id", "window_mins").agg(
        F.sum("_n").alias("n"), F.sum("_errors").alias("errors"),
        F.sum("_revenue").alias("revenue"), F.count("*").alias("devices"),
    )
    n, errors = F.col("n"), F.col("errors")
    parts = [_long(counts, {
        "event_count": n,
        "event_rate": n / F.col("window_mins"),
        "error_rate": 100.0 * safe_ratio(errors, n),
        "error_fraction": safe_ratio(errors, n),
        "active_users": F.col("devices"),
        "revenue_total": F.col("revenue"),
    })]
    latency = prop("latency_ms").try_cast("double")
    quantiles = rows.filter(vocabulary.is_api_call()).groupBy("app_id", "window_mins").agg(
        F.percentile_approx(latency, F.array(F.lit(0.95), F.lit(0.99)), 10_000).alias("q")
    )
    parts.append(_long(quantiles, {
        "p95_latency": F.get("q", F.lit(0)), "p99_latency": F.get("q", F.lit(1)),
    }))
    midnight = F.date_trunc("day", timestamp(as_of))
    dau = scope(events, start=midnight, end=as_of).filter(vocabulary.is_open()).groupBy("app_id").agg(
        F.countDistinct(identity(False)).alias("dau")
    ).withColumn("window_mins", F.explode(F.array(*[F.lit(w) for w in sorted(set(windows))])))
    parts.append(_long(dau, {"dau": F.col("dau")}))
    if sessions is not None:
        started = _in_windows(sessions, "started_at", windows, as_of).groupBy(
            "app_id", "window_mins"
        ).agg(F.count("*").alias("n"), F.count_if(F.col("event_count") == 1).alias("bounced"))
        parts.append(_long(started, {
            "session_count": F.col("n"), "bounce_rate": safe_ratio(F.col("bounced"), F.col("n")),
        }))
    if funnel_steps is not None:
        for window in sorted(set(windows)):
            start = F.timestamp_seconds(F.unix_seconds(timestamp(as_of)) - window * 60)
            rate = funnel_overall(scope(events, start=start, end=as_of), funnel_steps, funnel_window)
            parts.append(_long(
                rate.withColumn("window_mins", F.lit(window)),
                {"funnel_conversion_rate": F.col("overall_rate")},
            ))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def breached(value: Column, condition: Column, threshold: Column) -> Column:
    """Rule condition, in words or symbols."""
    return (
        F.when(condition.isin("gt", ">"), value > threshold)
        .when(condition.isin("lt", "<"), value < threshold)
        .when(condition.isin("eq", "=", "=="), value == threshold)
        .when(condition.isin("gte", ">="), value >= threshold)
        .when(condition.isin("lte", "<="), value <= threshold)
        .otherwise(F.lit(False))
    )


#: Size of the quantile sketches: up to so many values they are exact, beyond it ranks are off by 0.2 % at most
#: (with 99 % confidence, for single sketches and merged ones alike).
SKETCH_K = 2048
MINUTE = ("app_id string, minute timestamp, n bigint, errors bigint, revenue double, devices binary, opened binary, "
          "latency binary, sessions bigint, bounced bigint")


def _minute(time_col: str) -> Column:
    """End of the minute that holds the time."""
    return F.timestamp_seconds((F.floor(F.unix_seconds(F.col(time_col).cast("timestamp")) / 60) + 1) * 60)


def _minute_rows(rows: DataFrame, time_col: str, measures: dict[str, Column]) -> DataFrame:
    grouped = rows.groupBy("app_id", _minute(time_col).alias("minute")).agg(*[m.alias(n) for n, m in measures.items()])
    columns = [c.split(" ") for c in MINUTE.split(", ")]
    return grouped.select(*[
        F.col(name) if name in grouped.columns else F.lit(None).cast(kind).alias(name) for name, kind in columns])


def minute_metrics(events: DataFrame, vocabulary: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Per app and minute: counts and sketches that every longer alert window is merged from.

    Rows of one minute may come from several runs; merging them gives what one run over all would.
    """
    money = F.when(vocabulary.is_purchase(), vocabulary.revenue()).otherwise(F.lit(0.0))
    latency = F.when(vocabulary.is_api_call(), prop("latency_ms").try_cast("double"))
    return _minute_rows(events, "event_time", {
        "n": F.count("*"), "errors": F.count_if(vocabulary.is_error()), "revenue": F.sum(money),
        "devices": F.hll_sketch_agg("device_id", F.lit(14)),
        "opened": F.hll_sketch_agg(F.when(vocabulary.is_open(), F.col("user_id")), F.lit(14)),
        "latency": F.kll_sketch_agg_double(latency, SKETCH_K),
    })


def session_minutes(sessions: DataFrame) -> DataFrame:
    """Minute rows of session summaries, by start."""
    return _minute_rows(sessions, "started_at", {
        "sessions": F.count("*"), "bounced": F.count_if(F.col("event_count") == 1)})


def latency_quantile(sketch: Column, share: float) -> Column:
    """Quantile of a merged latency sketch; null for an empty one."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


def rule_values(rules: DataFrame, minutes: DataFrame, as_of: Column) -> DataFrame:
    """Value of each active rule's metric at ``as_of``, from minute rows.

    ``as_of`` is the end of a minute; it may also explode several, and every rule is then judged at each.
    Windows are whole minutes, ``dau`` counts from midnight.
    """
    judged = (
        rules.filter("active").withColumnRenamed("id", "rule_id")
        .select("rule_id", "app_id", "metric_name", "condition", "threshold", "window_mins", as_of.alias("as_of"))
    )
    rule = judged.columns
    age = F.unix_seconds("as_of") - F.unix_seconds("minute")
    in_window = age < F.col("window_mins").cast("bigint") * 60
    today = F.col("minute") > F.date_trunc("day", "as_of")
    recent = minutes.withColumnRenamed("app_id", "_app")
    here = lambda c: F.when(in_window, F.col(c))
    merged = (
        judged.join(recent, (F.col("app_id") == F.col("_app")) & (age >= 0) & (in_window | today), "left").groupBy(*rule)
        .agg(
            *[F.sum(here(c)).alias(c) for c in ("n", "errors", "revenue", "sessions", "bounced")],
            F.hll_sketch_estimate(F.hll_union_agg(here("devices"))).alias("devices"),
            F.hll_sketch_estimate(F.hll_union_agg(F.when(today, F.col("opened")))).alias("opened"),
            F.kll_merge_agg_double(here("latency")).alias("latency"),
        )
    )
    n, sessions = F.col("n"), F.col("sessions")
    metrics = {
        "event_count": n, "event_rate": n / F.col("window_mins"),
        "error_rate": 100.0 * F.col("errors") / n, "error_fraction": F.col("errors") / n,
        "active_users": F.col("devices"), "revenue_total": F.col("revenue"), "dau": F.col("opened"),
        "p95_latency": latency_quantile(F.col("latency"), 0.95), "p99_latency": latency_quantile(F.col("latency"), 0.99),
        "session_count": sessions, "bounce_rate": F.col("bounced") / sessions,
    }
    # A window without rows has null sums, and so no ratio.
    metric = F.col("metric_name")
    value = F.coalesce(*[F.when(metric == name, v.cast("double")) for name, v in metrics.items()])
    zero = F.when(metric.isin(*ZERO_WHEN_EMPTY), F.lit(0.0))
    return merged.select(*rule, F.coalesce(value, zero).alias("value"))


def evaluate_alerts(rules: DataFrame, metrics: DataFrame, as_of: TimeLike) -> DataFrame:
    """Fired rows of the active rules."""
    latest = metrics.withColumnRenamed("metric", "metric_name")
    joined = rules.filter("active").join(latest, ["app_id", "metric_name", "window_mins"], "left")
    value = F.coalesce(
        F.col("value"), F.when(F.col("metric_name").isin(*ZERO_WHEN_EMPTY), F.lit(0.0))
    )
    return (
        joined.withColumn("value", value)
        .filter(breached(F.col("value"), F.col("condition"), F.col("threshold")))
        .select(F.col("id").alias("rule_id"), "app_id", "metric_name", "window_mins", "condition",
                "threshold", "value", timestamp(as_of).alias("fired_at"))
    )


def apply_cooldown(
    fired: DataFrame,
    cooldown: Column | int = 1800,
    keys: Sequence[str] = ("rule_id",),
    time_col: str = "fired_at",
) -> DataFrame:
    """Rows that are sent: the first of each key, then each that comes at least its own wait after the last one sent.

    Time counts in whole seconds and a missing cooldown is none; inside a second rows are in order of time and
    the other columns. Which seconds are sent is a greedy selection over (key, day), so a key with most of the
    rows is spread over its days.
    """
    keys = list(keys)
    wait = cooldown if isinstance(cooldown, Column) else F.lit(cooldown)
    placed = (
        fired.withColumn("_sec", F.unix_seconds(time_col))
        .withColumn("_floor", F.col("_sec") - F.greatest(F.coalesce(wait.cast("bigint"), F.lit(0)), F.lit(0)))
    )
    seconds = placed.groupBy(*keys, "_sec").agg(F.max("_floor").alias("_floor"))
    sent = greedy(seconds, keys, "_sec", "_floor", 86_400).select("_key", "_sec", "_before")
    others = [c for c in fired.columns if c not in keys and c != time_col and _orderable(fired, c)]
    of_second = Window.partitionBy("_key", "_sec")
    allowed = F.col("_before").isNull() | (F.col("_floor") >= F.col("_before"))
    return (
        placed.withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
        .join(sent, ["_key", "_sec"])
        .withColumn("_place", F.row_number().over(of_second.orderBy(time_col, *others)))
        .withColumn("_first", F.min(F.when(allowed, F.col("_place"))).over(of_second))
        .filter((F.col("_place") == F.col("_first")) | ((F.col("_place") > F.col("_first")) & (F.col("_floor") == F.col("_sec"))))
        .select(*fired.columns)
    )


def _orderable(df: DataFrame, column: str) -> bool:
    return "map" not in df.schema[column].dataType.simpleString()


def last_fired(rules: DataFrame, fired: DataFrame) -> DataFrame:
    """Every rule with its latest firing."""
    latest = fired.groupBy("rule_id").agg(F.max("fired_at").alias("_fired"))
    return rules.drop("last_fired_at").join(
        latest, rules["id"] == latest["rule_id"], "left"
    ).drop("rule_id").withColumnRenamed("_fired", "last_fired_at")
