"""A/B experiments: assignment, results, significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspan.functions.stats import safe_ratio, two_sided_p
from clickspan.vocabulary import DEFAULT_VOCABULARY, Vocabulary

SLOTS = 10_000


def assign_variant(users: DataFrame, experiments: DataFrame) -> DataFrame:
    """Stable variant per (experiment, user): an md5 slot against the cumulative weights."""
    total = F.aggregate("variants", F.lit(0), lambda acc, v: acc + v["weight"])
    bounds = F.transform("variants", lambda v, i: F.struct(
        v["name"].alias("name"),
        F.aggregate(F.slice("variants", F.lit(1), i + 1), F.lit(0),
                    lambda acc, w: acc + w["weight"]).alias("upto"),
    ))
    digest = F.md5(F.concat_ws(":", "experiment_id", "user_id"))
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % SLOTS
    first = F.get(
        F.filter("_bounds", lambda b: F.col("_slot") * F.col("_total") < b["upto"] * SLOTS), F.lit(0)
    )
    running = experiments.filter(F.size("variants") > 0).select(
        "app_id", F.col("id").alias("experiment_id"), bounds.alias("_bounds"), total.alias("_total")
    )
    return users.select("app_id", "user_id").join(running, "app_id").withColumn(
        "_slot", slot
    ).select("experiment_id", "app_id", "user_id", first["name"].alias("variant"))


def latest_assignments(assignments: DataFrame) -> DataFrame:
    """Newest assignment per (experiment, user)."""
    newest = Window.partitionBy("experiment_id", "user_id").orderBy(
        F.desc("assigned_at"), F.desc("variant")
    )
    return assignments.withColumn("_rank", F.row_number().over(newest)).filter(
        F.col("_rank") == 1
    ).drop("_rank")


def _compare(points: DataFrame, by: list[str]) -> DataFrame:
    """Conversion, lift and p-value against the ``control`` variant."""
    control = Window.partitionBy(*by)

    def of_control(column: str) -> Column:
        return F.max(F.when(F.col("variant") == "control", F.col(column))).over(control)

    rated = points.withColumn(
        "conversion_pct", 100.0 * safe_ratio(F.col("converting_users"), F.col("users"))
    )
    x0, n0, pct0 = of_control("converting_users"), of_control("users"), of_control("conversion_pct")
    other = F.col("variant") != "control"
    x, n = F.col("converting_users"), F.col("users")
    pooled = (x + F.col("_x0")) / (n + F.col("_n0"))
    error = F.sqrt(pooled * (1.0 - pooled) * (1.0 / n + 1.0 / F.col("_n0")))
    z = (x / n - F.col("_x0") / F.col("_n0")) / error
    return (
        rated.withColumn("_x0", x0).withColumn("_n0", n0).withColumn("_pct0", pct0)
        .withColumn("lift_pct", F.when(
            other & (F.col("_pct0") > 0),
            100.0 * (F.col("conversion_pct") - F.col("_pct0")) / F.col("_pct0"),
        ))
        .withColumn("p_value", F.when(
            other & F.col("_n0").isNotNull(),
            F.when(error > 0, two_sided_p(z)).otherwise(F.lit(1.0)),
        ))
        .drop("_x0", "_n0", "_pct0")
    )


def experiment_results(
    events: DataFrame,
    assignments: DataFrame,
    goal_event: str,
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Per variant: users, goal events, converting users, revenue, lift and p-value.

    Events are reduced to one row per user before the join; users without events stay.
    """
    paid = vocabulary.is_purchase()
    per_user = events.filter((F.col("event_name") == goal_event) | paid).groupBy(
        "app_id", "user_id"
    ).agg(
        F.count_if(F.col("event_name") == goal_event).alias("_goals"),
        F.sum(F.when(paid, vocabulary.revenue()).otherwise(F.lit(0.0))).alias("_revenue"),
    )
    points = (
        latest_assignments(assignments).join(per_user, ["app_id", "user_id"], "left")
        .groupBy("experiment_id", "app_id", "variant")
        .agg(
            F.count("*").alias("users"),
            F.coalesce(F.sum("_goals"), F.lit(0)).alias("goal_events"),
            F.count_if(F.col("_goals") > 0).alias("converting_users"),
            F.coalesce(F.sum("_revenue"), F.lit(0.0)).alias("revenue"),
        )
    )
    return _compare(points, ["experiment_id", "app_id"])


def experiment_goals(
    events: DataFrame, assignments: DataFrame, experiments: DataFrame
) -> DataFrame:
    """``experiment_results`` for every goal of every experiment in one plan."""
    goals = experiments.select(
        F.col("id").alias("experiment_id"), "app_id", F.inline("metric_goals")
    ).select("experiment_id", "app_id", F.col("metric").alias("goal"), F.col("type").alias("goal_type"))
    names = goals.select("app_id", F.col("goal").alias("event_name")).distinct()
    per_user = events.join(names, ["app_id", "event_name"], "left_semi").groupBy(
        "app_id", "user_id", F.col("event_name").alias("goal")
    ).agg(F.count("*").alias("_goals"))
    points = (
        latest_assignments(assignments).join(goals, ["experiment_id", "app_id"])
        .join(per_user, ["app_id", "user_id", "goal"], "left")
        .groupBy("experiment_id", "app_id", "goal", "goal_type", "variant")
        .agg(
            F.count("*").alias("users"),
            F.coalesce(F.sum("_goals"), F.lit(0)).alias("goal_events"),
            F.count_if(F.col("_goals") > 0).alias("converting_users"),
        )
    )
    return _compare(points, ["experiment_id", "app_id", "goal"])
