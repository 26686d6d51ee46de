"""The fact table: reading, writing, archiving and expiring events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickspan.functions.time import TimeLike, scope
from clickspan.operators.ingest import EVENT_KEY, dedup_events
from clickspan.plans.ingest import ingest_batch
from clickspan.schema import EVENTS

PARTITIONS = ["event_date", "app_id"]
SORT_KEY = ["app_id", "event_name", "event_time", "user_id"]


def read_events(
    spark: SparkSession,
    path: str,
    app_id: str | None = None,
    start: TimeLike | None = None,
    end: TimeLike | None = None,
) -> DataFrame:
    """Events of a tenant in an inclusive time range; partitions outside it are not listed."""
    events = spark.read.schema(f"{EVENTS}, event_date date").parquet(path)
    return scope(events, app_id, start, end)


def arrange(events: DataFrame) -> DataFrame:
    """Place rows for a partitioned write, sorted for file statistics.

    The rebalance hint lets Spark split a tenant's day that is too large for one task and put small
    ones together, from the sizes it measures in the shuffle.
    """
    return events.hint("rebalance", *PARTITIONS).sortWithinPartitions("event_date", *SORT_KEY)


def with_date(events: DataFrame) -> DataFrame:
    if "event_date" in events.columns:
        return events
    return events.withColumn("event_date", F.to_date("event_time"))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append fact rows, partitioned by day and tenant."""
    arrange(with_date(events)).write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def write_events_batch(events: DataFrame, path: str, batch_id: int, writer: str = "stream") -> bool:
    """Append a stream's batch once, sorted, in files of measured size; false where it is in already.

    The batch is written aside, its files get names that tell the batch and are moved in, and a marker says that it
    is complete. A repeated batch without a marker first takes out the files that its earlier run has moved.
    """
    spark = events.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    name = f"{writer}-{batch_id:010d}"
    marker, aside = at(f"{path}/_batches/{name}"), f"{path}/_aside/{name}"
    if fs.exists(marker):
        return False
    arrange(with_date(events)).write.mode("overwrite").partitionBy(*PARTITIONS).parquet(aside)
    found, left = fs.listFiles(at(aside), True), at(aside).toUri().getPath()
    folders: dict[str, list] = {}
    while found.hasNext():
        file = found.next().getPath()
        if file.getName().startswith("part-"):
            folders.setdefault(file.getParent().toUri().getPath()[len(left):], []).append(file)
    for folder, files in folders.items():
        target = at(f"{path}{folder}")
        fs.mkdirs(target)
        for known in fs.globStatus(at(f"{path}{folder}/{name}-*")) or []:
            fs.delete(known.getPath(), False)
        for i, file in enumerate(files):
            if not fs.rename(file, at(f"{path}{folder}/{name}-{i:05d}.parquet")):
                raise OSError(f"could not move {file}")
    fs.delete(at(aside), True)
    fs.create(marker, True).close()
    return True


def new_rows(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming events that are not in the archive yet, each id of a tenant's device once."""
    return dedup_events(incoming).join(existing.select(*EVENT_KEY), list(EVENT_KEY), "left_anti")


def archive_raw(incoming: DataFrame, path: str) -> None:
    """Append events to the archive; ids that are already there are skipped.

    The days of the batch, a handful after validation, become literal partition predicates, so only
    those archive partitions are read.
    """
    incoming = dedup_events(with_date(incoming)).persist()
    try:
        fresh, spark = incoming, incoming.sparkSession
        if path_exists(spark, path):
            days = [row[0] for row in incoming.select("event_date").distinct().collect()]
            stored = spark.read.schema(f"{EVENTS}, event_date date").parquet(path)
            known = stored.filter(F.col("event_date").isin(days)).select(*EVENT_KEY)
            fresh = incoming.join(known, list(EVENT_KEY), "left_anti")
        arrange(fresh).write.mode("append").partitionBy(*PARTITIONS).parquet(path)
    finally:
        incoming.unpersist()


def raw_events_lookup(
    events: DataFrame,
    app_id: str | None = None,
    start: TimeLike | None = None,
    end: TimeLike | None = None,
    limit: int = 100,
) -> DataFrame:
    """Newest raw events of a range."""
    return scope(events, app_id, start, end).orderBy(
        F.desc("event_time"), F.desc("event_id")
    ).limit(limit)


def unexpired(rows: DataFrame, days: int, as_of: dt.date | str, date_col: str = "event_date") -> DataFrame:
    """Rows inside the retention period."""
    return rows.filter(F.col(date_col) >= F.date_sub(F.lit(str(as_of)).cast("date"), days))


def expire(spark: SparkSession, path: str, days: int, as_of: dt.date, date_col: str = "event_date") -> list[str]:
    """Delete the date partitions older than the retention period; no kept row is rewritten."""
    oldest = (as_of - dt.timedelta(days=days)).isoformat()
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    removed = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{date_col}=") and name.split("=", 1)[1] < oldest:
            fs.delete(status.getPath(), True)
            removed.append(name.split("=", 1)[1])
    return sorted(removed)


def path_exists(spark: SparkSession, path: str) -> bool:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)


def percent_text(rate: Column) -> Column:
    """0.1234 -> ``12.3%``."""
    return F.concat(F.format_string("%.1f", rate * 100.0), F.lit("%"))


def retention_csv_rows(cohorts: DataFrame) -> DataFrame:
    """Retention in wide form with rates as percent text."""
    days = F.concat(F.lit("day_"), F.col("day_n"))
    return cohorts.groupBy("app_id", "install_date", "cohort_size").agg(
        F.map_from_entries(F.sort_array(F.collect_list(
            F.struct(days.alias("day"), percent_text(F.col("rate")).alias("text"))
        ))).alias("_rates")
    )


def export_csv(cohorts: DataFrame, path: str, day_ns: list[int]) -> None:
    """Write the retention table as CSV."""
    retention_csv_rows(cohorts).select(
        "app_id", "install_date", "cohort_size",
        *[F.col("_rates")[f"day_{n}"].alias(f"day_{n}") for n in day_ns],
    ).write.mode("overwrite").option("header", True).csv(path)


def replay_messages(
    dead: DataFrame, start: TimeLike | None = None, end: TimeLike | None = None
) -> DataFrame:
    """Dead letters back as raw messages, ready for the ingest transforms."""
    return scope(dead, start=start, end=end, time_col="ts").select(
        F.unbase64("original_payload").cast("string").alias("value"), F.col("ts").alias("timestamp")
    )


def replay(
    dead: DataFrame, ip_ranges: DataFrame, existing: DataFrame,
    start: TimeLike | None = None, end: TimeLike | None = None,
) -> DataFrame:
    """Events of replayed dead letters that are not stored yet."""
    return new_rows(ingest_batch(replay_messages(dead, start, end), ip_ranges).events, existing)
