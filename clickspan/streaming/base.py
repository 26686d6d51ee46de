"""Settings shared by the streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickspan.session import STATE_STORE, configure

DELAY = "60 seconds"


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime options plus the RocksDB state store the stateful operators need."""
    configure(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def checkpoint_location(spark: SparkSession, name: str, location: str | None = None) -> str:
    """Checkpoint folder of a stream: the given one, else below ``spark.checkpoint.dir``."""
    if location is not None:
        return location
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        raise ValueError("give a checkpoint location or set spark.checkpoint.dir")
    return f"{shared.rstrip('/')}/streams/{name}"


def with_watermark(events: DataFrame, time_col: str = "event_time", delay: str = DELAY) -> DataFrame:
    """Watermark on a zoned timestamp; a timestamp without zone cannot carry one."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)


def split_late(events: DataFrame, delay: str = DELAY) -> tuple[DataFrame, DataFrame]:
    """(on time, late): rows that reached the server later than the allowed delay."""
    late = F.col("server_time") > F.col("event_time") + F.expr(f"INTERVAL {delay}")
    return events.filter(~late), events.filter(late).select(
        F.base64(F.to_json(F.struct("*")).cast("binary")).alias("original_payload"),
        F.lit("late event").alias("error"), F.col("server_time").alias("ts"),
    )
