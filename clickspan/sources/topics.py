"""Message topics. The Kafka connector is a deployment jar; files with the same layout stand in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

RAW_COLUMNS = "key string, value string, timestamp timestamp"


def read_raw_stream(
    spark: SparkSession,
    path: str | None = None,
    bootstrap_servers: str | None = None,
    topic: str = "raw-events",
    max_offsets_per_trigger: int = 5_000_000,
    max_files_per_trigger: int = 1000,
) -> DataFrame:
    """Stream of ``key, value, timestamp`` from Kafka, or from parquet files of that layout."""
    if bootstrap_servers is not None:
        stream = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap_servers)
            .option("subscribe", topic)
            .option("maxOffsetsPerTrigger", max_offsets_per_trigger)
            .option("failOnDataLoss", "true")
            .load()
        )
        return stream.select(
            F.col("key").cast("string"), F.col("value").cast("string"), "timestamp"
        )
    if path is None:
        raise ValueError("give a path or Kafka bootstrap servers")
    return (
        spark.readStream.schema(RAW_COLUMNS)
        .option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
    )


def topic_rows(df: DataFrame, key_cols: Sequence[str] = ("app_id", "device_id")) -> DataFrame:
    """Rows as messages: JSON value, key ``app_id:device_id``."""
    return df.select(
        F.concat_ws(":", *key_cols).alias("key"), F.to_json(F.struct("*")).alias("value")
    )


def write_topic(
    df: DataFrame,
    topic: str,
    bootstrap_servers: str | None = None,
    path: str | None = None,
    key_cols: Sequence[str] = ("app_id", "device_id"),
) -> None:
    """Publish a batch (also inside ``foreachBatch``) to Kafka or to a folder per topic."""
    rows = topic_rows(df, key_cols)
    if bootstrap_servers is not None:
        rows.write.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers).option(
            "topic", topic
        ).save()
    elif path is not None:
        rows.withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(f"{path}/{topic}")
    else:
        raise ValueError("give a path or Kafka bootstrap servers")


def stream_topic(
    df: DataFrame, topic: str, bootstrap_servers: str, checkpoint: str,
    key_cols: Sequence[str] = ("app_id", "device_id"),
) -> DataStreamWriter:
    """Streaming writer to a Kafka topic."""
    return (
        topic_rows(df, key_cols).writeStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("topic", topic).option("checkpointLocation", checkpoint)
    )
