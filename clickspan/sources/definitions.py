"""Definition tables: funnels, cohorts, alert rules, experiments, campaigns, apps, address ranges.

They are written by people and stay small; none is broadcast by hint, Spark decides by their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickspan.schema import DEFINITIONS


def load_definitions(
    spark: SparkSession,
    kind: str,
    path: str | None = None,
    jdbc: dict[str, str] | None = None,
    active_only: bool = False,
) -> DataFrame:
    """Read one kind of definition from parquet or over JDBC.

    Alert streams call this at every tick; funnel and campaign streams follow ``definition_changes``.
    """
    if kind not in DEFINITIONS:
        raise ValueError(f"kind must be one of {sorted(DEFINITIONS)}")
    if jdbc is not None:
        table = spark.read.format("jdbc").options(**jdbc).load()
    elif path is not None:
        table = spark.read.schema(DEFINITIONS[kind]).parquet(f"{path}/{kind}")
    else:
        raise ValueError("give a path or JDBC options")
    if active_only and "active" in table.columns:
        table = table.filter(F.col("active"))
    return table


def definition_changes(spark: SparkSession, kind: str, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """A stream of definition versions: the columns of the kind and ``valid_from``, the time they hold from."""
    if kind not in DEFINITIONS:
        raise ValueError(f"kind must be one of {sorted(DEFINITIONS)}")
    return spark.readStream.schema(f"{DEFINITIONS[kind]}, valid_from timestamp").option(
        "maxFilesPerTrigger", max_files_per_trigger).parquet(f"{path}/{kind}")
