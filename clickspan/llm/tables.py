"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder (local master) or the warehouse."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="clickspan-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        return _OWN[0]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read again: it is computed once, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table of the driver."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
