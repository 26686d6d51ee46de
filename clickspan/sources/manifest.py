"""Tables whose live parts are listed in a manifest.

A table is a folder of parts, each a Parquet data set by day that is written once, and of numbered manifests.
The newest manifest lists the live (part, day) pairs and the batches that are in. A change is prepared aside and
becomes visible as a whole when the next manifest is created; that creation fails when another writer was first,
and is then repeated on top of the other's. So a stream may go on while days are compacted or expired, a batch
that is repeated adds nothing, and a crash between the steps leaves files that no manifest lists.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "_day"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def state(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest manifest; 0 and nothing for a new table."""
    files, at = _files(spark, path)
    folder = at(f"{path}/manifests")
    if not files.exists(folder):
        return 0, {"live": [], "batches": {}}
    numbers = [int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()]
    if not numbers:
        return 0, {"live": [], "batches": {}}
    stream = files.open(at(f"{path}/manifests/{max(numbers):012d}"))
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return max(numbers), json.loads(text)


def change(spark: SparkSession, path: str, edit: Callable[[dict], dict | None], attempts: int = 20) -> bool:
    """Put ``edit`` of the newest manifest in its place; false where it gives None, for nothing to do."""
    files, at = _files(spark, path)
    for _ in range(attempts):
        number, now = state(spark, path)
        after = edit(now)
        if after is None:
            return False
        # Written aside and renamed: a manifest is there as a whole or not at all, and a rename doesn't replace.
        aside, target = at(f"{path}/manifests/.{uuid.uuid4().hex}"), at(f"{path}/manifests/{number + 1:012d}")
        stream = files.create(aside, True)
        stream.write(bytearray(json.dumps(after).encode()))
        stream.close()
        if not files.exists(target) and files.rename(aside, target):
            return True
        files.delete(aside, False)
    raise RuntimeError(f"{path}: other writers were first {attempts} times")


def _write(rows: DataFrame, path: str, part: str, day: str, order: list[str]) -> list[list[str]]:
    """Write a part by day, sorted, a file per measured size; the (part, day) pairs in it."""
    placed = rows.withColumn(DAY, F.coalesce(F.to_date(F.col(day)).cast("string"), F.lit("none")))
    target = f"{path}/parts/{part}"
    placed.hint("rebalance", DAY).sortWithinPartitions(DAY, *order).write.mode("overwrite").partitionBy(DAY).parquet(target)
    files, at = _files(rows.sparkSession, path)
    names = [f.getPath().getName() for f in files.listStatus(at(target)) if f.isDirectory()]
    return [[part, name.split("=", 1)[1]] for name in names if name.startswith(f"{DAY}=")]


def append(rows: DataFrame, path: str, writer: str, batch_id: int, day: str, order: list[str] = ()) -> bool:
    """Add a batch of ``writer``; false where it is in already, however it was interrupted before."""
    spark = rows.sparkSession
    if state(spark, path)[1]["batches"].get(writer, -1) >= batch_id:
        return False
    found = _write(rows, path, f"{writer}-{batch_id}", day, list(order))

    def add(now: dict) -> dict | None:
        if now["batches"].get(writer, -1) >= batch_id:
            return None
        return {"live": now["live"] + found, "batches": now["batches"] | {writer: batch_id}}

    return change(spark, path, add)


def read(spark: SparkSession, path: str, schema: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Live rows, of the days from ``first`` to ``last`` where they are given."""
    folders: dict[str, None] = {}
    for part, day in state(spark, path)[1]["live"]:
        if (first is None or day >= first) and (last is None or day <= last):
            folders[f"{path}/parts/{part}/{DAY}={day}"] = None
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def compact(spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], day: str,
            before: str, order: list[str] = ()) -> bool:
    """Put one merged part in the place of the live parts of the days before ``before``."""
    old = [pair for pair in state(spark, path)[1]["live"] if pair[1] < before]
    if len({pair[1] for pair in old}) == len(old):
        return False  # every day is one part already
    rows = read(spark, path, schema, last=max(pair[1] for pair in old))
    found = _write(merge(rows), path, f"compact-{uuid.uuid4().hex}", day, list(order))

    def swap(now: dict) -> dict | None:
        if any(pair not in now["live"] for pair in old):
            return None  # expired or compacted by another
        return now | {"live": [pair for pair in now["live"] if pair not in old] + found}

    return change(spark, path, swap)


def expire(spark: SparkSession, path: str, before: str) -> bool:
    """Take the days before ``before`` out of the table."""
    def drop(now: dict) -> dict | None:
        live = [pair for pair in now["live"] if pair[1] >= before]
        return None if len(live) == len(now["live"]) else now | {"live": live}

    return change(spark, path, drop)


def vacuum(spark: SparkSession, path: str, older_than_s: int = 86_400) -> int:
    """Delete day folders that no manifest lists and that nobody has written to for a while; how many there were."""
    files, at = _files(spark, path)
    live = {tuple(pair) for pair in state(spark, path)[1]["live"]}
    now, gone = spark.sparkContext._jvm.java.lang.System.currentTimeMillis(), 0
    parts = at(f"{path}/parts")
    for part in files.listStatus(parts) if files.exists(parts) else []:
        for folder in files.listStatus(part.getPath()):
            name = folder.getPath().getName()
            listed = name.startswith(f"{DAY}=") and (part.getPath().getName(), name.split("=", 1)[1]) in live
            if name.startswith(f"{DAY}=") and not listed and now - folder.getModificationTime() > older_than_s * 1000:
                files.delete(folder.getPath(), True)
                gone += 1
    return gone
