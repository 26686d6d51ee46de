"""Running aggregates per key that never put one key into one task.

A plain ``Window.partitionBy(user)`` sends a hot user's whole history to a single task. Here every
key is cut into fixed time chunks: rows are ordered inside (key, chunk), each chunk is reduced to
one summary row, the summaries are scanned per key, and the carry is joined back. The largest group
is one key's rows within one chunk; the per-key scan sees at most one row per chunk of the range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"


@dataclass(frozen=True)
class Running:
    """A running ``sum``, or the ``latest`` non-null value.

    A ``latest`` value is a struct that starts with the row's position, so the maximum is the most
    recent one and any value of the current chunk is newer than the carry.
    """

    kind: str
    value: Column

    def aggregate(self) -> Column:
        return F.sum(self.value) if self.kind == "sum" else F.max(self.value)

    def combine(self, local: Column, carry: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
        return F.coalesce(local, carry)


def in_chunks(df: DataFrame, position: Column, length: int) -> DataFrame:
    """Add the row's position (an integer) and the chunk it falls into."""
    return df.withColumn("_pos", position).withColumn(CHUNK, F.floor(F.col("_pos") / F.lit(length)))


def running(
    placed: DataFrame, keys: list[str], measures: dict[str, Running], backwards: bool = False
) -> DataFrame:
    """Add running measures over the rows of ``in_chunks`` up to and including the current one.

    Rows that share a position see each other; ``backwards`` runs from the last row to the first.
    Chunk and position columns stay, so a second scan finds its rows already partitioned.
    """
    values = placed.select("*", *[m.value.alias(f"_v_{n}") for n, m in measures.items()])
    refs = {n: Running(m.kind, F.col(f"_v_{n}")) for n, m in measures.items()}
    direction = F.desc if backwards else F.asc

    within = Window.partitionBy(CHUNK, *reversed(keys)).orderBy(direction("_pos"))
    local = values.select(
        *placed.columns, *[ref.aggregate().over(within).alias(f"_l_{n}") for n, ref in refs.items()]
    )
    chunks = values.groupBy(*keys, CHUNK).agg(
        *[ref.aggregate().alias(f"_v_{n}") for n, ref in refs.items()]
    )
    passed = Window.partitionBy(*keys).orderBy(direction(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carries = chunks.select(
        *keys, CHUNK, *[ref.aggregate().over(passed).alias(f"_c_{n}") for n, ref in refs.items()]
    )
    return local.join(carries, [*keys, CHUNK], "left").select(
        *placed.columns,
        *[ref.combine(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, ref in refs.items()],
    )
