"""Deduplication that accounts for every row.

``dedup_stream`` drops what it doesn't keep. Here each row comes out tagged: ``kept``, ``duplicate``, or ``late`` when
its id may already have been forgotten. Ids are state of (app, shard); each shard has a clock of its own, the
latest time it has seen, and forgets ids ``ttl`` before it, so no watermark drops rows on the way in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from clickspan.functions.time import seconds
from clickspan.operators import ingest
from clickspan.streaming.sessions import ROW_TIMES

SHARDS = 256
#: Microseconds of ids that are forgotten together.
PIECE = 600_000_000
KEPT, DUPLICATE, LATE = "kept", "duplicate", "late"


class DedupProcessor(StatefulProcessor):
    """Tags rows by the ids seen within the time to live."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id string", "t bigint")
        self.pieces = handle.getMapState("pieces", "piece bigint", "ids array<string>")
        self.latest = handle.getValueState("latest", "t bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["t", "row"], kind="stable")
        latest = self.latest.get()[0] if self.latest.exists() else None
        oldest = None if latest is None else latest - self.ttl_us
        tags, fresh = [], {}
        known: dict[str, bool] = {}
        for t, event in zip(frame["t"].tolist(), frame["id"].tolist()):
            if event not in known:
                known[event] = self.seen.containsKey((event,))
            if oldest is not None and t < oldest:
                tags.append(LATE)
            elif known[event]:
                tags.append(DUPLICATE)
            else:
                known[event] = True
                self.seen.updateValue((event,), (t,))
                fresh.setdefault(t // PIECE, []).append(event)
                tags.append(KEPT)
        for piece, ids in fresh.items():
            held = list(self.pieces.getValue((piece,))[0]) if self.pieces.containsKey((piece,)) else []
            self.pieces.updateValue((piece,), (held + ids,))
        self._forget(max(int(frame["t"].max()), latest if latest is not None else int(frame["t"].max())))
        yield pd.DataFrame({"tag": tags, "row": frame["row"].to_numpy()})

    def _forget(self, latest: int) -> None:
        self.latest.update((latest,))
        for piece in [p[0] for p in self.pieces.keys() if (p[0] + 1) * PIECE <= latest - self.ttl_us]:
            for event in self.pieces.getValue((piece,))[0]:
                self.seen.removeKey((event,))
            self.pieces.removeKey((piece,))

    def close(self) -> None:
        pass


def tagged_stream(
    events: DataFrame,
    ttl: str | int = "24 hours",
    keys: Sequence[str] = ingest.EVENT_KEY,
    time_col: str = "server_time",
    shards: int = SHARDS,
) -> DataFrame:
    """Every row of the stream with ``tag``: kept, duplicate or late.

    A row without ``time_col`` counts as of the beginning of time: kept while its shard is new, late afterwards.
    """
    identity = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = events.select(
        F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int").alias("shard"), identity.alias("id"),
        F.coalesce(F.unix_micros(F.col(time_col).cast("timestamp")), F.lit(0)).alias("t"),
        F.to_json(F.struct(*events.columns), ROW_TIMES).alias("row"))
    found = rows.groupBy("shard").transformWithStateInPandas(
        DedupProcessor(seconds(ttl) * 1_000_000), "tag string, row string", "Append", "None")
    return found.select("tag", F.from_json("row", events.schema, ROW_TIMES).alias("_e")).select("tag", "_e.*")
