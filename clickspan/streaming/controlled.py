"""Streams whose definitions change while they run.

Definition versions are a stream of their own, joined to the rows inside one stateful operator: both are dealt by
(app, shard), every version to all shards and every user to one, and the operator keeps the versions in state.
A version holds from its ``valid_from`` on until the next one of the same id, by event time, so a result doesn't
depend on when the version arrived, as long as it came before the watermark passed the rows it is for.

Rows wait in pieces of time until the watermark has passed them and are then read in order. A new row rewrites
its own piece only; what is known of a user is an entry of its own.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from clickspan.functions.text import not_blank
from clickspan.streaming.base import DELAY, with_watermark

SHARDS = 64
#: Microseconds of rows that are kept together, and of expiry that is looked at together. State counts in microseconds.
PIECE, EXPIRY = 60_000_000, 3_600_000_000

Versions = dict[str, list[tuple[int, dict]]]
Row = tuple[int, str, str, list]


def controlled(
    rows: DataFrame,
    changes: DataFrame,
    definition_id: str,
    time_col: str = "event_time",
    delay: str = DELAY,
    shards: int = SHARDS,
    segments: Column | None = None,
) -> DataFrame:
    """Rows (app, user, event, time) and definition versions in one stream, dealt by (app_id, shard).

    ``changes`` has app_id, the id, ``valid_from`` and what else the definition says, which travels as JSON.
    """
    shard = F.pmod(F.xxhash64("user_id"), F.lit(shards)).cast("int")
    nothing = F.lit(None)
    events = rows.filter(not_blank("user_id")).select(
        "app_id", shard.alias("shard"), F.col(time_col).cast("timestamp").alias("event_time"),
        F.unix_micros(F.col(time_col).cast("timestamp")).alias("t"), "user_id", "event_name",
        (F.array().cast("array<string>") if segments is None else segments).alias("segments"),
        nothing.cast("string").alias("definition"), nothing.cast("string").alias("body"))
    # Versions have no event time: they neither move the watermark nor can they be late.
    versions = changes.select(
        "app_id", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), nothing.cast("timestamp").alias("event_time"),
        F.unix_micros(F.col("valid_from").cast("timestamp")).alias("t"), nothing.cast("string").alias("user_id"),
        nothing.cast("string").alias("event_name"), F.array().cast("array<string>").alias("segments"),
        F.col(definition_id).alias("definition"), F.to_json(F.struct(*changes.columns)).alias("body"))
    return with_watermark(events.unionByName(versions), "event_time", delay)


class ControlledProcessor(StatefulProcessor):
    """Subclasses say what a version looks like and what a user's row does."""

    #: Layout of what is kept for (definition, user).
    progress_schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("versions", "definition string, t bigint", "body string")
        self.waiting = handle.getMapState("waiting", "piece bigint", "rows array<string>")
        self.progress = handle.getMapState("progress", "definition string, version bigint, user string", self.progress_schema)
        self.expiry = handle.getMapState("expiry", "piece bigint", "keys array<string>")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark, earliest = timerValues.getCurrentWatermarkInMs() * 1000, None
        for frame in rows:
            told = frame["definition"].notna()
            for t, definition, body in frame.loc[told, ["t", "definition", "body"]].itertuples(index=False, name=None):
                self.known.updateValue((definition, int(t)), (body,))
            events = frame[~told]
            for piece, part in events.groupby(events["t"] // PIECE):
                held = list(self.waiting.getValue((int(piece),))[0]) if self.waiting.containsKey((int(piece),)) else []
                held += [json.dumps([int(t), u, n, list(s)]) for t, u, n, s in
                         part[["t", "user_id", "event_name", "segments"]].itertuples(index=False, name=None)]
                self.waiting.updateValue((int(piece),), (held,))
                earliest = min(earliest, int(part["t"].min())) if earliest is not None else int(part["t"].min())
        if earliest is not None:
            self._wake(max(earliest, watermark + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        due: list[Row] = []
        for piece in sorted(p[0] for p in self.waiting.keys()):
            if piece * PIECE > watermark:
                self._wake(max(piece * PIECE, watermark + 1))
                break
            rows = [json.loads(r) for r in self.waiting.getValue((piece,))[0]]
            later = [r for r in rows if r[0] > watermark]
            due += [tuple(r) for r in rows if r[0] <= watermark]
            if later:
                self.waiting.updateValue((piece,), ([json.dumps(r) for r in later],))
                self._wake(max(min(r[0] for r in later), watermark + 1))
            else:
                self.waiting.removeKey((piece,))
        versions: Versions = {}
        for (definition, t), (body,) in self.known.iterator():
            versions.setdefault(definition, []).append((t, json.loads(body)))
        for found in versions.values():
            found.sort(key=lambda v: v[0])
        out = self.consume(key, versions, due) if due else []
        self._forget(watermark)
        if out:
            yield pd.DataFrame(out)

    def consume(self, key: tuple, versions: Versions, rows: list[Row]) -> list[dict]:
        """Output records of rows that are all behind the watermark."""
        raise NotImplementedError

    def dead(self, value: tuple, watermark: int, version: dict) -> bool:
        """Whether what is kept can no longer matter."""
        raise NotImplementedError

    def at(self, versions: list[tuple[int, dict]], t: int) -> tuple[int, dict] | None:
        """The version in effect at ``t``."""
        i = bisect_right(versions, t, key=lambda v: v[0])
        return versions[i - 1] if i else None

    def put(self, key: tuple, value: tuple, until: int) -> None:
        """Keep ``value`` for (definition, version, user) up to ``until`` at least."""
        fresh = not self.progress.containsKey(key)
        self.progress.updateValue(key, value)
        if fresh:
            self._expire(key, until)

    def close(self) -> None:
        pass

    def _expire(self, key: tuple, until: int) -> None:
        piece = until // EXPIRY + 1
        held = list(self.expiry.getValue((piece,))[0]) if self.expiry.containsKey((piece,)) else []
        self.expiry.updateValue((piece,), ([*held, json.dumps(key)],))
        self._wake(piece * EXPIRY)

    def _forget(self, watermark: int) -> None:
        for piece in sorted(p[0] for p in self.expiry.keys()):
            if piece * EXPIRY > watermark:
                self._wake(piece * EXPIRY)
                break
            keys = [tuple(json.loads(k)) for k in self.expiry.getValue((piece,))[0]]
            self.expiry.removeKey((piece,))
            for key in keys:
                if self.progress.containsKey(key):
                    value = tuple(self.progress.getValue(key))
                    body = json.loads(self.known.getValue(key[:2])[0])
                    if self.dead(value, watermark, body):
                        self.progress.removeKey(key)
                    else:
                        self._expire(key, watermark + EXPIRY)

    def _wake(self, time: int) -> None:
        """One timer per key, the earliest asked for; timers count in milliseconds."""
        at = time // 1000 + 1
        known = self.timer.get()[0] if self.timer.exists() else None
        if known is not None and known <= at:
            return
        if known is not None:
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.timer.update((at,))
