"""Sessions from an event stream.

A device's open sessions are kept as summaries that merge: events may come in any order, a batch is first
summed up by gaps, and its pieces are joined to the open sessions they touch. Nothing waits for the watermark
but the end of a session, so a start is told in the batch it arrives in. If an earlier event comes later, or
an event closes the gap between two sessions, the start is told again with the ids that it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from clickspan.functions.text import not_blank, prop
from clickspan.functions.time import seconds
from clickspan.operators.sessions import session_id
from clickspan.streaming.base import DELAY, with_watermark
from clickspan.vocabulary import DEFAULT_VOCABULARY, Vocabulary

KEYS = ["app_id", "device_id"]

SESSION_EVENTS = (
    "type string, app_id string, device_id string, session_id string, user_id string, "
    "start_us bigint, end_us bigint, duration_s bigint, event_count bigint, "
    "entry_screen string, exit_screen string, exit_reason string, replaces string"
)
#: Microseconds of rows that are kept, and rewritten, together.
PIECE = 60_000_000
ROW_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class Session(NamedTuple):
    """Summary of an open session. The stamps (time, event id) say which event a value is from."""

    first: int
    last: int
    n: int
    user: tuple | None
    entry: tuple | None
    exit: tuple | None

    def merge(self, other: Session) -> Session:
        earlier = lambda a, b: min((x for x in (a, b) if x), default=None)
        later = lambda a, b: max((x for x in (a, b) if x), default=None)
        return Session(min(self.first, other.first), max(self.last, other.last), self.n + other.n,
                       earlier(self.user, other.user), earlier(self.entry, other.entry), later(self.exit, other.exit))

    def flat(self) -> tuple:
        return (self.last, self.n, *[x for stamp in self[3:] for x in (stamp or (None, None, None))])

    @classmethod
    def of(cls, first: int, flat: tuple) -> Session:
        stamps = [tuple(flat[i:i + 3]) if flat[i] is not None else None for i in (2, 5, 8)]
        return cls(first, flat[0], flat[1], *stamps)


STATE = "last bigint, n bigint, " + ", ".join(f"{c}_t bigint, {c}_id string, {c} string" for c in ("user", "entry", "exit"))


def summed_up(frame: pd.DataFrame, gap_us: int) -> list[Session]:
    """Sessions of the rows (t, event_id, user_id, screen) of one device, as if there were no others."""
    frame = frame.sort_values(["t", "event_id"], kind="stable")
    t, ids = frame["t"].to_numpy(), frame["event_id"].to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], np.diff(t) > gap_us]))
    ends = np.append(begins[1:], len(t)) - 1
    group = np.repeat(np.arange(len(begins)), ends - begins + 1)

    def stamps(column: str, last: bool = False) -> list[tuple | None]:
        values = frame[column].to_numpy()
        at = np.flatnonzero(values != "")
        if last:
            at = at[::-1]
        groups, where = np.unique(group[at], return_index=True)
        found: list[tuple | None] = [None] * len(begins)
        for g, i in zip(groups, at[where]):
            found[g] = (int(t[i]), ids[i], values[i])
        return found

    return [Session(int(t[b]), int(t[e]), int(e - b + 1), *parts)
            for b, e, *parts in zip(begins, ends, stamps("user_id"), stamps("screen"), stamps("screen", last=True))]


class SessionProcessor(StatefulProcessor):
    """``session_start`` records as soon as a session is seen, ``session_end`` after its gap."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "first bigint", STATE)
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat([frame for frame in rows], ignore_index=True)
        if arrived.empty:
            return
        self.keep(arrived)
        held = self._held()
        merged: list[tuple[Session, list[int]]] = []
        both = [(s, [s.first]) for s in held] + [(s, []) for s in summed_up(arrived, self.gap_us)]
        for session, known in sorted(both, key=lambda x: x[0].first):
            if merged and session.first - merged[-1][0].last <= self.gap_us:
                merged[-1] = (merged[-1][0].merge(session), merged[-1][1] + known)
            else:
                merged.append((session, known))
        before, out = {s.first: s for s in held}, []
        for session, known in merged:
            if known != [session.first]:
                replaces = ",".join(self._id(key, first) for first in known if first != session.first)
                out.append(self._record("session_start", key, session, replaces))
            for first in known:
                if first != session.first:
                    self.open.removeKey((first,))
            if before.get(session.first) != session:
                self.open.updateValue((session.first,), session.flat())
        self._wake([s for s, _ in merged])
        yield from self.started(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        left = []
        for session in self._held():
            if session.last + self.gap_us < watermark:
                self.open.removeKey((session.first,))
                yield from self.ended(key, session)
            else:
                left.append(session)
        self._wake(left)

    def keep(self, arrived: pd.DataFrame) -> None:
        """Rows of the batch, before they are summed up."""

    def started(self, records: list[dict]) -> Iterator[pd.DataFrame]:
        if records:
            yield pd.DataFrame(records)

    def ended(self, key: tuple, session: Session) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([self._record("session_end", key, session, "")])

    def close(self) -> None:
        pass

    def _held(self) -> list[Session]:
        return [Session.of(first[0], tuple(value)) for first, value in self.open.iterator()]

    def _wake(self, sessions: list[Session]) -> None:
        """One timer per key, for the session that ends first."""
        at = min(((s.last + self.gap_us) // 1000 + 1 for s in sessions), default=None)
        known = self.timer.get()[0] if self.timer.exists() else None
        if at == known:
            return
        if known is not None:
            self.handle.deleteTimer(known)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    @staticmethod
    def _id(key: tuple, first: int) -> str:
        return f"{key[0]}-{key[1]}-{first // 1000}"

    def _record(self, kind: str, key: tuple, session: Session, replaces: str) -> dict:
        ended = kind == "session_end"
        value = lambda stamp: stamp[2] if stamp else ""
        return {
            "type": kind, "app_id": key[0], "device_id": key[1], "session_id": self._id(key, session.first),
            "user_id": value(session.user), "start_us": session.first,
            "end_us": session.last if ended else None,
            "duration_s": (session.last - session.first) // 1_000_000 if ended else None,
            "event_count": session.n if ended else None, "entry_screen": value(session.entry),
            "exit_screen": value(session.exit) if ended else "", "exit_reason": "timeout" if ended else "",
            "replaces": replaces,
        }


class SessionRowProcessor(SessionProcessor):
    """Gives the rows of each session out when it ends. They wait in pieces of time, so a new row rewrites
    the rows of one piece only."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rows = handle.getMapState("rows", "piece bigint", "t array<bigint>, row array<string>")

    def keep(self, arrived: pd.DataFrame) -> None:
        for piece, part in arrived.groupby(arrived["t"] // PIECE):
            t, rows = part["t"].tolist(), part["row"].tolist()
            if self.rows.containsKey((int(piece),)):
                old = self.rows.getValue((int(piece),))
                t, rows = [*old[0], *t], [*old[1], *rows]
            self.rows.updateValue((int(piece),), (t, rows))

    def started(self, records: list[dict]) -> Iterator[pd.DataFrame]:
        yield from ()

    def ended(self, key: tuple, session: Session) -> Iterator[pd.DataFrame]:
        first, last = session.first // PIECE, session.last // PIECE
        for piece in sorted(p[0] for p in self.rows.keys() if first <= p[0] <= last):
            t, rows = map(list, self.rows.getValue((piece,)))
            mine = [session.first <= x <= session.last for x in t]
            yield pd.DataFrame({"session_id": self._id(key, session.first), "row": [r for r, m in zip(rows, mine) if m]})
            others = [(x, r) for x, r, m in zip(t, rows, mine) if not m]
            if others:
                self.rows.updateValue((piece,), tuple(map(list, zip(*others))))
            else:
                self.rows.removeKey((piece,))


def _session_input(events: DataFrame, delay: str, vocabulary: Vocabulary) -> DataFrame:
    screen = F.when(vocabulary.is_screen(), prop("screen_name")).otherwise(F.lit(""))
    return with_watermark(events, delay=delay).withColumns({
        "_t": F.unix_micros("event_time"), "_user": F.coalesce("user_id", F.lit("")), "_screen": F.coalesce(screen, F.lit(""))})


def sessionize_stream(
    events: DataFrame,
    gap: str | int = "30 minutes",
    delay: str = DELAY,
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Session start and end records; a start comes with the batch of its first event."""
    rows = _session_input(events, delay, vocabulary).select(
        *KEYS, "event_time", F.col("_t").alias("t"), "event_id", F.col("_user").alias("user_id"), F.col("_screen").alias("screen"))
    return rows.groupBy(*KEYS).transformWithStateInPandas(
        SessionProcessor(seconds(gap) * 1_000_000), SESSION_EVENTS, "Append", "EventTime"
    )


def session_rows_stream(
    events: DataFrame,
    gap: str | int = "30 minutes",
    delay: str = DELAY,
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Fact rows with the id of their session, in their own layout; each row comes when its session ends."""
    whole = F.to_json(F.struct(*events.columns), ROW_TIMES)
    rows = _session_input(events, delay, vocabulary).withColumn("_row", whole).select(
        *KEYS, "event_time", F.col("_t").alias("t"), "event_id", F.col("_user").alias("user_id"),
        F.col("_screen").alias("screen"), F.col("_row").alias("row"))
    found = rows.groupBy(*KEYS).transformWithStateInPandas(
        SessionRowProcessor(seconds(gap) * 1_000_000), "session_id string, row string", "Append", "EventTime"
    )
    schema = with_watermark(events, delay=delay).schema
    return found.select("session_id", F.from_json("row", schema, ROW_TIMES).alias("_e")).select(
        *[F.col("session_id") if c == "session_id" else F.col(f"_e.{c}").alias(c) for c in events.columns],
        *([] if "session_id" in events.columns else ["session_id"]))


def session_summaries_stream(
    events: DataFrame,
    gap: str = "30 minutes",
    delay: str = DELAY,
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Finished sessions with the built-in session window; everything stays in the JVM."""
    screen = F.when(vocabulary.is_screen() & (prop("screen_name") != ""), prop("screen_name"))
    order = F.struct("event_time", "event_id")

    def first(column: Column) -> Column:
        return F.min_by(column, F.when(not_blank(column), order))

    grouped = with_watermark(events, delay=delay).withColumn("_screen", screen).groupBy(
        *KEYS, F.session_window("event_time", gap)
    ).agg(
        F.min("event_time").alias("started_at"), F.max("event_time").alias("ended_at"),
        F.count("*").alias("event_count"), first(F.col("user_id")).alias("user_id"),
        first(F.col("_screen")).alias("entry_screen"),
        F.max_by("_screen", F.when(F.col("_screen").isNotNull(), order)).alias("exit_screen"),
    )
    start, end = F.unix_micros("started_at"), F.unix_micros("ended_at")
    return grouped.select(
        *KEYS, session_id(KEYS, start).alias("session_id"),
        F.coalesce("user_id", F.lit("")).alias("user_id"), "started_at", "ended_at",
        F.floor((end - start) / 1_000_000).cast("bigint").alias("duration_s"), "event_count",
        F.coalesce("entry_screen", F.lit("")).alias("entry_screen"),
        F.coalesce("exit_screen", F.lit("")).alias("exit_screen"),
    )
