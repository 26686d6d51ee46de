"""Funnel conversions from an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspan.functions.text import not_blank
from clickspan.operators.funnels import FUNNEL_USER, MAX_STEPS, MIN_STEPS, definition_steps
from clickspan.streaming.base import DELAY, with_watermark
from clickspan.streaming.controlled import ControlledProcessor, controlled
from clickspan.streaming.ordered import OrderedProcessor

CONVERSIONS = (
    "app_id string, funnel_id string, user_id string, steps_complete int, total_steps int, "
    "converted boolean, duration_ms bigint, converted_at_ms bigint"
)


class FunnelProcessor(OrderedProcessor):
    """Latest start per step; a conversion is emitted at the last step and clears the progress."""

    row_schema = "t bigint, step int, n int, window bigint"
    state_schema = "starts array<bigint>, window bigint"
    columns = ["t", "step", "n", "window"]

    def expires(self, state):
        return None if state is None else max(s for s in state[0] if s is not None) + state[1] + 1

    def consume(self, key, state, rows, watermark):
        out = []
        starts = None if state is None else list(state[0])
        window = None if state is None else state[1]
        for t, step, n, window in rows:
            if starts is None:
                starts = [None] * n
            if step == 0:
                starts[0] = t
            elif starts[step - 1] is not None and t - starts[step - 1] <= window:
                starts[step] = starts[step - 1]
            begun = starts[n - 1]
            if begun is not None:
                out.append({
                    "app_id": key[0], "funnel_id": key[1], "user_id": key[2], "steps_complete": n,
                    "total_steps": n, "converted": True, "duration_ms": t - begun, "converted_at_ms": t,
                })
                starts = None
        if starts is not None and all(s is None or s + window < watermark for s in starts):
            starts = None
        return (None if starts is None else (starts, window)), out


class LiveFunnelProcessor(ControlledProcessor):
    """Conversions of the definitions in effect at each event; a new version begins without progress."""

    progress_schema = "starts array<bigint>"

    def consume(self, key, versions, rows):
        out, held, limits = [], {}, {}
        steps_of = {
            (definition, t): {name: i for i, name in enumerate(body["steps"])} if usable(body) else {}
            for definition, found in versions.items() for t, body in found}
        acts = []
        for t, user, name, _ in rows:
            for definition, found in versions.items():
                version = self.at(found, t)
                step = None if version is None else steps_of[definition, version[0]].get(name)
                if step is not None:
                    acts.append((definition, version[0], user, t // 1000, step))
                    limits[definition, version[0]] = (len(version[1]["steps"]), version[1]["window_seconds"] * 1000)
        for definition, version, user, t, step in sorted(set(acts)):
            n, window = limits[definition, version]
            own = (definition, version, user)
            if own not in held:
                held[own] = list(self.progress.getValue(own)[0]) if self.progress.containsKey(own) else [None] * n
            starts = held[own]
            if step == 0:
                starts[0] = t
            elif starts[step - 1] is not None and t - starts[step - 1] <= window:
                starts[step] = starts[step - 1]
            if starts[n - 1] is not None:
                out.append({"app_id": key[0], "funnel_id": definition, "user_id": user, "steps_complete": n, "total_steps": n,
                            "converted": True, "duration_ms": t - starts[n - 1], "converted_at_ms": t})
                held[own] = [None] * n
        for own, starts in held.items():
            latest = max((s for s in starts if s is not None), default=None)
            if latest is not None:
                self.put(own, (starts,), (latest + limits[own[:2]][1]) * 1000)
            elif self.progress.containsKey(own):
                self.progress.removeKey(own)
        return out

    def dead(self, value, watermark, version):
        return all(s is None or (s + version["window_seconds"] * 1000) * 1000 < watermark for s in value[0])


def usable(body: dict) -> bool:
    """Whether a definition version can be followed; an inactive one stops the funnel."""
    steps = body.get("steps") or []
    return (body.get("active", True) is not False and MIN_STEPS <= len(steps) <= MAX_STEPS and len(set(steps)) == len(steps)
            and body.get("window_seconds", 0) > 0)


def funnel_stream(events: DataFrame, definitions: DataFrame, delay: str = DELAY) -> DataFrame:
    """Conversions of every definition.

    A table of definitions is met in a static join and stays as it was at the start. A stream of definition
    versions (with ``valid_from``) is kept in state, so that edits take effect while the stream runs.
    """
    if definitions.isStreaming:
        found = controlled(events, definitions, "funnel_id", "server_time", delay).groupBy("app_id", "shard").transformWithStateInPandas(
            LiveFunnelProcessor(), CONVERSIONS, "Append", "EventTime")
        return found.withColumn("converted_at", F.timestamp_millis("converted_at_ms")).drop("converted_at_ms")
    by_step = definition_steps(definitions, 1000)
    rows = with_watermark(events, "server_time", delay).filter(not_blank("user_id")).join(
        by_step, ["app_id", "event_name"]
    ).select(*FUNNEL_USER, "server_time", F.unix_millis("server_time").alias("t"), "step", "n", "window")
    found = rows.groupBy(*FUNNEL_USER).transformWithStateInPandas(
        FunnelProcessor(), CONVERSIONS, "Append", "EventTime"
    )
    return found.withColumn("converted_at", F.timestamp_millis("converted_at_ms")).drop("converted_at_ms")
