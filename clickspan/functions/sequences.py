"""Ordered-step matching as higher-order functions.

A list of ``struct<t, step>`` (steps from 0, sorted by time then step) is folded into one value per
step: the latest start time of a chain that has reached the step inside the window. A later start
can only extend further, so nothing else has to be remembered.

``condense`` makes the fold safe for a hot user. Inside a chunk no longer than the window it keeps
only the events that can matter to any state entering the chunk: for every step the earliest
completion of the steps after it, and for every step the chain with the latest start. That is at
most n * n events, whatever the chunk holds, and folding them gives the state of the full chunk.
Condensing is associative: condensed chunks in a row, condensed again, stand for all of them. Over a span
longer than the window it still gives every start that a later event can use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FAR = 1 << 62


def no_progress(n: Column) -> Column:
    return F.array_repeat(F.lit(None).cast("bigint"), n)


def _advance(starts: Column, event: Column, window: Column) -> Column:
    def updated(start: Column, i: Column) -> Column:
        previous = F.get(starts, i - 1)
        return (
            F.when(i != event["step"], start)
            .when(i == 0, event["t"])
            .when(event["t"] <= previous + window, previous)
            .otherwise(start)
        )

    return F.transform(starts, updated)


def progress(events: Column, n: Column, window: Column) -> Column:
    """Latest start per step after all events; null where the step was never reached."""
    return F.aggregate(events, no_progress(n), lambda s, e: _advance(s, e, window))


def level(starts: Column) -> Column:
    return F.size(F.filter(starts, lambda s: s.isNotNull()))


def completions(events: Column, n: Column, window: Column, entry: Column) -> Column:
    """``(start, end)`` of the chains that end at the last step, with the latest possible start.

    Of chains with one start only the first to end is listed.
    """
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def step(state: Column, event: Column) -> Column:
        begun = F.get(state["starts"], n - 2)
        known = F.get(state["done"], F.size(state["done"]) - 1)["start"]
        ended = (event["step"] == n - 1) & (event["t"] <= begun + window) & ~begun.eqNullSafe(known)
        return F.struct(
            _advance(state["starts"], event, window).alias("starts"),
            F.when(ended, F.array_append(state["done"], F.struct(begun.alias("start"), event["t"].alias("end"))))
            .otherwise(state["done"]).alias("done"))

    return F.aggregate(events, F.struct(entry.alias("starts"), empty.alias("done")), step, lambda s: s["done"])


def entries(items: Column, n: Column, window: Column, entry: Column) -> Column:
    """State before each of ``items`` (at, events), as (at, entry)."""
    visits = F.array().cast("array<struct<at: bigint, entry: array<bigint>>>")
    return F.aggregate(
        items,
        F.struct(entry.alias("starts"), visits.alias("visits")),
        lambda state, item: F.struct(
            F.aggregate(item["events"], state["starts"], lambda s, e: _advance(s, e, window)).alias("starts"),
            F.array_append(state["visits"], F.struct(item["at"].alias("at"), state["starts"].alias("entry"))).alias("visits")),
        lambda state: state["visits"])


def _chain(events: Column, steps: Column, first: Column, forward: bool) -> Column:
    """Greedy chain through ``steps``: the next event after (or before) the one before it."""
    def extend(acc: Column, step: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (lambda e: (e["step"] == step) & (e > last)) if forward else (
            lambda e: (e["step"] == step) & (e < last))
        found = F.filter(events, fits)
        return F.array_append(acc, F.array_min(found) if forward else F.array_max(found))

    return F.aggregate(steps, F.array(first), extend)


def _mark(t: int, step: Column | int) -> Column:
    return F.struct(F.lit(t).cast("bigint").alias("t"),
                    (step if isinstance(step, Column) else F.lit(step)).cast("int").alias("step"))


def _forward(events: Column, n: Column, after: Column) -> Column:
    return _chain(events, F.sequence(after + 1, n - 1), _mark(-_FAR, -1), forward=True)


def condense(events: Column, n: Column) -> Column:
    """The at most n * n events of a chunk that decide every later state."""
    ahead = F.transform(F.sequence(F.lit(0), n - 2), lambda j: _forward(events, n, j))
    back = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda m: _chain(events, F.sequence(m, F.lit(0), F.lit(-1)), _mark(_FAR, n), forward=False),
    )
    needed = F.filter(
        F.flatten(F.concat(ahead, back)),
        lambda e: e.isNotNull() & (e["step"] >= 0) & (e["step"] < n),
    )
    return F.when(F.size(events) <= n * n, events).otherwise(F.sort_array(F.array_distinct(needed)))
