"""Sessions, their summaries and paths on hand-made and random rows."""

import random

import pytest
from pyspark.sql import functions as F

from clickspan.functions.text import PropertyFilter
from clickspan.operators import paths, sessions
from tests.helpers import at, event, events, rows


def by_hand(times, gap):
    """Session start per time."""
    starts, previous = [], None
    for t in sorted(times):
        if previous is None or t - previous > gap:
            start = t
        starts.append((t, start))
        previous = t
    return starts


@pytest.mark.parametrize("seed,chunk", [(1, 60), (2, 900), (3, 7)])
def test_chunks_do_not_change_sessions(spark, seed, chunk):
    rng = random.Random(seed)
    made, want = [], []
    for d in range(8):
        # d0 is one endless session over many chunks, the others mix short and long gaps.
        t, times = 0, []
        for _ in range(300):
            t += rng.choice([1000, 5000, 29000] if d == 0 else [1000, 20000, 60000, 60001, 61000, 5000000])
            times.append(t)
        made += [event(time=at(seconds=ms / 1000), device=f"d{d}") for ms in times]
        want += [(f"d{d}", start) for _, start in by_hand(times, 60_000)]
    frame = events(spark, made)
    base = int(at().timestamp() * 1000)
    got = sessions.sessionize(frame, 60, chunk=chunk).select(
        "device_id", (F.unix_millis("session_start") - base).alias("start"))
    assert rows(got) == sorted(want, key=repr)
    summary = sessions.session_summaries(frame, 60, chunk=chunk)
    counts = sessions.sessionize(frame, 60, chunk=chunk).groupBy("session_id").count()
    assert rows(summary, "session_id", "event_count") == rows(counts)


def test_gap_is_strict(spark):
    made = [event(time=at()), event(time=at(minutes=29, seconds=59), device="x"), event(time=at(), device="x"),
            event(time=at(minutes=30)), event(time=at(hours=1, seconds=0.001))]
    got = sessions.session_summaries(events(spark, made))
    assert rows(got, "device_id", "event_count") == [("d", 1), ("d", 2), ("x", 2)]


def test_summary_fields(spark):
    made = [
        event("open", at(), user="", country_code="", platform=""),
        event("screen_view", at(seconds=10), user="", props={"screen_name": "home"}),
        event("screen_view", at(seconds=20), user="late", props={"screen_name": "cart"}),
        event("screen_view", at(seconds=30), user="late", props={"screen_name": "home"}),
        event("click", at(seconds=95), user="late", country_code="FR"),
        event("open", at(), device="other", user="late"),
    ]
    frame = events(spark, made)
    found = {r["device_id"]: r for r in sessions.session_summaries(frame).collect()}
    main = found["d"]
    assert (main["user_id"], main["entry_screen"], main["exit_screen"], main["duration_s"]) == (
        "late", "home", "home", 95)
    assert (main["country_code"], main["event_count"], main["screen_count"]) == ("US", 5, 3)
    assert (found["other"]["event_count"], found["other"]["entry_screen"]) == (1, "")
    parts = sessions.session_screens(sessions.sessionize(frame), part_size=2)
    assert rows(parts.select("part", F.array_join("screens", ","))) == [(0, "home,cart"), (1, "home")]
    records = sessions.session_event_rows(sessions.session_summaries(frame))
    end = records.filter("device_id = 'd' AND event_name = 'session_end'").first()
    assert end["props"]["session_duration_s"] == "95"
    # The records have the layout of the fact table.
    both = frame.unionByName(records)
    assert both.columns == frame.columns and both.filter("event_name = 'session_start'").count() == len(found)


def test_histogram_bounds(spark):
    durations = [0, 30, 31, 60, 1800, 1801]
    made = []
    for i, d in enumerate(durations):
        made += [event(time=at(), device=f"d{i}"), event(time=at(seconds=d), device=f"d{i}")]
    got = sessions.session_duration_histogram(sessions.session_summaries(events(spark, made), "2 hours"))
    assert {r["bucket"]: r["sessions"] for r in got.collect()} == {
        "0-30s": 2, "30-60s": 2, "1-2 min": 0, "2-5 min": 0, "5-10 min": 0, "10-20 min": 0, "20-30 min": 1, ">30 min": 1}


def session(names, session_id, start=0, step=1, **fields):
    return [event(n, at(seconds=start + i * step), session_id=session_id, **fields) for i, n in enumerate(names)]


def test_paths(spark):
    made = (
        session(["x", "start", "a", "start", "b", "c", "d"], "s1")
        + session(["start", "a", "start"], "s2") + session(["a", "b"], "s3")
        + session(["start", "a -> b"], "s4") + session(["start", "a", "start"], "s5")
    )
    frame = events(spark, made)
    lists = paths.path_lists(frame, "start", 4)
    assert rows(lists.select("session_id", F.array_join("path", "|"))) == [
        ("s1", "start|a|start|b"), ("s2", "start|a|start"), ("s4", "start|a -> b"), ("s5", "start|a|start")]
    top = paths.paths(frame, "start", 4, top_n=1).first()
    assert (top["session_count"], top["pct"], top["total_sessions"]) == (2, 50.0, 4)
    ended = paths.path_lists(frame, "start", 4, end_event="a")
    assert {r["session_id"] for r in ended.collect()} == {"s1", "s2", "s5"}
    assert {tuple(r["path"]) for r in ended.collect()} == {("start", "a")}
    kept = paths.path_lists(frame, "start", 4, filters=[PropertyFilter("country", "neq", "US")])
    assert kept.count() == 0
    nodes = paths.path_nodes(frame, "start", 4, top_n=10)
    first = nodes.filter("rank = 1").orderBy("step").collect()
    assert [round(r["drop_off"], 4) for r in first] == [0.25, 0.0, 0.0]


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_in_a_huge_session(spark, seed):
    """A session over many chunks gives the path of the full event list."""
    rng = random.Random(seed)
    made, want = [], []
    for s in range(6):
        names = rng.choices(["a", "b", "c", "start"], [5, 5, 5, rng.choice([0.02, 1])], k=400)
        made += session(names, f"s{s}", step=rng.choice([1, 40, 900]))
        if "start" in names:
            i = names.index("start")
            want.append((f"s{s}", "|".join(names[i:i + 5])))
    got = paths.path_lists(events(spark, made), "start", 5)
    assert rows(got.select("session_id", F.array_join("path", "|"))) == sorted(want, key=repr)


def test_session_paths_are_whole(spark):
    names = [f"n{i}" for i in range(25)]
    got = paths.session_paths(events(spark, session(names, "s", step=400)), part_size=10)
    parts = [r["path"] for r in got.orderBy("part").collect()]
    assert [len(p) for p in parts] == [10, 10, 5]
    assert sum(parts, []) == names
