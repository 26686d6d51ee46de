"""Funnel kernels against a plain sequential fold, with groups dense enough to be condensed."""

import random

import pytest

from clickspan.operators import funnels
from tests.helpers import at, event, events, rows


def fold(points, n, window, reset):
    """Latest start per step in order; with ``reset``, the conversions."""
    starts, found, best = [None] * n, [], 0
    for t, step in sorted(set(points)):
        if step == 0:
            starts[0] = t
        elif starts[step - 1] is not None and t <= starts[step - 1] + window:
            starts[step] = starts[step - 1]
        best = max([best, *[i + 1 for i in range(n) if starts[i] is not None]])
        if reset and starts[n - 1] is not None:
            found.append((starts[n - 1], t))
            starts = [None] * n
    return found if reset else best


def exhaustive_level(points, n, window):
    """Level by trying every first-step event and every continuation."""
    ordered, best = sorted(set(points)), 0
    for i, (t0, s0) in enumerate(ordered):
        if s0:
            continue
        level = 1
        for t, s in ordered[i + 1:]:
            if s == level and t <= t0 + window:
                level += 1
                if level == n:
                    break
        best = max(best, level)
    return best


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("n", [2, 3, 4])
def test_window_funnel_dense(spark, seed, n):
    rng = random.Random(seed * 10 + n)
    steps = [f"s{i}" for i in range(n)]
    window = rng.choice([7, 30, 90])
    made, want = [], []
    for u in range(12):
        weights = [rng.choice([0.05, 1, 8]) for _ in steps]
        span = rng.choice([60, 400, 20000])
        points = [(rng.randrange(span), rng.choices(range(n), weights)[0])
                  for _ in range(rng.choice([5, 60, 400]))]
        made += [event(steps[s], at(seconds=t), user=f"u{u}") for t, s in points]
        level = fold(points, n, window, reset=False)
        assert level == exhaustive_level(points, n, window)
        want.append((f"u{u}", level))
    got = funnels.window_funnel(events(spark, made), steps, window)
    assert rows(got, "user_id", "level") == sorted(want, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_conversions_dense(spark, seed):
    rng = random.Random(seed)
    plans = [("two", 2, 40), ("three", 3, 15), ("four", 4, 1200), ("long", 3, 5000)]
    definitions = spark.createDataFrame(
        [(f, "a", f, [f"{f}{i}" for i in range(n)], w) for f, n, w in plans],
        "funnel_id string, app_id string, name string, steps array<string>, window_seconds bigint",
    )
    made, want = [], []
    for u in range(6):
        for f, n, w in plans:
            weights = [rng.choice([0.05, 1, 4]) for _ in range(n)]
            span = rng.choice([100, 3000, 30000]) * 1000
            points = [(rng.randrange(0, span, rng.choice([1, 500])), rng.choices(range(n), weights)[0])
                      for _ in range(rng.choice([4, 80, 500]))]
            made += [event(f"{f}{s}", at(seconds=t / 1000), user=f"u{u}") for t, s in points]
            want += [(f, f"u{u}", end - start) for start, end in fold(points, n, w * 1000, reset=True)]
    got = funnels.funnel_conversions(events(spark, made), definitions)
    assert want
    assert rows(got, "funnel_id", "user_id", "duration_ms") == sorted(want, key=repr)


def test_conversions_of_a_user_with_many_chunks(spark):
    """Chains that cross chunks and blocks; no row holds all chunks of the user."""
    rng = random.Random(9)
    window = 3 * 86_400
    definitions = spark.createDataFrame(
        [("f", "a", "f", ["x0", "x1", "x2"], window)],
        "funnel_id string, app_id string, name string, steps array<string>, window_seconds bigint")
    points = [(t * 1000, s) for t in range(0, 40 * 86_400, 1800) for s in [rng.choice([0, 0, 1, 1, 1, 2, 3, 3])] if s < 3]
    want = [("u", end - start) for start, end in fold(points, 3, window * 1000, reset=True)]
    made = events(spark, [event(f"x{s}", at(seconds=t / 1000)) for t, s in points])
    got = funnels.funnel_conversions(made, definitions)
    assert rows(got, "user_id", "duration_ms") == sorted(want, key=repr)
    assert len(want) > 50


def test_edges(spark):
    steps = ["a", "b", "c"]
    made = [
        # exactly at the window's edge
        event("a", at(), user="edge"), event("b", at(seconds=10), user="edge"),
        event("c", at(seconds=60), user="edge"),
        # one second later
        event("a", at(), user="late"), event("b", at(seconds=10), user="late"),
        event("c", at(seconds=61), user="late"),
        # step 2 before step 1
        event("b", at(), user="swapped"), event("a", at(seconds=5), user="swapped"),
        # a later first step succeeds
        event("a", at(), user="restart"), event("a", at(seconds=50), user="restart"),
        event("b", at(seconds=80), user="restart"), event("c", at(seconds=110), user="restart"),
        # same second, in step order
        event("c", at(seconds=0.9), user="second"), event("b", at(seconds=0.5), user="second"),
        event("a", at(seconds=0.7), user="second"),
        # unrelated events, and no first step
        event("a", at(), user="noise"), event("x", at(seconds=1), user="noise"),
        event("b", at(seconds=2), user="noise"), event("b", at(), user="only_b"),
        event("a", at(), user=""),
    ]
    got = funnels.window_funnel(events(spark, made), steps, 60)
    assert rows(got, "user_id", "level") == sorted([
        ("edge", 3), ("late", 2), ("swapped", 1), ("restart", 3), ("second", 3), ("noise", 2),
        ("only_b", 0),
    ], key=repr)
    result = funnels.funnel(events(spark, made), steps, 60)
    assert [tuple(r)[3] for r in result.orderBy("step").collect()] == [6, 5, 3]
    overall = funnels.funnel_overall(events(spark, made), steps, 60).first()
    assert (overall["entered"], overall["converted"], overall["overall_rate"]) == (6, 3, 0.5)


def test_repeat_after_conversion_and_dropoff(spark):
    definitions = spark.createDataFrame(
        [("f", "a", "f", ["a", "b"], 60), ("bad", "a", "bad", ["a", "a"], 60), ("one", "a", "one", ["a"], 60)],
        "funnel_id string, app_id string, name string, steps array<string>, window_seconds bigint",
    )
    made = [event("a", at()), event("b", at(seconds=5)), event("b", at(seconds=6)),
            event("a", at(seconds=7)), event("b", at(seconds=9)),
            event("a", at(), user="gone"), event("a", at(minutes=5), user="fresh")]
    frame = events(spark, made)
    got = funnels.funnel_conversions(frame, definitions)
    assert rows(got, "funnel_id", "user_id", "duration_ms") == [("f", "u", 2000), ("f", "u", 5000)]
    dropped = funnels.funnel_dropoffs(frame, definitions, at(minutes=5, seconds=30))
    assert rows(dropped, "user_id", "steps_complete") == [("gone", 1)]


@pytest.mark.parametrize("steps", [["a"], ["a", "a"], [str(i) for i in range(11)]])
def test_bad_steps(spark, steps):
    with pytest.raises(ValueError):
        funnels.check_steps(steps)
