"""Counts, active users, retention, revenue, lifetime value."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from clickspan.functions.text import PropertyFilter
from clickspan.functions.time import bucket, scope, seconds
from clickspan.operators import active, counts, growth
from clickspan.vocabulary import Vocabulary, revenue_from_prop
from tests.helpers import DAY, at, event, events, rows

V = Vocabulary(install=("install",), open=("open",), purchase=("buy",))


def test_weeks_start_on_sunday(spark):
    made = [event(time=at(days=d)) for d in (-1, 0, 1, 6, 7)]
    got = counts.event_count(events(spark, made), granularity="week").orderBy("bucket").collect()
    assert [r["event_count"] for r in got] == [1, 3, 1]
    assert got[1]["bucket"] == DAY.replace(tzinfo=None)


def test_arguments(spark):
    frame = events(spark, [event()])
    with pytest.raises(ValueError):
        bucket("event_time", "year")
    with pytest.raises(ValueError):
        scope(frame, start="2024-02-02", end="2024-02-01")
    with pytest.raises(ValueError):
        growth.retention(frame, day_ns=[0])
    with pytest.raises(ValueError):
        seconds("soon")
    with pytest.raises(ValueError):
        PropertyFilter("k", "like", "x").column()


def test_range_is_inclusive(spark):
    frame = events(spark, [event(time=at(seconds=s), app=a) for s in (0, 5, 10) for a in "ab"])
    assert scope(frame, "a", at(), at(seconds=10)).count() == 3
    assert scope(frame, None, at(seconds=1), at(seconds=5)).count() == 2


def test_partition_filter_reaches_the_scan(spark, tmp_path):
    from clickspan.sources.events import read_events, write_events

    write_events(events(spark, [event(time=at(days=d), app=a) for d in range(4) for a in "ab"]), str(tmp_path / "t"))
    picked = read_events(spark, str(tmp_path / "t"), "a", at(days=1), at(days=2))
    plan = picked._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "event_date" in partition_filters and "app_id" in partition_filters
    assert picked.count() == 2


def test_overlay_and_breakdown(spark):
    made = ([event("a", at())] * 2 + [event("b", at(days=1), user="v")]
            + [event("a", at(days=1), user=u, props={"p": v}) for u, v in [("1", "x"), ("1", "x"), ("2", "x"), ("2", "y"), ("3", "z")]])
    frame = events(spark, made)
    wide = rows(counts.event_overlay(frame, ["a", "b"]), "a", "b")
    assert wide == [(2, None), (5, 1)]
    got = rows(counts.event_breakdown(frame, "a", "p", top_n=2), "property_value", "event_count", "unique_users", "percentage")
    assert got == [("x", 3, 2, 75.0), ("y", 1, 1, 25.0)]
    assert counts.event_total(counts.event_count(frame)).first()["total"] == 8


def test_realtime_and_timeline(spark):
    made = [event(n, at(seconds=s), user=u) for n, s, u in [("a", 0, "1"), ("a", 60, "2"), ("b", 200, "2"), ("c", 301, "3")]]
    frame = events(spark, made)
    got = rows(counts.realtime(frame, at(minutes=5)), "events_per_minute", "active_users", "rank", "event_name")
    assert got == [(0.6, 2, 1, "a"), (0.6, 2, 2, "b")]
    assert [r["event_name"] for r in counts.user_timeline(frame, "2").collect()] == ["b", "a"]
    assert counts.user_timeline(frame, limit=1).count() == 3
    assert counts.user_timeline(frame, limit=10_000).count() == frame.count()
    with pytest.raises(ValueError):
        counts.user_timeline(frame, limit=0)


def test_device_stands_in_for_unknown_user(spark):
    made = [event("open", user="", device="x"), event("open", user="", device="y"), event("open", user="u")]
    frame = events(spark, made)
    assert active.active_users(frame, vocabulary=V).first()["active_users"] == 2
    assert active.active_users(frame, vocabulary=V, device_fallback=True).first()["active_users"] == 3


def test_approximate_within_bound(spark):
    frame = events(spark, [event("open", user=f"u{i}") for i in range(3000)])
    estimate = active.active_users(frame, vocabulary=V, approximate=True).first()["active_users"]
    assert abs(estimate - 3000) <= 3 * 0.02 * 3000


def test_trailing_windows_against_brute_force(spark):
    rng = random.Random(5)
    made = [event(time=at(days=rng.randrange(70), hours=rng.random() * 20), user=f"u{rng.randrange(15)}") for _ in range(160)]
    made += [event(time=at(), user="edge"), event(time=at(days=29), user="edge")]
    seen = {(e["user_id"], (e["event_time"] - DAY).days) for e in made}
    days = range(min(d for _, d in seen), max(d for _, d in seen) + 1)
    want = [
        tuple(len({u for u, d in seen if day - w < d <= day}) for w in (1, 7, 30)) for day in days
    ]
    got = active.dau_wau_mau(events(spark, made)).orderBy("day").collect()
    assert [(r["dau"], r["wau"], r["mau"]) for r in got] == want


def test_kpis(spark):
    series = spark.createDataFrame([("a", at(days=d), n) for d, n in enumerate([10, 1, 1, 1, 1, 1, 1, 15])],
                                   "app_id string, bucket timestamp, active_users bigint")
    row = active.active_users_kpis(series).first()
    assert (row["current"], row["change_pct"], row["peak"], row["average"]) == (15, 50.0, 15, 4)


def test_retention(spark):
    made = [
        event("install", at(hours=23, minutes=59), user="u"), event("open", at(days=1, minutes=1), user="u"),
        event("install", at(days=3), user="u"), event("open", at(days=30), user="u"),
        event("install", at(), user="v"), event("open", at(days=7), user="v"), event("open", at(days=7, hours=1), user="v"),
        event("open", at(), user="never installed"),
    ]
    got = growth.retention(events(spark, made), vocabulary=V)
    assert {(r["day_n"], r["cohort_size"], r["retained"]) for r in got.collect()} == {
        (1, 2, 1), (3, 2, 1), (7, 2, 1), (14, 2, 0), (30, 2, 1)}
    assert rows(growth.retention_summary(got), "day_n", "mean_rate")[0] == (1, 0.5)
    stored = growth.retention_events(events(spark, made), V)
    assert rows(growth.retention_from_events(stored)) == rows(got)


def test_revenue(spark):
    text = Vocabulary(purchase=("buy",), revenue=revenue_from_prop)
    made = [event("buy", user="u", props={"revenue": "2.5"}), event("buy", user="u", props={"revenue": "oops"}),
            event("buy", user="v", props={}), event("buy", user="v", props={"revenue": "-1"}), event("open", user="w")]
    row = growth.revenue(events(spark, made), vocabulary=text).first()
    assert (row["total_revenue"], row["transaction_count"], row["unique_payers"]) == (1.5, 4, 2)
    assert (row["arppu"], row["arpu"]) == (0.75, 0.5)
    by_code = growth.revenue_by_currency(events(spark, made), vocabulary=text)
    assert rows(by_code, "currency", "total_revenue") == [("USD", 1.5)]


def test_lifetime_value(spark):
    made = [
        event("install", at(), user="u"), event("buy", at(hours=1), user="u", revenue=4.0),
        event("buy", at(days=7), user="u", revenue=2.0), event("buy", at(days=7, hours=2), user="u", revenue=4.0),
        event("install", at(), user="free"), event("buy", at(), user="no install", revenue=99.0),
    ]
    frame = events(spark, made)
    assert rows(growth.ltv_per_day(frame, V), "day_n", "users", "avg_ltv") == [(0, 1, 4.0), (7, 1, 3.0)]
    got = rows(growth.ltv_cumulative(frame, [1, 7], V), "day_n", "users", "ltv")
    assert got == [(1, 2, 2.0), (7, 2, 5.0)]


def test_dashboard(spark):
    made = [event("open", at(), user="u"), event("buy", at(), user="u", revenue=5.0),
            event("open", at(days=1), user="u"), event("open", at(days=1, hours=3), user="v"),
            event("buy", at(days=1), user="v", revenue=10.0, device="w")]
    row = active.dashboard_kpis(events(spark, made), at(days=1, hours=20), V).first()
    assert (row["events"], row["dau"], row["sessions"], row["revenue"]) == (3, 2, 3, 10.0)
    assert (row["events_change_pct"], row["dau_change_pct"], row["revenue_change_pct"]) == (50.0, 100.0, 100.0)


def test_a_session_over_midnight_belongs_to_its_first_day(spark):
    made = [event("open", at(minutes=m), user="u") for m in (-40, -20, -10, 5, 20)]  # from two days before on
    made += [event("open", at(days=1, minutes=m), user="u") for m in (-10, 5)] + [event("open", at(days=1, hours=5), user="u")]
    row = active.dashboard_kpis(events(spark, made), at(days=1, hours=20), V).first()
    assert (row["sessions"], row["sessions_change_pct"]) == (1, 0.0)


def test_a_blank_user_is_nobody(spark):
    """In exact counts, sketches, rollups and the dashboard alike; with the fallback a device counts."""
    from clickspan.plans.rollups import ROLLUPS

    made = [event("open", at(hours=h), user=u, device=d) for h, u, d in ((1, "u", "d1"), (2, "", "d2"), (3, "", "d3"), (4, None, "d4"), (5, "v", "d1"))]
    frame = events(spark, made)
    assert active.active_users(frame, vocabulary=V).first()["active_users"] == 2
    assert active.active_users(frame, vocabulary=V, approximate=True).first()["active_users"] == 2
    assert active.active_users(frame, vocabulary=V, device_fallback=True).first()["active_users"] == 5
    assert rows(active.dau_wau_mau(frame), "dau", "wau", "mau") == [(2, 2, 2)]
    assert active.dashboard_kpis(frame, at(hours=12), V).first()["dau"] == 2
    rollup = ROLLUPS["dau_rollup"]
    assert rollup.query(rollup.build(frame, V)).first().asDict()["dau"] == 2
