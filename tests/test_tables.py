"""Rollups, tables on disk, topics and definitions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clickspan.operators import growth
from clickspan.plans import rollups
from clickspan.schema import APPS
from clickspan.sources import definitions, topics
from clickspan.sources import events as store
from clickspan.sources.testdata import TEST_VOCABULARY as V
from clickspan.sources.testdata import load_events
from tests.helpers import at, event, events, rows


@pytest.mark.parametrize("name", list(rollups.ROLLUPS))
def test_merge_is_associative(spark, sf_dir, name):
    rollup, frame = rollups.ROLLUPS[name], load_events(spark, sf_dir)
    cut = F.col("event_time") < F.lit("2024-01-11 07:30:00").cast("timestamp")
    other = F.col("event_time") < F.lit("2024-01-21 18:00:00").cast("timestamp")
    a, b, c = (rollup.build(frame.filter(p), V) for p in (cut, ~cut & other, ~other))
    money = ["revenue", "total_revenue"]
    whole = rollup.query(rollup.build(frame, V))
    for parts in ((a, b, c), (c, a, b), (rollup.merge(a, b), c), (a, rollup.merge(c, b))):
        assert rows(rollup.query(*parts).drop(*money)) == rows(whole.drop(*money))
    for column in set(money) & set(whole.columns):
        total = whole.agg(F.round(F.sum(column), 4)).first()[0]
        assert rollup.query(a, b, c).agg(F.round(F.sum(column), 4)).first()[0] == total


def test_sketch_error(spark):
    frame = events(spark, [event("view", user=f"u{i}") for i in range(5000)])
    table = rollups.ROLLUPS["dau_rollup"].build(frame, V)
    assert abs(rollups.daily_active_users(table).first()["dau"] - 5000) < 150


def test_routing(spark):
    frame = events(spark, [event("a", at(hours=h)) for h in (0, 1, 25)])
    table = rollups.ROLLUPS["hourly_counts"].build(frame, V)
    for granularity in ("hour", "day", "month"):
        assert rows(rollups.events_or_rollup(frame, table, granularity)) == rows(
            rollups.events_or_rollup(frame, None, granularity))
    plan = rollups.events_or_rollup(frame, table.limit(0), "minute")
    assert plan.count() == 3


def test_write_read_expire(spark, tmp_path):
    path = str(tmp_path / "events")
    store.write_events(events(spark, [event(time=at(days=d), app=a) for d in range(5) for a in "ab"]), path)
    frame = store.read_events(spark, path)
    assert frame.count() == 10
    removed = store.expire(spark, path, 2, dt.date(2024, 3, 7))
    assert removed == ["2024-03-03", "2024-03-04"]
    spark.catalog.clearCache()
    assert store.read_events(spark, path).count() == 6
    assert store.unexpired(frame, 2, dt.date(2024, 3, 7)).count() == 6


def test_archive_skips_known_ids(spark, tmp_path):
    path = str(tmp_path / "archive")
    first = events(spark, [event(event_id="1"), event(event_id="2")])
    second = events(spark, [event(event_id="2"), event(event_id="3"), event(event_id="3"), event(event_id="4", time=at(days=1))])
    for batch in (first, second, second):
        store.archive_raw(batch, path)
    assert rows(spark.read.parquet(path), "event_id") == [("1",), ("2",), ("3",), ("4",)]
    newest = store.raw_events_lookup(store.read_events(spark, path), limit=2)
    assert [r["event_id"] for r in newest.collect()] == ["4", "3"]


def test_csv(spark, tmp_path):
    made = [event("signup", at(), user=u) for u in "abc"] + [event("view", at(days=1), user="a")]
    cohorts = growth.retention(events(spark, made), [1, 7], V)
    store.export_csv(cohorts, str(tmp_path / "csv"), [1, 7])
    row = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert (row["cohort_size"], row["day_1"], row["day_7"]) == ("3", "33.3%", "0.0%")


def test_topics(spark, tmp_path):
    frame = events(spark, [event(), event(device="e")])
    topics.write_topic(frame, "enriched", path=str(tmp_path))
    stored = spark.read.parquet(str(tmp_path / "enriched"))
    assert rows(stored, "key") == [("a:d",), ("a:e",)]
    assert stored.select(F.get_json_object("value", "$.event_name")).first()[0] == "view"
    stream = topics.read_raw_stream(spark, str(tmp_path / "enriched"))
    assert stream.isStreaming and stream.columns == ["key", "value", "timestamp"]
    with pytest.raises(ValueError):
        topics.read_raw_stream(spark)


def test_definitions(spark, tmp_path):
    made = spark.createDataFrame([("a", "o", "A", 1.0, 2, True), ("b", "o", "B", 1.0, 2, False)], APPS)
    made.write.parquet(str(tmp_path / "apps"))
    assert definitions.load_definitions(spark, "apps", str(tmp_path)).count() == 2
    assert definitions.load_definitions(spark, "apps", str(tmp_path), active_only=True).count() == 1
    with pytest.raises(ValueError):
        definitions.load_definitions(spark, "dashboards", str(tmp_path))
