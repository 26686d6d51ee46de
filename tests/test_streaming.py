"""Streams give what the batch operators give on the same rows."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickspan.catalogue.alerts import CAMPAIGNS
from clickspan.catalogue.funnels import definitions
from clickspan.catalogue.ingest import IP_RANGES
from clickspan.operators import campaigns, funnels, ingest, sessions
from clickspan.plans.ingest import ingest_batch
from clickspan.plans.rollups import ROLLUPS
from clickspan.schema import CONTACTS
from clickspan.sources import manifest
from clickspan.sources.testdata import TEST_VOCABULARY as V
from clickspan.sources.testdata import load_events, raw_envelopes
from clickspan.sources.topics import read_raw_stream
from clickspan.streaming import funnels as funnel_streams
from clickspan.streaming import ingest as ingest_streams
from clickspan.streaming import alerts, dedup, live
from clickspan.streaming import sessions as session_streams
from tests.helpers import rows

CLOSING = dt.datetime(2024, 6, 1, tzinfo=dt.UTC)


@pytest.fixture(scope="module")
def batch(spark, sf_dir):
    return load_events(spark, sf_dir).drop("event_date").cache()


def as_stream(spark, batch, folder, files, closing=True):
    """The events as parquet files read as a stream, one file per micro-batch, in arrival order.

    ``files`` slices by time; the last file holds one far event that moves the watermark on.
    """
    edges = batch.agg(F.min("event_time"), F.max("event_time")).first()
    step = (edges[1] - edges[0]) / files
    for i in range(files):
        low, high = edges[0] + step * i, edges[0] + step * (i + 1)
        part = batch.filter((F.col("event_time") >= F.lit(low)) & (
            (F.col("event_time") < F.lit(high)) | F.lit(i == files - 1)))
        part.orderBy(F.rand(7)).coalesce(1).write.mode("append").parquet(folder)
    if closing:
        last = batch.limit(1).withColumns({
            "event_time": F.lit(CLOSING), "server_time": F.lit(CLOSING), "user_id": F.lit("closing"),
            "device_id": F.lit("closing"), "event_id": F.lit("closing"),
        })
        last.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, name, tmp_path, mode="append"):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination(600)
    assert query.exception() is None
    return df.sparkSession.table(name)


@pytest.mark.parametrize("files", [1, 4])
def test_session_stream(spark, batch, tmp_path, files):
    stream = as_stream(spark, batch, str(tmp_path / "in"), files)
    out = drain(session_streams.sessionize_stream(stream, "6 hours", vocabulary=V), f"s{files}", tmp_path)
    ends = out.filter("type = 'session_end' AND device_id <> 'closing'").select(
        "app_id", "device_id", "session_id", "user_id", F.col("event_count"), "duration_s",
        "entry_screen", "exit_screen",
    )
    want = sessions.session_summaries(batch, "6 hours", vocabulary=V).select(*ends.columns)
    assert rows(ends) == rows(want)
    starts = out.filter("type = 'session_start' AND device_id <> 'closing'")
    assert rows(starts, "session_id") == rows(want, "session_id")


def shuffled(spark, path, made, files):
    """Events of one device as (second, screen), dealt to files in the given order."""
    for i, part in enumerate(files):
        spark.createDataFrame(
            [("a", f"e{second}", user, "d", "view", dt.datetime.fromtimestamp(1_717_200_000 + second, dt.UTC), {"screen_name": screen})
             for second, user, screen in (made[x] for x in part)],
            "app_id string, event_id string, user_id string, device_id string, event_name string, event_time timestamp, props map<string,string>",
        ).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    schema = "app_id string, event_id string, user_id string, device_id string, event_name string, event_time timestamp, props map<string,string>"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_session_starts_come_at_once_and_are_corrected(spark, tmp_path):
    made = [(0, "", "s0"), (100, "u", "s1"), (1700, "", "s2"), (900, "", "s3"), (5000, "v", "s4"), (-50, "w", "s5"), (22_000, "x", "")]
    # 0 and 1700 are two sessions until 900 comes; then -50 begins the session earlier; 22000 moves the watermark on.
    stream = shuffled(spark, str(tmp_path / "in"), made, [[0, 1], [2, 4], [3], [5], [6], [6]])
    seen = []
    query = session_streams.sessionize_stream(stream, 900, "4 hours", V).writeStream.foreachBatch(
        lambda batch, i: seen.extend((i, r.asDict()) for r in batch.collect())
    ).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(600)
    assert query.exception() is None
    name = lambda second: f"a-d-{(1_717_200_000 + second) * 1000}"
    starts = [(i, r["session_id"], r["replaces"]) for i, r in seen if r["type"] == "session_start"]
    assert starts[:5] == [(0, name(0), ""), (1, name(1700), ""), (1, name(5000), ""), (2, name(0), name(1700)), (3, name(-50), name(0))]
    ends = {r["session_id"]: r for i, r in seen if r["type"] == "session_end"}
    assert set(ends) == {name(-50), name(5000)}
    whole = ends[name(-50)]
    assert (whole["event_count"], whole["user_id"], whole["entry_screen"], whole["exit_screen"], whole["duration_s"]) == (5, "w", "s5", "s2", 1750)


@pytest.mark.parametrize("files", [1, 3])
def test_rows_get_the_ids_of_the_batch(spark, batch, tmp_path, files):
    from clickspan.plans.ingest import with_session_ids

    stream = as_stream(spark, batch, str(tmp_path / "in"), files)
    out = drain(session_streams.session_rows_stream(stream, "6 hours", vocabulary=V), f"rows{files}", tmp_path)
    want = with_session_ids(batch, "6 hours")
    assert rows(out.filter("device_id <> 'closing'").select(*want.columns)) == rows(want)


def test_session_window_stream(spark, batch, tmp_path):
    stream = as_stream(spark, batch, str(tmp_path / "in"), 3)
    out = drain(session_streams.session_summaries_stream(stream, "6 hours", vocabulary=V), "sw", tmp_path)
    columns = ["app_id", "device_id", "session_id", "user_id", "started_at", "ended_at", "duration_s",
               "event_count", "entry_screen", "exit_screen"]
    want = sessions.session_summaries(batch, "6 hours", vocabulary=V)
    assert rows(out.filter("device_id <> 'closing'"), *columns) == rows(want, *columns)


@pytest.mark.parametrize("files", [1, 4])
def test_funnel_stream(spark, batch, tmp_path, files):
    stream = as_stream(spark, batch, str(tmp_path / "in"), files)
    out = drain(funnel_streams.funnel_stream(stream, definitions(spark)), f"f{files}", tmp_path)
    columns = ["app_id", "funnel_id", "user_id", "duration_ms", "converted_at"]
    want = funnels.funnel_conversions(batch, definitions(spark))
    assert want.count() > 0
    assert rows(out, *columns) == rows(want, *columns)


def test_campaign_stream(spark, batch, tmp_path):
    stream = as_stream(spark, batch, str(tmp_path / "in"), 3)
    table = spark.sql(CAMPAIGNS).filter("segment_id IS NULL")
    out = drain(live.campaign_stream(stream, table), "c", tmp_path)
    want = campaigns.delivery_outbox(campaigns.campaign_triggers(batch, table))
    assert want.count() > 0
    assert rows(out.filter("user_id <> 'closing'")) == rows(want.select(*out.columns))


def versions(spark, path, kind, table, times):
    """A stream of definition versions, a file for each of (valid from, rows)."""
    from clickspan.sources.definitions import definition_changes

    for i, (at, rows_) in enumerate(times):
        rows_.withColumn("valid_from", F.lit(at).cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{path}/{kind}")
    return definition_changes(spark, kind, path)


def test_live_definitions_equal_the_table(spark, batch, tmp_path):
    """Definitions that hold from the beginning give what the batch operator gives."""
    stream = as_stream(spark, batch, str(tmp_path / "in"), 3)
    changes = versions(spark, str(tmp_path / "d"), "funnels", None, [("2020-01-01", definitions(spark))])
    out = drain(funnel_streams.funnel_stream(stream, changes), "live_f", tmp_path)
    columns = ["app_id", "funnel_id", "user_id", "duration_ms", "converted_at"]
    want = funnels.funnel_conversions(batch, definitions(spark))
    assert want.count() > 0 and rows(out, *columns) == rows(want, *columns)


def test_an_edit_of_a_funnel_takes_effect_while_the_stream_runs(spark, batch, tmp_path):
    change = "2024-01-16"
    table = definitions(spark)
    edited = table.withColumn("steps", F.slice("steps", 1, 2))
    stream = as_stream(spark, batch, str(tmp_path / "in"), 4)
    folder = str(tmp_path / "d")
    changes = versions(spark, folder, "funnels", None, [("2020-01-01", table)])
    found = funnel_streams.funnel_stream(stream, changes)
    told = []

    def edit(rows_, batch_id):
        if not told:  # the new version is written when the stream is already running
            told.append(batch_id)
            edited.withColumn("valid_from", F.lit(change).cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/funnels")
        rows_.write.mode("append").parquet(str(tmp_path / "out"))

    query = found.writeStream.foreachBatch(edit).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
    query.processAllAvailable()
    query.stop()
    columns = ["app_id", "funnel_id", "user_id", "duration_ms", "converted_at", "total_steps"]
    at = F.lit(change).cast("timestamp")
    want = funnels.funnel_conversions(batch.filter(F.col("server_time") < at), table).unionByName(
        funnels.funnel_conversions(batch.filter(F.col("server_time") >= at), edited))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.filter("total_steps = 2").count() > 0
    assert rows(out, *columns) == rows(want, *columns)


def test_an_edit_of_a_campaign_takes_effect(spark, batch, tmp_path):
    stream = as_stream(spark, batch, str(tmp_path / "in"), 3)
    table = spark.sql(CAMPAIGNS)
    members = batch.select("app_id", "user_id").distinct().filter("user_id < 'u_5'").withColumn("segment_id", F.lit("buyers"))
    stopped = table.withColumn("active", F.col("id") == "c2")
    changes = versions(spark, str(tmp_path / "d"), "campaigns", None, [("2020-01-01", table), ("2024-01-20", stopped)])
    out = drain(live.campaign_stream(stream, changes, members), "live_c", tmp_path)
    end = F.lit("2024-01-20").cast("timestamp")
    both = [campaigns.campaign_triggers(batch.filter(F.col("event_time") < end), table.filter("id <> 'c2'"), members),
            campaigns.campaign_triggers(batch, table.filter("id = 'c2'"), members)]
    want = campaigns.delivery_outbox(both[0].unionByName(both[1]))
    assert want.groupBy("campaign_id").count().count() == 3
    assert rows(out.filter("user_id <> 'closing'")) == rows(want.select(*out.columns))


def test_dedup_stream(spark, batch, tmp_path):
    twice = batch.unionByName(batch.withColumn("event_name", F.lit("copy")))
    stream = as_stream(spark, twice, str(tmp_path / "in"), 2, closing=False)
    out = drain(ingest_streams.dedup_stream(stream), "d", tmp_path)
    assert out.count() == batch.count()
    assert out.select("event_id").distinct().count() == batch.count()


def test_rollup_stream_and_replay(spark, batch, tmp_path):
    stream = as_stream(spark, batch, str(tmp_path / "in"), 3, closing=False)
    target = str(tmp_path / "rollups")
    query = live.rollup_stream(
        stream, list(ROLLUPS), target, V, checkpoint=str(tmp_path / "cp"), available_now=True
    ).start()
    query.awaitTermination(600)
    assert query.exception() is None
    for name, rollup in ROLLUPS.items():
        want = rows(rollup.query(rollup.build(batch, V)).drop("revenue", "total_revenue"))
        got = rollup.finish(live.read_rollup(spark, name, target))
        assert rows(got.drop("revenue", "total_revenue")) == want, name
    # Closed days become one part each; a batch that comes in between is not lost.
    build = ROLLUPS["hourly_counts"].build
    merge, path, table = manifest.read, f"{target}/hourly_counts", live._rollup_table(spark, "hourly_counts")
    assert manifest.append(build(batch, V), path, "backfill", 7, "hour")
    calls = []

    def read_and_add(*given, **named):
        out = merge(*given, **named)
        if not calls:
            calls.append(manifest.append(build(batch, V), path, "other", 0, "hour"))
        return out

    manifest.read = read_and_add
    try:
        assert live.compact_rollup(spark, "hourly_counts", target, "2024-02-01")
    finally:
        manifest.read = merge
    assert calls == [True] and not manifest.append(build(batch, V), path, "other", 0, "hour")
    thrice = [(*r[:-1], 3 * r[-1]) for r in rows(build(batch, V))]
    assert rows(live.read_rollup(spark, "hourly_counts", target)) == sorted(thrice, key=repr)
    assert live.compact_rollup(spark, "hourly_counts", target, "2024-02-01")
    live_parts = manifest.state(spark, path)[1]["live"]
    assert len({day for _, day in live_parts if day < "2024-02-01"}) == len([1 for _, day in live_parts if day < "2024-02-01"])
    assert not live.compact_rollup(spark, "hourly_counts", target, "2024-02-01")
    assert rows(live.read_rollup(spark, "hourly_counts", target)) == sorted(thrice, key=repr)
    # Days that have expired are gone at once; their files go with those of old parts.
    assert live.expire_rollup(spark, "hourly_counts", target, dt.date(2024, 2, 10), days=20)
    kept = build(batch.filter(F.col("event_time") >= F.lit("2024-01-21").cast("timestamp")), V)
    assert rows(live.read_rollup(spark, "hourly_counts", target)) == sorted([(*r[:-1], 3 * r[-1]) for r in rows(kept)], key=repr)
    assert live.read_rollup(spark, "hourly_counts", target, first="2024-01-30").count() == build(
        batch.filter(F.col("event_time") >= F.lit("2024-01-30").cast("timestamp")), V).count()
    assert manifest.vacuum(spark, path, 0) > 0 and manifest.vacuum(spark, path, 0) == 0
    assert rows(live.read_rollup(spark, "hourly_counts", target)) == sorted([(*r[:-1], 3 * r[-1]) for r in rows(kept)], key=repr)


def test_a_crash_between_the_steps_of_a_rollup_batch(spark, batch, tmp_path, monkeypatch):
    path, rows_ = str(tmp_path / "t"), ROLLUPS["hourly_counts"].build(batch, V)
    change = manifest.change
    monkeypatch.setattr(manifest, "change", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        manifest.append(rows_, path, "stream", 0, "hour")
    assert manifest.read(spark, path, rows_.schema).count() == 0
    monkeypatch.setattr(manifest, "change", change)
    assert manifest.append(rows_, path, "stream", 0, "hour") and not manifest.append(rows_, path, "stream", 0, "hour")
    assert rows(manifest.read(spark, path, rows_.schema)) == rows(rows_)


def test_a_repeated_batch_of_fact_rows_adds_nothing(spark, batch, tmp_path, monkeypatch):
    from clickspan.sources import events as store

    path = str(tmp_path / "events")
    count = lambda: store.read_events(spark, path).count()
    assert store.write_events_batch(batch, path, 0) and not store.write_events_batch(batch, path, 0)
    assert count() == batch.count()
    # A run that ended before its marker was set.
    marker = tmp_path / "events" / "_batches" / f"stream-{0:010d}"
    marker.unlink()
    assert store.write_events_batch(batch, path, 0) and count() == batch.count()
    assert store.write_events_batch(batch, path, 1) and count() == 2 * batch.count()
    files = [f for f in (tmp_path / "events").glob("event_date=*/app_id=*/*.parquet")]
    folders = {f.parent for f in files}
    assert len(files) == 2 * len(folders)
    assert not list((tmp_path / "events" / "_aside").glob("*"))


def test_every_row_of_the_dedup_is_accounted_for(spark, batch, tmp_path):
    twice = batch.unionByName(batch.withColumn("event_name", F.lit("copy")))
    stream = as_stream(spark, twice, str(tmp_path / "in"), 3, closing=False)
    # After the last file a copy of the first days, long after their ids have been forgotten, and one new old row.
    old = batch.orderBy("event_time").limit(50)
    for part in (old, old.limit(1).withColumn("event_id", F.lit("new"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = drain(dedup.tagged_stream(stream, "24 hours", shards=4), "tagged", tmp_path)
    counts = {r["tag"]: r["count"] for r in out.groupBy("tag").count().collect()}
    assert sum(counts.values()) == twice.count() + 51
    assert counts == {"kept": batch.count(), "duplicate": batch.count(), "late": 51}
    kept = out.filter("tag = 'kept'")
    assert kept.select("event_id").distinct().count() == batch.count()
    columns = [c for c in batch.columns if c != "event_name"]
    assert rows(kept.select(*columns)) == rows(batch.select(*columns))


def test_ingest_stream(spark, sf_dir, tmp_path):
    raw = raw_envelopes(spark, sf_dir)
    folder = str(tmp_path / "raw")
    raw.coalesce(2).write.parquet(folder)
    stream = read_raw_stream(spark, folder, max_files_per_trigger=1)
    ranges = spark.sql(IP_RANGES)
    out = str(tmp_path / "events")
    writers = [
        ingest_streams.write_events_stream(
            ingest_streams.event_rows(stream, ranges), out, checkpoint=str(tmp_path / "c1"), available_now=True),
        ingest_streams.write_dead_letters_stream(
            stream, str(tmp_path / "dead"), checkpoint=str(tmp_path / "c2"), available_now=True),
        ingest_streams.archive_stream(
            ingest_streams.event_rows(stream, ranges), str(tmp_path / "archive"),
            checkpoint=str(tmp_path / "c3"), available_now=True),
    ]
    for writer in writers:
        query = writer.start()
        query.awaitTermination(600)
        assert query.exception() is None
    want = ingest_batch(raw, ranges)
    columns = ["app_id", "event_id", "event_name", "event_time", "country_code", "platform", "browser"]
    assert rows(spark.read.parquet(out), *columns) == rows(want.events, *columns)
    assert rows(spark.read.parquet(str(tmp_path / "archive")), *columns) == rows(want.events, *columns)
    assert rows(spark.read.parquet(str(tmp_path / "dead")), "error", "ts") == rows(want.dead, "error", "ts")


def test_realtime_stream(spark, batch, tmp_path):
    stream = as_stream(spark, batch, str(tmp_path / "in"), 2)
    out = drain(live.realtime_stream(stream, "1 day", "6 hours"), "r", tmp_path)
    want = batch.groupBy("app_id", F.window("event_time", "1 day", "6 hours")).agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("u"))
    got = out.filter(F.col("window_start") < F.lit("2024-05-01").cast("timestamp")).select(
        "app_id", "window_start", F.round(F.col("events_per_minute") * 1440).cast("bigint"), "active_users")
    assert rows(got) == rows(want.select("app_id", "window.start", "n", "u"))


def test_realtime_top_events(spark, batch, tmp_path):
    stream = as_stream(spark, batch, str(tmp_path / "in"), 2)
    out = drain(live.realtime_stats_stream(stream, 3, "1 day", "6 hours", buckets=2), "top", tmp_path)
    spans = F.window("event_time", "1 day", "6 hours")
    counts = batch.groupBy("app_id", spans, "event_name").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("app_id", "window").orderBy(F.desc("n"), "event_name"))
    want = counts.withColumn("place", place).filter("place <= 3").select("app_id", "window.start", "place", "event_name", "n")
    got = out.filter(F.col("window_start") < F.lit("2024-05-01").cast("timestamp"))
    listed = got.select("app_id", "window_start", F.posexplode("top_events").alias("place", "e")).select(
        "app_id", "window_start", F.col("place") + 1, "e.event_name", "e.event_count")
    assert rows(listed) == rows(want)
    per_minute = counts.groupBy("app_id", "window.start").agg(F.sum("n").alias("n"))
    assert rows(got.select("app_id", "window_start", F.round(F.col("events_per_minute") * 1440).cast("bigint"))) == rows(per_minute)


RULE = "id string, app_id string, metric_name string, condition string, threshold double, window_mins int, active boolean"


def drained(query):
    query.awaitTermination(600)
    assert query.exception() is None


def ticks(spark, path, seconds):
    """A clock that tells one time a batch."""
    for i, second in enumerate(seconds):
        spark.createDataFrame([(dt.datetime.fromtimestamp(second, dt.UTC),)], "timestamp timestamp").coalesce(1).write.mode("append").parquet(f"{path}/{i:04d}")
    return spark.readStream.schema("timestamp timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def minute_events(spark, base, minutes):
    made = [(m, i) for m, n in minutes.items() for i in range(n)]
    return spark.createDataFrame(
        [("a", f"e{m}_{i}", f"u{i}", f"d{i}", "view", dt.datetime.fromtimestamp(base + 60 * m + i, dt.UTC), {}, None) for m, i in made],
        "app_id string, event_id string, user_id string, device_id string, event_name string, event_time timestamp, props map<string,string>, revenue double")


def test_alerts_see_silence_and_catch_up(spark, tmp_path):
    base = 1_717_200_000
    minutes = {0: 3, 1: 5, 2: 1, 6: 2}
    path = str(tmp_path / "alerts")
    stream = as_stream(spark, minute_events(spark, base, minutes), str(tmp_path / "in"), 3)
    drained(alerts.minute_stream(stream, path, vocabulary=V, checkpoint=str(tmp_path / "m"), available_now=True).start())
    made = [("few", "a", "event_count", "lt", 2.0, 1, True), ("none", "a", "event_count", "eq", 0.0, 2, True), ("gone", "b", "active_users", "eq", 0.0, 1, True),
            ("many", "a", "event_count", ">=", 5.0, 2, True), ("ratio", "a", "error_rate", "gte", 0.0, 1, True), ("off", "a", "event_count", "lt", 9.0, 1, False)]
    table = spark.createDataFrame(made, RULE)
    # The clock starts at minute 1, tells one time twice, and then misses five minutes. Nothing happens after minute 7.
    clock = ticks(spark, str(tmp_path / "clock"), [base + 60 * m + 60 + s for m, s in ((1, 5), (2, 0), (2, 30), (7, 59), (8, 1), (10, 0))])
    drained(alerts.alert_stream(clock, lambda: table, path, cooldown_s=0, checkpoint=str(tmp_path / "c"), available_now=True).start())
    fired = {(r["rule_id"], int(r["fired_at"].timestamp() - base) // 60) for r in spark.read.parquet(f"{path}/sent").collect()}
    count = lambda m, w: sum(minutes.get(x, 0) for x in range(m - w, m))
    want = {("few", m) for m in range(1, 11) if count(m, 1) < 2} | {("none", m) for m in range(1, 11) if count(m, 2) == 0}
    want |= {("gone", m) for m in range(1, 11)} | {("many", m) for m in range(1, 11) if count(m, 2) >= 5} | {("ratio", m) for m in range(1, 11) if count(m, 1)}
    assert fired == want

    # With a cooldown, over another clock: one alert in three minutes, across batches.
    clock = ticks(spark, str(tmp_path / "clock2"), [base + 60 * m + 60 for m in (1, 2, 3, 10)])
    again = str(tmp_path / "again")
    drained(alerts.minute_stream(as_stream(spark, minute_events(spark, base, minutes), str(tmp_path / "in2"), 2), again, vocabulary=V, checkpoint=str(tmp_path / "m2"), available_now=True).start())
    to_tell = table.withColumn("channels", F.array(F.lit("email"), F.lit("webhook")))
    contacts = spark.createDataFrame([("a", "email", "x@a"), ("a", "email", "y@a"), ("b", "webhook", "https://b")], CONTACTS)
    drained(alerts.alert_stream(clock, lambda: to_tell, again, cooldown_s=180, contacts=lambda: contacts, checkpoint=str(tmp_path / "c2"), available_now=True).start())
    sent = sorted(int(r["fired_at"].timestamp() - base) // 60 for r in spark.read.parquet(f"{again}/sent").filter("rule_id = 'gone'").collect())
    assert sent == [1, 4, 7, 10]
    outbox = spark.read.parquet(f"{again}/outbox")
    told = {(r["rule_id"], r["channel"], r["recipient"], r["status"]) for r in outbox.collect()}
    assert {t[1:] for t in told if t[0] == "gone"} == {("email", "", "failed"), ("webhook", "https://b", "pending")}
    assert {t[1:] for t in told if t[0] == "few"} == {("email", "x@a", "pending"), ("email", "y@a", "pending"), ("webhook", "", "failed")}
    reported = outbox.filter("rule_id = 'gone' and status = 'pending'").select("id").limit(1)
    left = campaigns.undelivered(outbox.unionByName(outbox), reported)
    assert left.count() == outbox.filter("status = 'pending'").count() - 1


def test_alert_stream_knows_every_metric(spark, batch, tmp_path):
    from clickspan.operators.alerts import alert_metrics
    from clickspan.operators.sessions import session_summaries

    path, steps = str(tmp_path / "alerts"), ["signup", "click", "purchase"]
    as_of = int(dt.datetime(2024, 1, 15, 12, tzinfo=dt.UTC).timestamp())
    moment = "2024-01-15 12:00:00"
    summaries = session_summaries(batch).select("app_id", "started_at", "event_count")
    drained(alerts.minute_stream(as_stream(spark, batch, str(tmp_path / "e"), 3), path, vocabulary=V, checkpoint=str(tmp_path / "m"), available_now=True).start())
    summaries.repartition(2).write.parquet(str(tmp_path / "s"))
    ended = spark.readStream.schema(summaries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    drained(alerts.minute_stream(ended, path, "sessions", checkpoint=str(tmp_path / "n"), available_now=True).start())
    want = {(r["metric"], r["app_id"]): r["value"] for r in alert_metrics(batch, [10080], moment, V, session_summaries(batch), steps).collect()}
    names = sorted({m for m, _ in want})
    assert len(names) == 12
    table = spark.createDataFrame([(f"{m}/{a}", a, m, "gte", -1.0, 10080, True) for m in names for a in ("app_0", "app_1", "app_2")], RULE)
    clock = ticks(spark, str(tmp_path / "clock"), [as_of + 60])
    drained(alerts.alert_stream(clock, lambda: table, path, events=lambda: batch, funnel_steps=steps, checkpoint=str(tmp_path / "c"), available_now=True).start())
    got = {(r["metric_name"], r["app_id"]): r["value"] for r in spark.read.parquet(f"{path}/sent").collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want), [(k, got[k], want[k]) for k in want if abs(got[k] - want[k]) >= 1e-6]


def test_rejected_and_late_rows_have_sinks(spark, tmp_path):
    """Every event of a message ends in exactly one place: fact rows, rejected rows, or also the late rows."""
    import json

    from clickspan.streaming.ingest import late_rows, rejected_rows, write_left_out_stream

    server = 1_710_000_000_000
    one = lambda i, **x: {"event_id": f"e{i}", "event_name": "view", "event_time": server, **x}
    made = [one(1), one(2, event_time=server - 8 * 86_400_000), one(3, event_name="x" * 300, props={"k": 1}), one(4, event_time=server - 120_000)]
    value = json.dumps({"batch": {"app_id": "c", "device_id": "d", "user_id": "u", "events": made},
                        "authenticated_app": "a", "remote_addr": "8.8.4.4:1", "server_ts": server})
    spark.createDataFrame([(value, dt.datetime(2024, 3, 9, tzinfo=dt.UTC))], "value string, timestamp timestamp").write.parquet(str(tmp_path / "raw"))
    stream = spark.readStream.schema("value string, timestamp timestamp").parquet(str(tmp_path / "raw"))
    ranges = spark.createDataFrame([], "start_ip long, end_ip long, country_code string, country_name string, region string, "
                                       "city string, latitude double, longitude double")
    for name, rows_ in (("rejected", rejected_rows(stream)), ("late", late_rows(stream, ranges))):
        query = write_left_out_stream(rows_, str(tmp_path / name), name, str(tmp_path / f"{name}-log"), available_now=True).start()
        query.awaitTermination()
    rejected = {r["error"] for r in spark.read.parquet(str(tmp_path / "rejected")).collect()}
    assert rejected == {"event_too_old", "event_name_too_long"}
    late = spark.read.parquet(str(tmp_path / "late")).collect()
    assert [r["error"] for r in late] == ["late event"]
