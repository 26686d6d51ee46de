"""Ingest edge cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from clickspan.functions.text import ip_to_hex
from clickspan.operators import ingest
from clickspan.plans.ingest import ingest_batch
from clickspan.sources import events as store
from clickspan.sources.testdata import raw_batches
from tests.helpers import at, event, events, rows

T = 1_700_000_000_000
RANGES_TEXT = ("start_ip long, end_ip long, start_text string, end_text string, country_code string, country_name string, "
               "region string, city string, latitude double, longitude double")
RANGES = "start_ip bigint, end_ip bigint, country_code string, country_name string, region string, city string, latitude double, longitude double"


def message(events_, app="a", device="d", user="u", server=T, **extra):
    return json.dumps({
        "batch": {"app_id": "client", "device_id": device, "user_id": user, "events": events_},
        "authenticated_app": app, "remote_addr": "8.8.4.4:1", "server_ts": server, **extra,
    })


def raw(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string").withColumn(
        "timestamp", F.timestamp_millis(F.lit(T)))


def one(**fields):
    return {"event_id": "e", "event_name": "n", "event_time": T, **fields}


def test_dead_letters(spark):
    values = [message([one()]), message([one()])[:30], "", "[1, 2]", "null", message([one(event_id="")]),
              message([one(), one(event_name="")])]
    usable, dead = ingest.dead_letter_split(raw(spark, values))
    assert sorted(r["error"] for r in dead.collect()) == [
        "empty event_id", "empty event_name"] + ["unparsable payload"] * 4
    assert usable.count() == 3
    payload = dead.filter("error = 'empty event_id'").select(
        F.unbase64("original_payload").cast("string")).first()[0]
    assert payload == values[5]
    rate = ingest.dead_letter_rate(raw(spark, values)).first()
    assert (rate["messages"], rate["dead"]) == (7, 6)


@pytest.mark.parametrize("size,valid", [(0, 0), (1, 1), (500, 500), (501, 0)])
def test_batch_size(spark, size, valid):
    frame = raw(spark, [message([one(event_id=f"e{i}") for i in range(size)])])
    ok, rejected = ingest.validate(ingest.explode_batches(ingest.dead_letter_split(frame)[0]))
    assert (ok.count(), rejected.count()) == (valid, size - valid)


def test_validation_rules(spark):
    day = 86_400_000
    made = [one(event_id="ok"), one(event_id="long", event_name="x" * 257), one(event_id="fits", event_name="x" * 256),
            one(event_id="old", event_time=T - 8 * day), one(event_id="week", event_time=T - 7 * day),
            one(event_id="ahead", event_time=T + 25 * 3_600_000), one(event_id="blank", event_name="")]
    checked = ingest.failed_rules(ingest.explode_batches(ingest.parse_messages(raw(spark, [message(made)]))))
    assert {r["event_id"]: r["failed"] for r in checked.collect()} == {
        "ok": [], "long": ["event_name_too_long"], "fits": [], "old": ["event_too_old"], "week": [],
        "ahead": ["event_in_future"], "blank": ["event_name_empty"]}
    assert {r["app_id"] for r in checked.collect()} == {"a"}


def test_defaults_are_stable(spark):
    frame = raw(spark, [message([{"event_name": "n", "props": {"k": 1}}, one(event_id="kept")])])
    filled = [
        rows(ingest.fill_defaults(ingest.explode_batches(ingest.parse_messages(frame))), "event_id", "event_ts")
        for _ in range(2)
    ]
    assert filled[0] == filled[1]
    assert ("kept", T) in filled[0] and any(len(i) == 64 and t == T for i, t in filled[0])


def test_dedup(spark):
    made = [event("first", at(), event_id="x"), event("second", at(seconds=5), event_id="x"),
            event("other app", at(), event_id="x", app="b"), event("single", at(), event_id="y")]
    frame = events(spark, made)
    assert rows(ingest.dedup_events(frame, ("app_id", "event_id")), "event_name") == [
        ("first",), ("other app",), ("single",)]
    assert rows(ingest.dedup_events(frame), "event_name") == [("first",), ("other app",), ("single",)]
    assert rows(ingest.dedup_events(frame, ("event_id",)), "event_id") == [("x",), ("y",)]


@pytest.mark.parametrize("forwarded,remote,want", [
    ("10.0.0.1, 8.8.8.8", "1.1.1.1:5", "8.8.8.8"),
    ("192.168.0.1 172.20.0.1", "1.1.1.1:5", "1.1.1.1"),
    ("garbage", "1.1.1.1:5", "1.1.1.1"),
    ("", "1.1.1.1:5", "1.1.1.1"),
    ("", "[2001:db8::1]:443", "2001:db8::1"),
    (None, "no-port", "no-port"),
    ("fd00::1, 2001:db8::7", "1.1.1.1:5", "2001:db8::7"),
    ("999.1.1.1,9.9.9.9", "1.1.1.1:5", "9.9.9.9"),
])
def test_client_ip(spark, forwarded, remote, want):
    frame = spark.createDataFrame([(forwarded, remote)], "f string, r string")
    assert frame.select(ingest.client_ip(F.col("f"), F.col("r"))).first()[0] == want


def test_geo(spark):
    ranges = spark.createDataFrame([
        (1 << 24, (1 << 24) + 255, "AA", "", "", "", 1.0, 1.0),
        ((1 << 24) + 65000, (1 << 24) + 140000, "BB", "", "", "", 2.0, 2.0),
    ], RANGES)
    addresses = ["1.0.0.0", "1.0.0.255", "1.0.1.0", "1.0.253.232", "1.1.0.0", "1.2.34.224", "1.2.34.225", "::1", ""]
    frame = spark.createDataFrame([(a,) for a in addresses], "client_ip string")
    got = dict(rows(ingest.geo_enrich(frame, ranges), "client_ip", "country_code"))
    assert got == {"1.0.0.0": "AA", "1.0.0.255": "AA", "1.0.1.0": "", "1.0.253.232": "BB", "1.1.0.0": "BB",
                   "1.2.34.224": "BB", "1.2.34.225": "", "::1": "", "": ""}


@pytest.mark.parametrize("agent,browser,system", [
    ("Mozilla Windows NT Chrome/1 Safari/1", "Chrome", "Windows"),
    ("Mozilla Windows NT Chrome/1 Safari/1 Edg/1", "Edge", "Windows"),
    ("Macintosh Version/1 Safari/1", "Safari", "macOS"),
    ("iPhone OS like Mac OS X Safari/1", "Safari", "iOS"),
    ("iPad like Mac OS X", "Other", "iOS"),
    ("Linux; Android Chrome/1", "Chrome", "Android"),
    ("X11 Linux Firefox/1", "Firefox", "Linux"),
    ("", "", ""), (None, "", ""),
])
def test_user_agent(spark, agent, browser, system):
    frame = spark.createDataFrame([(agent,)], "ua string")
    row = ingest.ua_enrich(frame, F.col("ua")).first()
    assert (row["browser"], row["os_family"]) == (browser, system)


@pytest.mark.parametrize("skew,kept", [(299_900, True), (300_000, True), (301_000, False), (-301_000, False), (-5, True)])
def test_clock(spark, skew, kept):
    frame = spark.createDataFrame([(T, T - skew)], "server_ts bigint, event_ts bigint")
    row = ingest.correct_time(frame).first()
    assert row["client_offset_ms"] == skew
    assert row["event_ts"] == (T - skew if kept else T)


def test_platform(spark):
    frame = spark.createDataFrame([(p,) for p in [" iPad ", "BROWSER", "reactnative", "backend", "tv", None]], "p string")
    got = [r[0] for r in frame.select(ingest.normalize_platform(F.col("p"))).collect()]
    assert got == ["ios", "web", "react_native", "server", "unknown", "unknown"]


def test_flatten_and_limit(spark):
    props = {"s": "t", "i": 7, "big": 1e21, "f": 0.5, "t": True, "n": None, "o": {"a": [1, "x"]}, "l": [1], "text": "1e5"}
    parsed = ingest.explode_batches(ingest.parse_messages(raw(spark, [message([one(props=props)]), message([one()])])))
    got = [r[0] for r in parsed.select(ingest.flatten_props(F.col("raw_props"))).collect()]
    assert got[0] == {"s": "t", "i": "7", "big": "1000000000000000000000", "f": "0.5", "t": "true", "n": "",
                      "o": '{"a":[1,"x"]}', "l": "[1]", "text": "1e5"}
    assert got[1] == {}
    wide = {f"k{i:03d}": "v" for i in range(51)}
    wide["k000"] = "x" * 1025
    long = {"z" * 300: "1", "z" * 256 + "y": "2", "a": "3"}
    frame = spark.createDataFrame([(wide,), (long,), (None,)], "p map<string,string>")
    limited = frame.select(ingest.limit_props(F.col("p"), 50, 256, 1024).alias("l")).select("l.*")
    (first, gone), (second, cut), nothing = [tuple(r) for r in limited.collect()]
    assert len(first) == 50 and len(first["k000"]) == 1024 and "k050" not in first and gone == 1
    assert set(second) == {"a", "z" * 256} and cut == 1
    assert nothing == (None, None)


def test_limit_reads_properties_once(spark):
    """The entries are not sorted again for each entry."""
    wide = {f"k{i:05d}": str(i) for i in range(20_000)}
    frame = spark.createDataFrame([(wide,)], "p map<string,string>")
    limited = ingest.limit_props(F.col("p"), 15_000, 256, 1024)
    assert str(limited).count("map_entries") == 1
    kept, dropped = frame.select(limited.alias("l")).select("l.*").first()
    assert len(kept) == 15_000 and kept["k14999"] == "14999" and dropped == 5_000


def test_properties_are_read_once_and_not_shuffled_to_be_sent(spark, sf_dir):
    assert str(ingest.flatten_props(F.col("p"))).count("'string'") + str(ingest.flatten_props(F.col("p"))).count(", string)") == 1
    below = raw_batches(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1]
    assert "collect_list" in below and "map_" not in below


def test_nothing_is_lost_on_the_way(spark):
    """Many properties, ids used again by another tenant, several events in a message."""
    props = {f"k{i:02d}": "v" * 2000 for i in range(60)} | {"install_source": "ad", "utm_source": "x", "campaign_id": "c"}
    values = [message([one(event_id="1", props=props), one(event_id="2")], app="a"), message([one(event_id="1")], app="b"),
              message([one(event_id="1")], app="a")]
    done = ingest_batch(raw(spark, values), spark.createDataFrame([], RANGES)).events
    assert rows(done, "app_id", "event_id") == [("a", "1"), ("a", "2"), ("b", "1")]
    wide = done.filter("app_id = 'a' and event_id = '1' and size(props) > 0").first()
    assert len(wide["props"]) == 63 and len(wide["props"]["k59"]) == 2000
    assert (wide["install_source"], wide["campaign_id"], wide["props"]["utm_source"]) == ("ad", "c", "x")
    stored = done.filter("app_id = 'a'")
    assert rows(store.new_rows(done, stored), "app_id", "event_id") == [("b", "1")]


def test_report_reads_messages_once(spark, tmp_path):
    """Copies, rejected events, an id used again by another tenant, and a hashed id, in one pass."""
    bad = one(event_id="3", event_time=T - 8 * 86_400_000)
    values = [message([one(event_id="1"), one(event_id="2"), bad]), message([one(event_id="1")], server=T + 5),
              message([one(event_id="1")], app="b"), message([one(event_id="")], app="b"), message([one(event_id="")], app="b"),
              message([one(event_id="9")], app="c", device="")]
    raw(spark, values).write.parquet(str(tmp_path / "raw"))
    report = ingest_batch(spark.read.parquet(str(tmp_path / "raw")), spark.createDataFrame([], RANGES)).report
    assert rows(report) == [("a", 4, 2, 2), ("b", 3, 2, 1), ("c", 1, 0, 1)]
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


@pytest.mark.parametrize("text,digits", [
    ("2001:db8::1", "20010db8000000000000000000000001"), ("::", "0" * 32), ("::ffff:1.2.3.4", "0" * 20 + "ffff01020304"),
    ("1:2:3:4:5:6:7:8", "00010002000300040005000600070008"), ("FE80::A", "fe80" + "0" * 27 + "a"), ("1.2.3.4", "0" * 20 + "ffff01020304"), ("1.2.3", None),
    ("1:2", None), ("::g", None), ("1::2::3", None), ("", None), (None, None),
])
def test_ip_digits(spark, text, digits):
    assert spark.createDataFrame([(text,)], "t string").select(ip_to_hex(F.col("t"))).first()[0] == digits


def test_geo_of_both_families_and_nested_ranges(spark):
    place = lambda city: ("XX", "X", "x", city, 1.0, 2.0)
    ranges = spark.createDataFrame([
        (16777216, 33554431, None, None, *place("wide")), (16777472, 16777727, None, None, *place("narrow")),
        (None, None, "2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", *place("six")),
        (None, None, "2001:db8:0:1::", "2001:db8:0:1:ffff:ffff:ffff:ffff", *place("six-narrow")),
        (None, None, "2000::", "3fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", *place("all")),
        (None, None, "1.0.1.16", "1.0.1.31", *place("text")), (16777480, 16777740, None, None, *place("across")),
    ], "start_ip long, end_ip long, start_text string, end_text string, country_code string, country_name string, "
       "region string, city string, latitude double, longitude double")
    want = {"1.0.1.7": "narrow", "1.0.1.8": "across", "1.0.1.15": "across", "1.0.1.16": "text", "1.0.1.31": "text",
            "1.0.1.32": "across", "1.0.2.0": "across", "1.0.2.12": "across", "1.0.2.13": "wide", "::ffff:1.0.1.7": "narrow",
            "1.0.0.0": "wide", "0.255.255.255": "", "1.255.255.255": "wide", "2.0.0.0": "", "2001:db8::5": "six",
            "2001:DB8:0:1::5": "six-narrow", "2400::1": "all", "fe80::1": "", "junk": "", None: ""}
    frame = spark.createDataFrame([(ip,) for ip in want for _ in range(2)], "client_ip string")
    got = rows(ingest.geo_enrich(frame, ranges), "client_ip", "city")
    assert got == sorted([(ip, city) for ip, city in want.items()] * 2, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_against_brute_force(spark, seed):
    """Nested, overlapping, repeated and adjacent ranges: the last to begin wins, then the first to end."""
    rng = random.Random(seed)
    base, made = 0x0A000000, []
    for i in range(60):
        begin = base + rng.randrange(300)
        made.append((begin, begin + rng.choice([0, 1, 5, 40, 200, 70_000]), None, None, "XX", "X", "x", f"c{i:02d}", 1.0, 2.0))
    made += made[:5]
    ranges = spark.createDataFrame(made, RANGES_TEXT)
    addresses = [base - 1, *range(base, base + 520), base + 65_536 + 7, base + 70_400]
    frame = spark.createDataFrame([(".".join(str(a >> s & 255) for s in (24, 16, 8, 0)),) for a in addresses], "client_ip string")
    want = []
    for a in addresses:
        inside = sorted((-m[0], m[1], m[7]) for m in made if m[0] <= a <= m[1])
        want.append((".".join(str(a >> s & 255) for s in (24, 16, 8, 0)), inside[0][2] if inside else ""))
    assert rows(ingest.geo_enrich(frame, ranges), "client_ip", "city") == sorted(want, key=repr)
    stored = ingest.disjoint_ranges(ranges).cache()
    assert rows(ingest.geo_enrich(frame, stored), "client_ip", "city") == sorted(want, key=repr)


def test_deeply_nested_ranges_make_linear_pieces(spark):
    n = 10_000
    made = spark.range(n).selectExpr(
        "167772160 + id AS start_ip", f"167772160 + 2 * {n} - id AS end_ip", "CAST(NULL AS STRING) AS start_text", "CAST(NULL AS STRING) AS end_text",
        "'XX' AS country_code", "'X' AS country_name", "'x' AS region", "CAST(id AS STRING) AS city", "1D AS latitude", "2D AS longitude")
    pieces = ingest.disjoint_ranges(made)
    assert pieces.count() == 2 * n - 1
    assert pieces.groupBy("place.city").count().filter("count > 2").count() == 0


def test_chain_and_replay(spark):
    ranges = spark.createDataFrame([], RANGES)
    values = [message([one(event_id="1", revenue=2.5, props={"install_source": "ad", "k": 1})]),
              message([one(event_id="1")], server=T + 1), message([one(event_id="")]), "{"]
    done = ingest_batch(raw(spark, values), ranges)
    kept = done.events.filter("event_id = '1'").first()
    assert (kept["revenue"], kept["install_source"], kept["props"]["k"], kept["platform"]) == (2.5, "ad", "1", "unknown")
    assert done.events.count() == 2
    report = done.report.first()
    assert (report["received"], report["accepted"], report["filtered"]) == (3, 2, 1)
    again = store.replay(done.dead, ranges, done.events.limit(0))
    assert again.count() == 1
    assert store.replay(done.dead, ranges, done.events).count() == 0


def test_profiles_identity_quota(spark):
    traits = spark.createDataFrame([
        ("a", "u", {"plan": "free", "x": "1"}, at()), ("a", "u", {"plan": "pro"}, at(days=1)),
    ], "app_id string, user_id string, traits map<string,string>, ts timestamp")
    merged = ingest.merge_profiles(traits).first()
    assert merged["traits"] == {"plan": "pro", "x": "1"}
    identified = ingest.identify_events(traits)
    assert identified.first()["event_name"] == "user_updated"
    assert identified.unionByName(events(spark, [event()])).count() == 3
    made = [event(time=at(), user="old"), event(time=at(seconds=1), user="new"), event(time=at(seconds=2), user="")]
    assert ingest.resolve_identity(events(spark, made)).first()["user_id"] == "new"
    apps = spark.createDataFrame([("a", "o", "a", 1.0, 2, True)], "id string, org_id string, name string, rps double, burst int, active boolean")
    burst = events(spark, [event(time=at(seconds=s)) for s in (0, 0.1, 0.2, 0.3, 5)])
    usage = ingest.quota_usage(burst, apps).first()
    assert (usage["peak_events"], usage["intervals_over_rate"], usage["events_over_burst"]) == (4, 1, 2)
    unlimited = ingest.quota_usage(burst, apps.limit(0)).first()
    assert (unlimited["events"], unlimited["intervals_over_rate"], unlimited["events_over_burst"]) == (5, None, None)
