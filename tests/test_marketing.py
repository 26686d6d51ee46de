"""Attribution, experiments, segments, alerts and campaigns."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickspan.functions.scans import Running, in_chunks, running
from clickspan.functions.stats import two_sided_p
from clickspan.functions.text import PropertyFilter
from clickspan.functions.greedy import greedy
from clickspan.operators import alerts, attribution, campaigns, experiments, users
from clickspan.schema import CAMPAIGNS, DELIVERIES
from clickspan.vocabulary import Vocabulary
from tests.helpers import at, event, events, rows

V = Vocabulary(purchase=("buy",))


def touch(source, time, user="u", name="view"):
    return event(name, time, user=user, props={"utm_source": source, "utm_medium": "m", "utm_campaign": "c"})


@pytest.mark.parametrize("chunk", [1, 50, 100000])
def test_running_scans(spark, chunk):
    rng = random.Random(chunk)
    made = [(f"k{i % 3}", rng.randrange(-500, 500), rng.choice([None, 1, 2, 3])) for i in range(400)]
    frame = spark.createDataFrame(made, "k string, t bigint, v int")
    latest = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    placed = in_chunks(frame, F.col("t"), chunk)
    plain = Window.partitionBy("k").orderBy("t")
    got = running(placed, ["k"], {"s": Running("sum", F.col("v")), "l": Running("latest", latest)})
    want = frame.withColumn("s", F.coalesce(F.sum("v").over(plain), F.lit(0))).withColumn("l", F.max(latest).over(plain))
    assert rows(got, *want.columns) == rows(want)
    back = running(placed, ["k"], {"s": Running("sum", F.col("v"))}, backwards=True)
    after = Window.partitionBy("k").orderBy(F.desc("t"))
    want = frame.withColumn("s", F.coalesce(F.sum("v").over(after), F.lit(0)))
    assert rows(back, *want.columns) == rows(want)


@pytest.fixture
def journeys(spark):
    return events(spark, [
        touch("g", at()), touch("f", at(hours=1)), event("buy", at(hours=2), revenue=10.0),
        touch("e", at(hours=3)), event("buy", at(hours=4), revenue=30.0),
        event("buy", at(), user="direct", revenue=7.0), touch("g", at(hours=1), user="direct"),
        touch("f", at(), user="browser"),
    ])


def test_first_touch(journeys):
    got = attribution.attribution(journeys, "first_touch", vocabulary=V)
    assert rows(got, "source", "users", "conversions", "revenue", "conversion_pct") == [
        ("f", 1, 0, 0.0, 0.0), ("g", 2, 3, 47.0, 150.0)]
    first = rows(attribution.user_attribution(journeys), "user_id", "first_source", "last_source")
    assert first == [("browser", "f", "f"), ("direct", "g", "g"), ("u", "g", "e")]


def test_last_touch(journeys):
    got = attribution.attribution(journeys, "last_touch", vocabulary=V)
    assert rows(got, "source", "conversions", "revenue") == [("(none)", 1, 7.0), ("e", 1, 30.0), ("f", 1, 10.0)]


def test_linear(journeys):
    got = attribution.attribution(journeys, "linear", vocabulary=V)
    found = {r["source"]: (round(r["conversions"], 6), round(r["revenue"], 6)) for r in got.collect()}
    assert found == {"(none)": (1.0, 7.0), "g": (0.833333, 15.0), "f": (0.833333, 15.0), "e": (0.333333, 10.0)}
    total = got.agg(F.sum("conversions"), F.sum("revenue")).first()
    assert (round(total[0], 6), round(total[1], 6)) == (3.0, 47.0)


def test_a_purchase_can_be_its_own_touch(spark):
    frame = events(spark, [event("buy", at(), revenue=5.0, props={"utm_source": "g"})])
    for model in ("last_touch", "linear"):
        assert attribution.attribution(frame, model, vocabulary=V).first()["source"] == "g"
    with pytest.raises(ValueError):
        attribution.attribution(frame, "u_shaped")


def test_experiment(spark):
    assigned = [("x", f"c{i}", "a", "control", at()) for i in range(100)]
    assigned += [("x", f"t{i}", "a", "new", at()) for i in range(100)]
    assigned += [("x", "c0", "a", "new", at(days=-1)), ("y", "t1", "a", "new", at())]
    made = [event("goal", user=f"c{i}") for i in range(10)] + [event("goal", user=f"t{i}") for i in range(30)]
    made += [event("goal", user="t0"), event("buy", user="t0", revenue=3.0)]
    log = spark.createDataFrame(assigned, "experiment_id string, user_id string, app_id string, variant string, assigned_at timestamp")
    got = {(r["experiment_id"], r["variant"]): r for r in experiments.experiment_results(events(spark, made), log, "goal", V).collect()}
    new = got["x", "new"]
    assert (new["users"], new["goal_events"], new["converting_users"], new["revenue"]) == (100, 31, 30, 3.0)
    assert (new["conversion_pct"], round(new["lift_pct"], 6)) == (30.0, 200.0)
    assert new["p_value"] == pytest.approx(0.000406952, abs=1e-6)
    assert got["x", "control"]["p_value"] is None and got["y", "new"]["lift_pct"] is None
    none = experiments.experiment_results(events(spark, [event("other")]), log, "goal", V)
    assert {r["p_value"] for r in none.filter("experiment_id = 'x' AND variant = 'new'").collect()} == {1.0}


def test_p_value(spark):
    frame = spark.createDataFrame([(0.0,), (1.959964,), (-2.575829,)], "z double")
    got = [r[0] for r in frame.select(two_sided_p(F.col("z"))).collect()]
    assert got == pytest.approx([1.0, 0.05, 0.01], abs=1e-6)


def test_assignment_is_stable_and_weighted(spark):
    table = spark.sql("""SELECT 'x' AS id, 'a' AS app_id, 'x' AS name, 'on' AS status,
      array(named_struct('name', 'control', 'weight', 1), named_struct('name', 'new', 'weight', 3)) AS variants,
      array(named_struct('metric', 'goal', 'type', 'primary')) AS metric_goals""")
    people = spark.range(8000).select(F.lit("a").alias("app_id"), F.concat(F.lit("u"), "id").alias("user_id"))
    first = experiments.assign_variant(people, table)
    assert first.count() == 8000
    share = first.filter("variant = 'new'").count() / 8000
    assert abs(share - 0.75) < 0.02
    assert rows(first) == rows(experiments.assign_variant(people, table))


def test_segments(spark):
    made = [event("a", user="both"), event("b", user="both", props={"plan": "PRO 100%"}), event("a", user="half"),
            event("a", user="free"), event("b", user="free", props={"plan": "free"})]
    frame = events(spark, made)
    names = lambda *args: [r[0] for r in rows(users.segment_users(frame, *args), "user_id")]
    assert names(["a", "b"]) == ["both", "free"]
    assert names([], [PropertyFilter("plan", "contains", "pro")]) == ["both"]
    assert names([], [PropertyFilter("plan", "contains", "0%")]) == ["both"]
    assert names([], [PropertyFilter("plan", "contains", "p%o")]) == []
    assert names(["a", "b"], [PropertyFilter("plan", "neq", "free")]) == ["both", "free"]
    assert users.segment_count(frame, ["a", "b"], [PropertyFilter("plan", "eq", "free")]).first()["matched_users"] == 1


def test_cohorts_keep_old_count_on_error(spark):
    frame = events(spark, [event("buy", user=u, revenue=r) for u, r in [("u", 1.0), ("u", 9.0), ("v", 9.0)]])
    got = users.cohort_recompute(frame, [
        users.Cohort("big", "a", "revenue > 5"), users.Cohort("none", "zz", "true"),
        users.Cohort("bad", "a", "revenue >", 3), users.Cohort("worse", "a", "nope = 1", 4)], at())
    assert {r["cohort_id"]: r["user_count"] for r in got.collect()} == {"big": 2, "none": 0, "bad": 3, "worse": 4}
    assert got.filter("last_computed_at IS NULL").count() == 2


def test_a_bad_value_spoils_no_cohort(spark):
    frame = events(spark, [event("buy", user="u", props={"plan": "7"}), event("buy", user="v", props={"plan": "pro"})])
    table = spark.createDataFrame([("n", "a", "", "CAST(props['plan'] AS DOUBLE) > 1", 0), ("all", "a", "", "true", 0)],
                                  "id string, app_id string, name string, filter_sql string, user_count long")
    got = {r["cohort_id"]: r["user_count"] for r in users.cohort_recompute(frame, table, at()).collect()}
    assert got == {"n": 1, "all": 2}
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    with pytest.raises(ValueError):
        users.stored_cohorts(table, most=1)


def test_cooldown_of_a_long_key(spark):
    made = spark.range(30_000).selectExpr(
        "'r' AS rule_id", "timestamp_seconds(id) AS fired_at", "CASE WHEN id % 2 = 0 THEN 1 END AS wait")
    sent = alerts.apply_cooldown(made, F.col("wait"))
    assert sent.filter("wait = 1").count() == 15_000 and sent.filter("wait IS NULL").count() == 15_000
    assert alerts.apply_cooldown(made, 7).count() == -(-30_000 // 7)


def rules(spark, made):
    return spark.createDataFrame(
        [(f"r{i}", "a", m, c, float(t), w, on) for i, (m, c, t, w, on) in enumerate(made)],
        "id string, app_id string, metric_name string, condition string, threshold double, window_mins int, active boolean")


def test_alert_rules(spark):
    made = [event("error", at(minutes=-5), device="d1"), event("view", at(minutes=-10), device="d2"),
            event("view", at(minutes=-90), device="d3")]
    frame = events(spark, made)
    table = rules(spark, [
        ("event_count", c, 2, 60, True)
        for c in ("gt", "lt", "eq", "gte", "lte", ">", "<", "=", ">=", "<=")
    ] + [("event_count", "gte", 0, 60, False), ("error_rate", "eq", 50, 60, True), ("active_users", "eq", 3, 120, True)])
    metrics = alerts.alert_metrics(frame, [60, 120], at())
    fired = alerts.evaluate_alerts(table, metrics, at())
    assert sorted(r[0] for r in fired.select("rule_id").collect()) == sorted(["r2", "r3", "r4", "r7", "r8", "r9", "r11", "r12"])


def test_empty_window(spark):
    frame = events(spark, [event("view", at(days=-9))])
    table = rules(spark, [("event_count", "eq", 0, 60, True), ("error_rate", "gte", 0, 60, True), ("event_rate", "lt", 1, 60, True)])
    fired = alerts.evaluate_alerts(table, alerts.alert_metrics(frame, [60], at()), at())
    assert sorted(r[0] for r in fired.select("rule_id").collect()) == ["r0", "r2"]
    named = alerts.last_fired(table, fired)
    assert {r["id"]: r["last_fired_at"] is not None for r in named.collect()} == {"r0": True, "r1": False, "r2": True}


def test_cooldown(spark):
    times = [at(), at(minutes=10), at(minutes=29, seconds=59), at(minutes=30), at(minutes=45), at(minutes=60, seconds=0.5)]
    fired = spark.createDataFrame([("r", t, i) for i, t in enumerate(times)], "rule_id string, fired_at timestamp, n int")
    assert [r["n"] for r in alerts.apply_cooldown(fired).orderBy("n").collect()] == [0, 3, 5]


def greedy_fold(made):
    """Sent rows of (key, second, wait) in order: each against the last one sent."""
    sent, last = [], {}
    for key, second, wait in made:
        if key not in last or second - last[key] >= wait:
            sent.append((key, second, wait))
            last[key] = second
    return sent


def test_cooldown_of_mixed_waits(spark):
    made = [("r", at(seconds=s), w) for s, w in ((100, 1800), (110, 60), (115, 0), (2000, 1800))]
    fired = spark.createDataFrame(made, "rule_id string, fired_at timestamp, w int")
    assert rows(alerts.apply_cooldown(fired, F.col("w")), "w") == [(0,), (1800,), (1800,)]


@pytest.mark.parametrize("seed", range(3))
def test_mixed_waits_against_fold(spark, seed):
    rng = random.Random(seed)
    made = []
    for k in [None, "", "a", "b"]:
        span = rng.choice([300, 90_000, 400_000])
        # Seconds are distinct: inside a second the order of rows is another test's matter.
        made += [(k, t, rng.choice([0, 1, 60, 1800, 100_000])) for t in sorted(rng.sample(range(-span, span), rng.choice([3, 250])))]
    fired = spark.createDataFrame([(k, at(seconds=t), w) for k, t, w in made], "rule_id string, fired_at timestamp, w int")
    base = int(at().timestamp())
    got = alerts.apply_cooldown(fired, F.col("w")).select("rule_id", F.unix_seconds("fired_at") - base, "w")
    assert rows(got) == sorted(greedy_fold(made), key=repr)


def test_a_hot_key_is_spread_over_its_days(spark):
    """No task of the selection reads more than the blocks that are dealt to it."""
    made = spark.range(40 * 144).select(F.lit("hot").alias("k"), (F.col("id") * 600).alias("p")).withColumn("f", F.col("p") - 1800)
    dealt = made.select("k", F.floor(F.col("p") / 86_400).alias("b")).repartition(8, "k", "b")
    assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    kept = greedy(made, ["k"], "p", "f", 86_400)
    assert [r["p"] for r in kept.orderBy("p").collect()] == list(range(0, 40 * 86_400, 1800))


@pytest.mark.parametrize("seed", range(4))
def test_greedy_selection_against_fold(seed, spark):
    rng = random.Random(seed)
    made = [(k, p, p - rng.choice([0, 1, 5, 40, 300])) for k in "abc" for p in sorted(rng.sample(range(-500, 1500), rng.choice([1, 30, 600])))]
    frame = spark.createDataFrame(made, "k string, p bigint, f bigint")
    want, last = [], {}
    for k, p, f in made:
        if k not in last or min(f, p - 1) >= last[k]:
            want.append((k, p, last.get(k)))
            last[k] = p
    for length in (1, 7, 100, 10_000):
        assert rows(greedy(frame, ["k"], "p", "f", length).select("k", "p", "_before")) == sorted(want, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_cooldown_against_fold(spark, seed):
    rng = random.Random(seed)
    made, want = [], []
    for k in range(5):
        times = sorted(rng.sample(range(20000), rng.choice([5, 300, 4000])))
        last = None
        for t in times:
            made.append((f"r{k}", at(seconds=t)))
            if last is None or t - last >= 600:
                want.append((f"r{k}", t))
                last = t
    fired = spark.createDataFrame(made, "rule_id string, fired_at timestamp")
    base = int(at().timestamp())
    got = alerts.apply_cooldown(fired, 600).select("rule_id", F.unix_seconds("fired_at") - base)
    assert rows(got) == sorted(want, key=repr)


def test_no_cooldown_sends_everything(spark):
    """Rows without a wait all go, and count as sent for the rows that have one."""
    fired = spark.createDataFrame([("r", at(), w) for w in (0, 0, 60, 60)], "rule_id string, fired_at timestamp, w int")
    got = alerts.apply_cooldown(fired, F.col("w"), ("rule_id",))
    assert rows(got, "w") == [(0,), (0,)]


def test_campaigns(spark):
    table = spark.createDataFrame([
        ("c1", "a", "c", "event", {"topic": "buy"}, "push", {}, True, None, 60),
        ("c2", "a", "c", "event", {"topic": "buy"}, "push", {}, True, "vip", None),
        ("c3", "a", "c", "event", {"topic": "buy"}, "push", {}, False, None, 60),
        ("c4", "other", "c", "event", {"topic": "buy"}, "push", {}, True, None, 60),
    ], CAMPAIGNS)
    made = [event("buy", at(seconds=s), user=u) for u in ("u", "v") for s in (0, 30, 60)]
    members = spark.createDataFrame([("vip", "a", "v")], "segment_id string, app_id string, user_id string")
    got = campaigns.campaign_triggers(events(spark, made), table, members)
    assert rows(got.groupBy("campaign_id", "user_id").count()) == [("c1", "u", 2), ("c1", "v", 2), ("c2", "v", 1)]
    weekly = spark.createDataFrame([("c5", "a", "c", "scheduled", {}, "email", {}, True, "vip", None)], CAMPAIGNS)
    run = campaigns.delivery_outbox(campaigns.scheduled_notifications(weekly, members, at()))
    assert rows(run, "campaign_id", "user_id", "channel") == [("c5", "v", "email")]
    outbox = campaigns.delivery_outbox(got)
    assert outbox.select("id").distinct().count() == 5
    log = spark.createDataFrame([("1", "c", "a", "u", "push", s, at()) for s in ["sent"] * 4 + ["delivered"] * 3 + ["opened", "failed"]], DELIVERIES)
    row = campaigns.campaign_stats(log).first()
    assert (row["sent"], row["delivered"], row["failed"], row["delivery_pct"], row["open_pct"]) == (4, 3, 1, 75.0, 25.0)
