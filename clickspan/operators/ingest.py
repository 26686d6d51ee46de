"""Ingest transforms, used alike on batch and streaming DataFrames."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspan.functions.text import IPV4_DIGITS, ip_to_hex, is_ipv4, is_ipv6, not_blank
from clickspan.functions.time import seconds
from clickspan.schema import ENVELOPE, EVENT_COLUMNS

# What makes two events the same one: ids are only unique within a tenant's device.
EVENT_KEY = ("app_id", "device_id", "event_id")


def parse_messages(raw: DataFrame) -> DataFrame:
    """Add ``msg`` (the parsed envelope) and ``error`` (null when the message is usable)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    message = F.from_json(F.col("value").cast("string"), ENVELOPE, options)
    # Generated, not projected: the optimizer copies a projected parse into every later filter and
    # column, and each copy would parse the message again.
    parsed = raw.select("*", F.explode_outer(F.array(message)).alias("msg"))
    bad = F.col("msg").isNull() | F.col("msg._corrupt").isNotNull() | F.col("msg.batch.events").isNull()
    events = F.col("msg.batch.events")

    def lacks(field: str) -> Column:
        return F.exists(events, lambda e: F.coalesce(e[field], F.lit("")) == "")

    error = (
        F.when(bad, F.lit("unparsable payload"))
        .when(lacks("event_id"), F.lit("empty event_id"))
        .when(lacks("event_name"), F.lit("empty event_name"))
    )
    return parsed.withColumn("error", error)


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Messages that did not parse or hold an event without id or name."""
    return parsed.filter(F.col("error").isNotNull()).select(
        F.base64(F.col("value").cast("binary")).alias("original_payload"), "error",
        F.col("timestamp").alias("ts"),
    )


def dead_letter_split(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable messages, dead letters)."""
    parsed = parse_messages(raw)
    usable = parsed.filter(
        F.col("error").isNull() | (F.col("error") != "unparsable payload")
    )
    return usable, dead_letters(parsed)


def dead_letter_rate(raw: DataFrame) -> DataFrame:
    """Messages, dead letters and their share."""
    return parse_messages(raw).agg(
        F.count("*").alias("messages"), F.count("error").alias("dead"),
    ).withColumn("dead_rate", F.col("dead") / F.col("messages"))


def explode_batches(parsed: DataFrame) -> DataFrame:
    """One row per event with the batch fields copied down.

    The authenticated app replaces whatever tenant the client wrote.
    """
    batch = F.col("msg.batch")
    rows = parsed.select(
        F.coalesce(F.col("msg.authenticated_app"), batch["app_id"]).alias("app_id"),
        batch["device_id"].alias("device_id"),
        F.coalesce(batch["user_id"], F.lit("")).alias("user_id"),
        F.col("msg.x_forwarded_for").alias("x_forwarded_for"),
        F.coalesce(F.col("msg.remote_addr"), F.col("msg.client_ip"), F.lit("")).alias("remote_addr"),
        F.col("msg.server_ts").alias("server_ts"),
        F.size(batch["events"]).alias("batch_size"),
        F.explode(batch["events"]).alias("event"),
    )
    return rows.select(
        *[c for c in rows.columns if c != "event"],
        F.col("event.event_id").alias("event_id"), F.col("event.event_name").alias("event_name"),
        F.col("event.event_time").alias("event_ts"), F.col("event.props").alias("raw_props"),
        F.col("event.device").alias("device"), F.col("event.app").alias("app"),
        F.col("event.revenue").alias("revenue"),
    )


def failed_rules(
    events: DataFrame, max_batch: int = 500, max_name: int = 256,
    max_age: str | int = "7 days", max_ahead: str | int = "1 day",
) -> DataFrame:
    """Add ``failed``: the names of the rules an event breaks.

    ``max_batch`` events in a message, ``max_name`` characters in a name, and how far the event time may
    lie before or after the server's.
    """
    age = F.col("server_ts") - F.col("event_ts")
    rules = {
        "batch_too_large": F.col("batch_size") > max_batch,
        "app_id_empty": ~not_blank("app_id"),
        "device_id_empty": ~not_blank("device_id"),
        "event_name_empty": ~not_blank("event_name"),
        "event_name_too_long": F.length("event_name") > max_name,
        "event_too_old": age > seconds(max_age) * 1000,
        "event_in_future": age < -1000 * seconds(max_ahead),
    }
    return events.withColumn(
        "failed", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    )


def validate(events: DataFrame, **limits: str | int) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); rejected rows keep the list of broken rules. ``limits`` as in ``failed_rules``."""
    checked = failed_rules(events, **limits)
    return (
        checked.filter(F.size("failed") == 0).drop("failed"),
        checked.filter(F.size("failed") > 0),
    )


def fill_defaults(events: DataFrame) -> DataFrame:
    """Missing id: a hash of the content, so a replay gives the same id. Missing time: server time."""
    content = F.concat_ws(
        "|", "app_id", "device_id", "user_id", "event_name",
        F.coalesce("event_ts", "server_ts"), F.to_json("raw_props"),
    )
    return events.withColumn(
        "event_id", F.when(not_blank("event_id"), F.col("event_id")).otherwise(F.sha2(content, 256))
    ).withColumn("event_ts", F.coalesce("event_ts", "server_ts"))


def dedup_events(
    events: DataFrame,
    keys: Sequence[str | Column] = EVENT_KEY,
    order: Sequence[str] = ("server_time", "event_time"),
) -> DataFrame:
    """First occurrence per key, by default per id of a tenant's device.

    Spark limits each map task to one candidate per key before the shuffle, so many copies of one
    id do not meet in one task.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("_rank", F.row_number().over(first)).filter(
        F.col("_rank") == 1
    ).drop("_rank")


def ingest_report(received: DataFrame, accepted: DataFrame) -> DataFrame:
    """Events received, accepted and filtered out per app."""
    before = received.groupBy("app_id").agg(F.count("*").alias("received"))
    after = accepted.groupBy("app_id").agg(F.count("*").alias("accepted"))
    both = before.join(after, "app_id", "full_outer")
    received_n = F.coalesce("received", F.lit(0))
    accepted_n = F.coalesce("accepted", F.lit(0))
    return both.select(
        "app_id", received_n.alias("received"), accepted_n.alias("accepted"),
        (received_n - accepted_n).alias("filtered"),
    )


def ingest_report_once(received: DataFrame) -> DataFrame:
    """``ingest_report`` of ``received`` against its valid events, each counted once, in one pass over the messages.

    Events are summed up by key first, by map tasks as well, so neither copies nor properties are shuffled.
    """
    by_key = timed(failed_rules(received)).groupBy(*EVENT_KEY).agg(
        F.count("*").alias("_n"), F.max((F.size("failed") == 0).cast("bigint")).alias("_valid"))
    return by_key.groupBy("app_id").agg(F.sum("_n").alias("received"), F.sum("_valid").alias("accepted")).withColumn(
        "filtered", F.col("received") - F.col("accepted"))


def _is_private(ip: Column) -> Column:
    return ip.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)") | ip.rlike(r"(?i)^f[cd][0-9a-f]{2}:")


def client_ip(forwarded: Column, remote: Column) -> Column:
    """Leftmost public address of X-Forwarded-For, else the host of the remote address."""
    listed = F.filter(
        F.split(F.coalesce(forwarded, F.lit("")), "[, ]+"),
        lambda ip: (is_ipv4(ip) | is_ipv6(ip)) & ~_is_private(ip),
    )
    host = (
        F.when(remote.rlike(r"^\[[^\]]*\]:[^:]*$"), F.regexp_extract(remote, r"^\[([^\]]*)\]", 1))
        .when(remote.rlike(r"^[^:\[\]]*:[^:]*$"), F.split(remote, ":")[0])
        .otherwise(remote)
    )
    return F.coalesce(F.get(listed, F.lit(0)), host)


GEO_FIELDS = ["country_code", "country_name", "region", "city", "latitude", "longitude"]


def _block(digits: Column) -> Column:
    """What addresses are looked up by: the /16 of an IPv4 address, the /20 of others."""
    return F.when(digits.startswith(IPV4_DIGITS), F.substring(digits, 1, 28)).otherwise(F.substring(digits, 1, 5))


def _in_blocks(ip_ranges: DataFrame) -> DataFrame:
    """(block, begin, end, location) for every block that a range touches, ends as hexadecimal digits."""
    begin, end = (
        F.when(F.col(f"{side}_ip").isNotNull(), F.concat(F.lit(IPV4_DIGITS), F.lower(F.lpad(F.hex(f"{side}_ip"), 8, "0"))))
        for side in ("start", "end")
    )
    if "start_text" in ip_ranges.columns:
        begin, end = (F.coalesce(known, ip_to_hex(F.col(f"{side}_text"))) for known, side in ((begin, "start"), (end, "end")))
    rows = ip_ranges.select(begin.alias("begin"), end.alias("end"), *GEO_FIELDS).filter("begin <= end")
    first, last = _block(F.col("begin")), _block(F.col("end"))
    fixed = F.when(F.length(first) == 28, F.lit(IPV4_DIGITS)).otherwise(F.lit(""))
    width = F.when(F.length(first) == 28, 4).otherwise(5)
    number = lambda block: F.conv(F.substr(block, F.length(fixed) + 1), 16, 10).cast("bigint")
    blocks = F.transform(
        F.sequence(number(first), number(last)), lambda n: F.concat(fixed, F.lower(F.lpad(F.hex(n), width, "0"))))
    return rows.filter(F.length(first) == F.length(last)).select("begin", "end", F.struct(*GEO_FIELDS).alias("place"), F.explode(blocks).alias("block"))


def disjoint_ranges(ip_ranges: DataFrame) -> DataFrame:
    """(block, from, to, place): pieces that no address is in twice, ``from`` inclusive and ``to`` exclusive.

    Ranges may nest or overlap: the one that begins last wins, then the one that ends first, which of
    nested ranges is the narrowest. Points are digits with 0 for an address and 1 for just behind it. Every block
    is swept once from its first to its last point, with a heap of the ranges that are open, so the work and
    the pieces are linear in the ranges (but for the heap's logarithm), however deep they nest.
    """
    rows = _in_blocks(ip_ranges).select("block", F.concat("begin", F.lit("0")).alias("from"), F.concat("end", F.lit("1")).alias("to"), "place")
    # Of ranges that begin together the narrowest comes last: a later row always wins over an earlier one.
    ordered = rows.repartition("block").sortWithinPartitions("block", "from", F.desc("to"), F.desc("place"))
    return ordered.mapInArrow(_swept, rows.schema)


def _swept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Disjoint pieces of sorted ranges, block by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
        for begin, end in pairwise(cuts):
            if held and held[0].column(0)[0] != batch.column(0)[begin]:
                yield from _pieces(held)
                held = []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield from _pieces(held)


def _pieces(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = pa.Table.from_batches(held).combine_chunks()
    begins, ends = ranges.column("from").to_pylist(), ranges.column("to").to_pylist()
    found: list[list] = []  # place by number of its range, from, to
    heap: list[int] = []
    at = 0
    for point, following in pairwise(sorted({*begins, *ends})):
        while at < len(begins) and begins[at] == point:
            heapq.heappush(heap, -at)
            at += 1
        while heap and ends[-heap[0]] <= point:
            heapq.heappop(heap)
        if heap and found and found[-1][0] == -heap[0] and found[-1][2] == point:
            found[-1][2] = following
        elif heap:
            found.append([-heap[0], point, following])
    for begin in range(0, len(found), 10_000):
        which, first, last = zip(*found[begin:begin + 10_000])
        taken = ranges.take(pa.array(which)).combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [taken.column("block").chunk(0), pa.array(first, pa.string()), pa.array(last, pa.string()), taken.column("place").chunk(0)],
            names=["block", "from", "to", "place"])


def geo_enrich(events: DataFrame, ip_ranges: DataFrame, ip_col: str = "client_ip") -> DataFrame:
    """Location of the address; no match gives empty text and null coordinates.

    ``ip_ranges`` are ranges or, better where many runs use them, the stored result of ``disjoint_ranges``. Ranges have ``start_ip`` and ``end_ip`` (IPv4 as numbers, null for other rows) and, for either
    family, ``start_text`` and ``end_text``. The ranges are made disjoint first, so an event stays one
    event, in a stream as well. Pieces are kept by the block of addresses they lie in, which makes the
    lookup an equi-join with the piece as a residual condition. No broadcast is forced: Spark broadcasts the
    range table only while its size allows, and splits hot blocks otherwise.
    """
    pieces = ip_ranges if "block" in ip_ranges.columns else disjoint_ranges(ip_ranges)
    digits = ip_to_hex(F.col(ip_col))
    looked = events.withColumn("_at", F.concat(digits, F.lit("0"))).withColumn("_block", _block(F.col("_at")))
    within = (F.col("_block") == F.col("block")) & (F.col("_at") >= F.col("from")) & (F.col("_at") < F.col("to"))
    joined = looked.join(pieces, within, "left")
    text = GEO_FIELDS[:4]
    return joined.withColumns({
        name: F.coalesce(F.col("place")[name], F.lit("")) if name in text else F.col("place")[name] for name in GEO_FIELDS
    }).drop("_at", "_block", "block", "from", "to", "place")


# Substring of the lower-cased user agent and what it means, tested in order (fixed values).
BROWSER_MARKS = [("edg", "Edge"), ("chrome", "Chrome"), ("firefox", "Firefox"), ("safari", "Safari")]
SYSTEM_MARKS = [
    ("android", "Android"), ("iphone", "iOS"), ("ipad", "iOS"), ("windows", "Windows"),
    ("mac", "macOS"), ("linux", "Linux"),
]


def _first_mark(agent: Column, marks: list[tuple[str, str]], otherwise: str) -> Column:
    result = F.when(agent == "", F.lit(""))
    for mark, name in marks:
        result = result.when(F.contains(agent, F.lit(mark)), F.lit(name))
    return result.otherwise(F.lit(otherwise))


def ua_enrich(events: DataFrame, agent: Column) -> DataFrame:
    """Browser and operating system of each event's own user agent."""
    lowered = F.lower(F.coalesce(agent, F.lit("")))
    return events.withColumn("browser", _first_mark(lowered, BROWSER_MARKS, "Other")).withColumn(
        "os_family", _first_mark(lowered, SYSTEM_MARKS, "")
    )


def correct_time(events: DataFrame, max_skew: str | int = "5 minutes") -> DataFrame:
    """Record the client offset; beyond ``max_skew`` the server time replaces the client's."""
    offset = F.col("server_ts") - F.col("event_ts")
    skewed = F.abs(F.col("client_offset_ms")) > seconds(max_skew) * 1000
    return events.withColumn("client_offset_ms", offset).withColumn(
        "event_ts", F.when(skewed, F.col("server_ts")).otherwise(F.col("event_ts"))
    )


# Spellings of each platform (fixed values).
PLATFORM_NAMES = {
    "android": ["android"],
    "ios": ["ios", "iphone", "ipad"],
    "web": ["web", "browser"],
    "react_native": ["react_native", "reactnative"],
    "flutter": ["flutter"],
    "server": ["server", "backend"],
}


def normalize_platform(platform: Column) -> Column:
    cleaned = F.lower(F.trim(F.coalesce(platform, F.lit(""))))
    result = F.when(F.lit(False), F.lit(""))
    for name, spellings in PLATFORM_NAMES.items():
        result = result.when(cleaned.isin(*spellings), F.lit(name))
    return result.otherwise(F.lit("unknown"))


def flatten_props(props: Column) -> Column:
    """Any JSON value as text: null is empty, numbers are plain decimals, nested values are JSON."""
    def text(_key: Column, value: Column) -> Column:
        plain = F.regexp_replace(
            F.try_variant_get(value, "$", "double").cast("decimal(38,12)").cast("string"),
            r"\.?0+$", "",
        )

        def plainly(as_text: Column) -> Column:
            # Only a number can need rewriting, and only when it prints with an exponent.
            scientific = F.contains(as_text, F.lit("E")) & (F.schema_of_variant(value) == "DOUBLE")
            return F.coalesce(F.when(scientific, plain), as_text, F.lit(""))

        return _named(F.try_variant_get(value, "$", "string"), plainly)

    return F.coalesce(
        F.transform_values(props, text), F.create_map().cast("map<string,string>")
    )


def limit_props(props: Column, max_keys: int, max_key: int, max_value: int) -> Column:
    """(props, dropped): at most ``max_keys`` keys in key order, cut keys and values, and how many keys went.

    Nothing calls this on its own: the ingest chain keeps all properties.
    """
    def limited(known: Column) -> Column:
        entries = F.transform(F.slice(F.sort_array(F.map_entries(known)), 1, max_keys), lambda e: F.struct(
            F.substring(e["key"], 1, max_key).alias("key"),
            F.substring(e["value"], 1, max_value).alias("value"),
        ))
        # Keys are sorted, so keys that become equal by cutting are neighbours: the first one stays.
        distinct = _named(entries, lambda cut: F.filter(cut, lambda e, i: (i == 0) | (F.get(cut, i - 1)["key"] != e["key"])))
        return _named(distinct, lambda kept: F.struct(
            F.when(known.isNotNull(), F.map_from_entries(kept)).alias("props"),
            F.when(known.isNotNull(), F.size(known) - F.size(kept)).cast("bigint").alias("dropped"),
        ))

    return _named(props, limited)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row.

    An expression that a lambda function mentions is computed again for each element; a variable of an outer lambda
    function is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def extract_attribution(events: DataFrame) -> DataFrame:
    """Install source, campaign and ad set out of the properties."""
    return events.withColumns({
        name: F.coalesce(F.col("props")[name], F.lit(""))
        for name in ("install_source", "campaign_id", "adset_id")
    })


def to_event_rows(events: DataFrame) -> DataFrame:
    """Enriched events as the 18-column fact row plus the partition date."""
    def text(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)

    event_time = F.timestamp_millis("event_ts")
    have = {
        "event_time": event_time.alias("event_time"),
        "server_time": F.timestamp_millis("server_ts").alias("server_time"),
        "platform": normalize_platform(F.col("app.platform")).alias("platform"),
        "app_version": F.coalesce(F.col("app.version"), F.lit("")).alias("app_version"),
        "session_id": F.lit("").alias("session_id"),
        "revenue": F.col("revenue"),
        "props": F.col("props"),
    }
    return events.select(
        *[have[c] if c in have else text(c) for c in EVENT_COLUMNS],
        F.to_date(event_time).alias("event_date"),
    )


def timed(events: DataFrame) -> DataFrame:
    """Validated events with ids and corrected times."""
    return correct_time(fill_defaults(events))


def first_received(events: DataFrame) -> DataFrame:
    """``timed`` events, each once, as ``dedup_events`` does for fact rows."""
    return dedup_events(events, [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in EVENT_KEY], ("server_ts", "event_ts"))


def located(events: DataFrame, ip_ranges: DataFrame) -> DataFrame:
    """``timed`` events to fact rows: address, location, user agent, properties."""
    known = geo_enrich(
        events.withColumn("client_ip", client_ip(F.col("x_forwarded_for"), F.col("remote_addr"))), ip_ranges)
    flat = ua_enrich(known, F.col("device.user_agent")).withColumn(
        "props", flatten_props(F.col("raw_props"))
    )
    return to_event_rows(extract_attribution(flat))


def enrich(events: DataFrame, ip_ranges: DataFrame) -> DataFrame:
    """Validated events to fact rows: time, address, location, user agent, properties."""
    return located(timed(events), ip_ranges)


def identify_events(identifies: DataFrame) -> DataFrame:
    """Identify calls as ``user_updated`` events whose properties are the traits, in the fact layout."""
    key = F.concat_ws("|", "app_id", "user_id", F.unix_millis("ts"), F.to_json("traits"))
    have = {
        "event_id": F.sha2(key, 256), "event_name": F.lit("user_updated"), "event_time": F.col("ts"),
        "server_time": F.col("ts"), "props": F.col("traits"), "revenue": F.lit(None).cast("double"),
    }
    return identifies.select(*[
        (have[c] if c in have else F.coalesce(F.col(c), F.lit("")) if c in identifies.columns else F.lit("")).alias(c)
        for c in EVENT_COLUMNS
    ])


def merge_profiles(traits: DataFrame) -> DataFrame:
    """Fold traits per user; for each key the latest write wins."""
    entries = traits.select("app_id", "user_id", "ts", F.explode("traits").alias("key", "value"))
    newest = F.max(F.struct("ts", "value"))["value"]
    per_key = entries.groupBy("app_id", "user_id", "key").agg(
        newest.alias("value"), F.min("ts").alias("_first"), F.max("ts").alias("_last")
    )
    return per_key.groupBy("app_id", "user_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("traits"),
        F.min("_first").alias("created_at"), F.max("_last").alias("updated_at"),
    )


def resolve_identity(events: DataFrame) -> DataFrame:
    """Latest known user of each device, with first and last seen."""
    known = F.when(not_blank("user_id"), F.struct("event_time", "event_id", "user_id"))
    return events.groupBy("app_id", "device_id").agg(
        F.coalesce(F.max(known)["user_id"], F.lit("")).alias("user_id"),
        F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"),
    )


def quota_usage(
    events: DataFrame, apps: DataFrame, interval: str | int = "1 second", time_col: str = "server_time"
) -> DataFrame:
    """Load of each app per interval against its rate and burst; without limits the last three are null."""
    length = seconds(interval)
    slots = events.groupBy("app_id", F.floor(F.unix_seconds(time_col) / length).alias("_slot")).agg(
        F.count("*").alias("_n")
    )
    limits = apps.select(F.col("id").alias("app_id"), "rps", "burst")
    per_app = slots.join(limits, "app_id", "left")
    allowed = F.col("rps") * length

    def over(limit: Column) -> Column:
        return F.sum(F.when(limit.isNotNull(), (F.col("_n") > limit).cast("bigint")))

    beyond = F.when(F.col("burst").isNotNull(), F.greatest(F.col("_n") - F.col("burst"), F.lit(0)))
    return per_app.groupBy("app_id").agg(
        F.sum("_n").alias("events"), F.count("*").alias("active_intervals"),
        F.max("_n").alias("peak_events"),
        over(allowed).alias("intervals_over_rate"),
        over(F.col("burst")).alias("intervals_over_burst"),
        F.sum(beyond).alias("events_over_burst"),
    )
