"""Personal data by bootstrapped contextual extraction.

Base entities (e-mail and IP addresses, card and phone numbers) are found by expression and check. They are
the seeds of a graph between lexical patterns, the two words before an occurrence, and instances, the text
of an occurrence. Instances that look like identifiers (at least five digits in a run, or in groups of digits
with single blanks between) but are no base entity are unseen; groups that overlap a base entity are taken run
by run. In each round

* a pattern's confidence for a kind is the summed score of the instances it stands before, by occurrence,
  over all occurrences of the two words before any word of the corpus, and
* an unseen instance's score is 1 - product of (1 - confidence) over the accepted patterns before it,

where a pattern is accepted with ``support`` known instances and the confidence ``least``. So instances that
patterns discover support new patterns, also ones that stand before no base entity. Scores only rise; rounds
end when no pattern is newly accepted and all confidences together rise by less than ``SETTLED``. What stands after an accepted pattern, and every occurrence of an
instance that scores ``sure``, is added to the spans. Words that often stand before anything else never
become patterns, because all their occurrences count.

Everything is done with DataFrame functions. Positions come from what lies between matches: the lengths of
pieces and matches are summed up in blocks of 64, so a text with very many matches stays cheap.

Cases: a null or empty text has no span; a null doc_id is kept; rows equal in doc_id and text have equal
spans; spans of different kinds may overlap; an empty table gives no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickspan.llm.tables import table, written

SPACE = r"[\x20\x09-\x0D]+"
KINDS = ["email", "ip", "card", "phone"]
#: The base expressions, written so that no start is tried twice: a start inside a run of the first class is
#: taken only where the last match ended, and what needs no way back is possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A whole run of digits with single separators is one match; only runs of 13 to 19 digits can be cards.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must occur in a text for a kind to be looked for.
SIGNS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A run without blanks that holds five digits.
RUN = r"(?<![A-Za-z0-9._%+@()-])(?=(?:[A-Za-z._%+@()-]*[0-9]){5})[A-Za-z0-9._%+@()-]*[A-Za-z0-9]"
#: A blank between a digit (and a bracket) and a group of digits without letters.
GAP = r"(?<=[0-9]\)?)\x20(?=\(?[0-9][0-9().-]*+(?![A-Za-z_%+@]|[:/][0-9]))"
#: Groups of digits with single blanks, five digits in all; else a run.
UNSEEN = (
    rf"(?<![A-Za-z0-9._%+@()-])(?=\+?+(?:[().-]*+[0-9](?:\)?+{GAP})?+){{5}})\+?+(?:[0-9().-]++{GAP})++[0-9().-]*[0-9]"
    rf"|{RUN}")
#: Code points before an occurrence that are enough for its two words, where two whole words stand there; else
#: they are looked for in all that stands before.
REACH = 120
TWO_WORDS = rf"{SPACE}[^\x20\x09-\x0D]+{SPACE}[^\x20\x09-\x0D]+[\x20\x09-\x0D]*\z"
SETTLED = 1e-6


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the check sum."""
    back = F.split(F.reverse(digits), "")
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    worth = F.transform(F.filter(back, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, b: a + b)


def _with_matches(rows: DataFrame, name: str, pattern: str, sign: str) -> DataFrame:
    """``rows`` with the column ``name``: array of (start, end, found, before) of all matches in ``text``."""
    none = F.array().cast("array<string>")
    look = F.contains(F.col("text"), F.lit(sign)) if sign else F.lit(True)
    rows = rows.withColumn("_found", F.when(look, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size("_found") > 0
    rows = rows.withColumn("_between", F.when(some, F.split("text", pattern, -1)).otherwise(none))
    # Length of the piece before each match and of the match: their running sum gives the ends.
    rows = rows.withColumn("_lengths", F.transform("_found", lambda m, i: (F.length(F.get("_between", i)) + F.length(m)).cast("long")))
    blocks = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("_lengths") / 64).cast("int") - 1, F.lit(0))), lambda b: some),
        lambda b: _sum(F.slice("_lengths", b * 64 + 1, 64)))
    rows = rows.withColumn("_blocks", blocks)
    begins = F.transform("_blocks", lambda x, b: _sum(F.slice("_blocks", 1, b)))
    ends = F.flatten(F.transform(begins, lambda s, b: F.transform(
        F.slice("_lengths", b * 64 + 1, 64), lambda x, i: s + _sum(F.slice("_lengths", b * 64 + 1, i + 1)))))
    rows = rows.withColumn("_ends", ends)
    spans = F.transform("_ends", lambda end, i: F.struct(
        (end - F.length(F.get("_found", i))).alias("start"), end.alias("end"), F.get("_found", i).alias("found"),
        # What stands before; a match just before it counts as a word.
        F.concat(F.when(i > 0, F.lit("# ")).otherwise(F.lit("")), _before(F.get("_between", i))).alias("before")))
    return rows.withColumn(name, spans).drop("_found", "_between", "_lengths", "_blocks", "_ends")


def _before(between: Column) -> Column:
    """The end of a text that holds its last two words whole."""
    tail = F.substring(between, -REACH, REACH)
    return F.when((F.length(between) <= REACH) | tail.rlike(TWO_WORDS), tail).otherwise(between)


def _checked(kind: str) -> Column:
    return F.filter(kind, lambda s: _holds(kind, s["found"]))


def _tagged(column: str, kind: Column) -> Column:
    return F.transform(column, lambda s: F.struct(
        kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), s["before"].alias("before")))


def _count(column: str, kind: str) -> Column:
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")


def spans_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, kind, start, end, found, words, w1, w2) of every base entity, and with null kind of candidates.

    ``words`` are those of the text before, w1 and w2 the last two.

    ``docs`` has ``key`` and the text; rows with equal keys are one row here.
    """
    rows = docs.select("key", F.coalesce(F.col(text), F.lit("")).alias("text"))
    for kind in KINDS:
        rows = _with_matches(rows, kind, PATTERNS[kind], SIGNS[kind])
        rows = rows.withColumn(kind, _checked(kind))
    rows = _with_matches(rows, "unseen", UNSEEN, "")
    tagged = [_tagged(kind, F.lit(kind)) for kind in KINDS] + [_tagged("unseen", F.lit(None).cast("string"))]
    return (
        _words(rows.select("key", F.explode(F.concat(*tagged)).alias("s")).select("key", "s.*"))
        .select("key", "kind", "start", "end", "found", "words", "w1", "w2").distinct()
    )


def _words(spans: DataFrame) -> DataFrame:
    """``spans`` with words, w1 and w2 instead of the text ``before``."""
    return (
        spans.withColumn("words", F.array_remove(F.split(F.lower("before"), SPACE, -1), ""))
        .withColumn("w1", F.coalesce(F.try_element_at("words", F.lit(-2)), F.lit("")))
        .withColumn("w2", F.coalesce(F.try_element_at("words", F.lit(-1)), F.lit(""))).drop("before")
    )


def _marked(spans: DataFrame) -> DataFrame:
    """``spans`` with ``_free``: whether a candidate overlaps no base entity."""
    order = W.partitionBy("key").orderBy("start", "end")
    base_end = F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    base_start = F.min(F.when(F.col("kind").isNotNull(), F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
    free = (F.coalesce(base_end, F.col("start")) <= F.col("start")) & (F.coalesce(base_start, F.col("end")) >= F.col("end"))
    return spans.withColumn("_free", free)


def _apart(spans: DataFrame) -> DataFrame:
    """Candidates that overlap no base entity, next to the base entities.

    Of groups of digits that overlap one, the runs that overlap none are candidates.
    """
    names = ["key", "kind", "start", "end", "found", "w1", "w2"]
    marked = written(_marked(spans.select(*names)), "marked")
    groups = marked.filter("kind is null and not _free and contains(found, ' ')").select(
        "key", F.col("start").alias("_at"), F.col("w1").alias("_w1"), F.col("w2").alias("_w2"), F.col("found").alias("text"))
    runs = _words(_with_matches(groups, "runs", RUN, "").select("key", "_at", "_w1", "_w2", F.explode("runs").alias("s")).select(
        "key", "_at", "_w1", "_w2", F.lit(None).cast("string").alias("kind"), (F.col("_at") + F.col("s.start")).alias("start"),
        (F.col("_at") + F.col("s.end")).alias("end"), "s.found", "s.before"))
    # Words before the groups follow where the groups give fewer than two.
    runs = runs.withColumn("w1", F.when(F.size("words") == 0, F.col("_w1")).when(
        F.size("words") == 1, F.when(F.col("w2") == "#", F.lit("")).otherwise(F.col("_w2"))).otherwise(F.col("w1")))
    runs = runs.withColumn("w2", F.when(F.size("words") == 0, F.col("_w2")).otherwise(F.col("w2")))
    base = marked.filter("kind is not null").select(*names)
    runs = _marked(base.join(runs.select("key").distinct(), "key", "left_semi").unionByName(runs.select(*names))).filter("kind is null and _free")
    return base.unionByName(marked.filter("kind is null and _free").select(*names)).unionByName(runs.select(*names))


def _possible(edges: DataFrame, spans: DataFrame, least: float) -> DataFrame:
    """The patterns that can reach the confidence ``least``.

    How often the two words stand in the texts before candidates is a lower bound of how often they stand
    in the corpus, and cheap to count: the texts before candidates don't overlap, and their first two words,
    of which one may be cut, are left out. A pattern whose candidates are too few for that bound is too
    common to be confirmed by the whole corpus.
    """
    inner = F.slice("words", 3, F.size("words"))
    pairs = spans.filter("kind is null and size(words) > 3").select(inner.alias("_w")).select(F.explode(F.filter(
        F.transform("_w", lambda w, i: F.struct(F.get("_w", i - 1).alias("w1"), w.alias("w2"))), lambda p: p["w1"].isNotNull())).alias("p"))
    uses = edges.groupBy("w1", "w2").agg(F.sum("n").alias("_n"))
    bound = pairs.select("p.*").join(uses.select("w1", "w2"), ["w1", "w2"], "left_semi").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("_t"))
    return uses.join(bound, ["w1", "w2"], "left").filter(F.col("_n") >= least * F.coalesce("_t", F.lit(0))).select("w1", "w2")


def _reached(edges: DataFrame, support: int) -> DataFrame:
    """The edges of patterns that can be accepted, whatever their confidence.

    Such a pattern stands before ``support`` instances that are base entities or stand after such patterns.
    """
    pattern = ["w1", "w2"]
    known = edges.filter("base is not null").select("found").distinct()
    before = 0
    while True:
        patterns = written(edges.join(known, "found", "left_semi").groupBy(*pattern).agg(F.count(F.lit(1)).alias("_i")).filter(
            f"_i >= {support}").select(*pattern), "patterns")
        now = patterns.count()
        reached = edges.join(patterns, pattern, "left_semi")
        if now == before:
            return reached
        before = now
        known = written(known.unionByName(reached.select("found")).distinct(), "known")


def discovered(docs: DataFrame, every: DataFrame, support: int = 3, least: float = 0.5, sure: float = 0.8) -> DataFrame:
    """(key, kind, start, end) of the unseen identifiers; ``docs`` has key and text, ``every`` is ``spans_of`` it."""
    pattern = ["w1", "w2"]
    spans = written(_apart(every), "spans")
    edges = spans.groupBy(*pattern, "found").agg(F.max("kind").alias("base"), F.count(F.lit(1)).alias("n"))
    enough = edges.groupBy(*pattern).agg(F.count(F.lit(1)).alias("_i")).filter(f"_i >= {support}").select(*pattern)
    # Two words are needed: the start of a text or another match is no lexical pattern.
    enough = enough.filter("w1 not in ('', '#') and w2 not in ('', '#')")
    edges = written(edges.join(enough, pattern, "left_semi"), "edges")
    edges = written(edges.join(_possible(edges, every, least), pattern, "left_semi"), "edges")
    edges = written(_reached(edges, support), "edges")
    words = F.array_remove(F.split(F.lower("text"), SPACE, -1), "")
    pairs = docs.select("key", words.alias("_w")).select("key", F.explode(F.transform("_w", lambda w, i: F.struct(
        F.coalesce(F.when(i > 1, F.get("_w", i - 2)), F.lit("")).alias("w1"),
        F.coalesce(F.when(i > 0, F.get("_w", i - 1)), F.lit("")).alias("w2")))).alias("p")).select("key", "p.*")
    # Rows with equal keys count once, as in the spans; counts are divided, so no text is shuffled for it.
    repeats = written(docs.groupBy("key").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1"), "repeats")
    uses = pairs.join(edges.select(*pattern).distinct(), pattern).groupBy("key", *pattern).agg(F.count(F.lit(1)).alias("_u"))
    totals = written(uses.join(repeats, "key", "left").groupBy(*pattern).agg(
        F.sum(F.expr("_u div coalesce(_m, 1)")).alias("total")), "totals")
    known = edges.filter("base is not null").select("found", F.col("base").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    scores, before = known, (0, 0.0)
    while True:
        accepted = written(
            edges.join(scores, "found").groupBy(*pattern, "kind")
            .agg(F.sum(F.col("score") * F.col("n")).alias("_s"),
                 F.count(F.when(F.col("score") >= least, F.col("found"))).alias("_i"), F.sum("n").alias("_n"))
            .join(totals, pattern, "left")
            .withColumn("conf", F.least(F.lit(1.0), F.col("_s") / F.greatest(F.coalesce("total", "_n"), "_n")))
            .filter((F.col("conf") >= least) & (F.col("_i") >= support)).select(*pattern, "kind", "conf"), "accepted")
        guessed = (
            edges.filter("base is null").join(accepted, pattern).groupBy("found", "kind")
            .agg((1 - F.product(1 - F.col("conf"))).alias("score"))
        )
        scores = written(known.unionByName(guessed), "scores")
        now = accepted.agg(F.count(F.lit(1)), F.coalesce(F.sum("conf"), F.lit(0.0))).first()
        if now[0] == before[0] and now[1] - before[1] < SETTLED:
            break
        before = now
    unseen = spans.filter("kind is null").drop("kind")
    best = accepted.groupBy(*pattern).agg(F.max_by("kind", F.struct("conf", "kind")).alias("kind"))
    certain = scores.join(known.select("found"), "found", "left_anti").groupBy("found").agg(
        F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score")).filter(F.col("score") >= sure)
    by_pattern = unseen.join(best, pattern).select("key", "start", "end", "kind", F.lit(0).alias("_by"))
    by_instance = unseen.join(certain.select("found", "kind"), "found").select("key", "start", "end", "kind", F.lit(1).alias("_by"))
    return by_pattern.unionByName(by_instance).groupBy("key", "start", "end").agg(
        F.min_by("kind", F.struct("_by", "kind")).alias("kind"))


def personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any more) with ``base`` and ``added``: arrays of (place, start, end, kind).

    ``place`` is the kind's place in ``KINDS``; arrays are in order of place, start and end.
    """
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    spans = written(spans_of(keyed), "spans")
    base = spans.filter("kind is not null").select("key", "start", "end", "kind", F.lit(True).alias("_base"))
    more = discovered(keyed.select("key", "text"), spans).withColumn("_base", F.lit(False))
    place = reduce(lambda other, k: F.when(F.col("kind") == KINDS[k], k).otherwise(other), range(len(KINDS)), F.lit(len(KINDS)))
    item = F.struct(place.alias("place"), "start", "end", "kind")
    grouped = base.unionByName(more).groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(F.col("_base"), item))).alias("base"),
        F.array_sort(F.collect_list(F.when(~F.col("_base"), item))).alias("added"))
    empty = F.array().cast("array<struct<place:int,start:bigint,end:bigint,kind:string>>")
    return (
        keyed.drop("base", "added").join(grouped, "key", "left").drop("key")
        .withColumns({c: F.coalesce(F.col(c), empty) for c in ("base", "added")})
    )


def _shown(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and ``n_chars`` where there is one.

    Overlapping spans are replaced once, by the kind that begins first.
    """
    found = personal_data(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text"))
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = found.withColumn("_s", spans)
    # How far the spans before reach; a span that begins earlier is only cut to what it adds. Spans go by blocks of
    # 64: each has the furthest end before it and its stretch of the text, so no span looks at all others.
    nothing = F.lit(0).cast("long")
    end_of = lambda part: F.coalesce(F.array_max(F.transform(part, lambda s: s["end"])), nothing)
    numbers = F.filter(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("_s") / 64).cast("int") - 1, F.lit(0))), lambda b: F.size("_s") > 0)
    found = found.withColumn("_ends", F.transform(numbers, lambda b: end_of(F.slice("_s", b * 64 + 1, 64))))
    found = found.withColumn("_reach", F.transform("_ends", lambda e, b: F.coalesce(F.array_max(F.slice("_ends", 1, b)), nothing)))
    found = found.withColumn("_b", F.transform("_reach", lambda r, b: F.struct(
        r.alias("from"), F.slice("_s", b * 64 + 1, 64).alias("s"),
        F.substring("text", r.cast("int") + 1, F.greatest(end_of(F.slice("_s", b * 64 + 1, 64)) - r, nothing).cast("int")).alias("text"))))

    def put(block: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            reach = F.greatest(block["from"], end_of(F.slice(block["s"], F.lit(1), i)))
            between = F.substring(block["text"], (reach - block["from"] + 1).cast("int"), (s["start"] - reach).cast("int"))
            return F.when(s["start"] >= reach, F.concat(between, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.array_join(F.transform(block["s"], piece), "")

    last = F.coalesce(F.array_max("_ends"), nothing)
    text = F.when(F.size("_s") > 0, F.concat(F.array_join(F.transform("_b", put), ""), F.substring(
        "text", last.cast("int") + 1, F.length("text")))).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(F.size("_s") > 0, F.length(text).cast("long")).otherwise(
        F.col("_row")["n_chars"])} if "n_chars" in docs.columns else {"text": text}
    return found.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])


def op6_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    counts = [_count("base", kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_shown(F.col("base")), 256).alias("base_sha256"),
        _shown(F.array_sort(F.concat("base", "added"))).alias("spans"))
