"""Merkle dataset manifest by bitmap-rank indexing.

A leaf is the hash of a row; the leaves of a group ascend by doc_id, and every ``FAN`` consecutive nodes become
their hash until one is left, the group's root; the roots of the groups, ascending, make a tree likewise.

1. Ranks without sorting. The doc_ids of a group form a compressed bitmap: words of 64 ids, of which only those
   with a bit are there, combined map-side by bitwise or; a container holds the words of ``CONTAINER`` ids with
   their popcounts summed up, and directories of three levels hold the rows before a container. A row's place
   is directory + popcount of the words before + popcount of the bits below its own. No level has more
   than 2¹⁷ entries under one key, however the ids are spread, so no task orders a whole group.
2. Levels. Nodes are keyed by (group, place); a run is keyed by (group, place // FAN) and holds its nodes in the
   slots of an array, so a group with most of the rows is spread over its runs. Every level is written.
3. Proofs. From the roots down each node hands on its path: at each level the digests left and right of it.

Cases: a null group is the first one, a null doc_id stands before all others, its text is ``-`` in the hash as
every null is. Rows of one group and doc_id (or without) ascend by leaf; equal rows are a leaf each and get
one row each. An empty table gives no row. Other columns are ignored, clashing ones too. Very long texts are hashed
in one pass of their task.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickspan.llm.tables import table, written

FAN = 16
WORD = 6
#: Bits of an id inside a container, and inside the directories above it.
CONTAINER = 10
LEVELS = (CONTAINER, 26, 42, 58)
#: Equal rows that come apart at a time.
COPIES = 1 << 16
NO_ID = -(1 << 63) // (1 << WORD) - 1


def field(value: Column) -> Column:
    """One field of a leaf: byte count, colon, value; a hyphen for null."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256)


def running(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, inside ``keys``."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))


def ranks(rows: DataFrame) -> DataFrame:
    """Rank directory of ``rows`` (grp, word, bit, n), a container a row, with ``n``, the rows of its group.

    A container has the words that hold an id, in order, each with the rows before it in the container, and the
    ids that stand for more than one row with the rows they have beyond it.
    """
    words = rows.groupBy("grp", "word").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"),
        F.sum("n").alias("rows"),
        F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("more"))))).alias("more"))
    shift = LEVELS[0] - WORD
    slots = F.array_sort(F.collect_list(F.struct("word", "bits", "rows", "more")))
    containers = written(
        words.groupBy("grp", F.shiftright("word", shift).alias("at0")).agg(F.sum("rows").alias("rows"), slots.alias("words")), "containers")
    level, tops = containers.select("grp", "at0", "rows"), []
    for i in range(1, len(LEVELS)):
        up, own = f"at{i}", f"at{i - 1}"
        level = level.withColumn(up, F.shiftright(own, LEVELS[i] - LEVELS[i - 1]))
        tops.append(running(level, ["grp", up], own, "rows", f"before{i}").drop("rows"))
        level = level.groupBy("grp", up).agg(F.sum("rows").alias("rows"))
    top = running(level, ["grp"], f"at{len(LEVELS) - 1}", "rows", f"before{len(LEVELS)}")
    top = top.withColumn("n", F.sum("rows").over(Window.partitionBy("grp"))).drop("rows")
    for part in reversed(tops):
        top = part.join(top, ["grp", next(c for c in part.columns if c in top.columns and c != "grp")])
    before = sum((F.col(f"before{i}") for i in range(1, len(LEVELS) + 1)), F.lit(0))
    directory = top.select("grp", "at0", before.cast("long").alias("before"), "n")
    return written(containers.drop("rows").join(directory, ["grp", "at0"]), "directory")


def _rank(word: str, bit: str) -> Column:
    """Rows before an id in its container, from the words of the container."""
    lower = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col(bit)))
    below = lambda w: F.when(w["word"] < F.col(word), w["rows"]).when(
        w["word"] == F.col(word),
        F.bit_count(w["bits"].bitwiseAND(lower)).cast("long")
        + F.aggregate(w["more"], F.lit(0).cast("long"), lambda a, m: a + F.when(m["bit"] < F.col(bit), m["more"]).otherwise(0)),
    ).otherwise(F.lit(0).cast("long"))
    return F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + below(w))


def placed(leaves: DataFrame) -> tuple[DataFrame, int]:
    """``leaves`` (grp, doc_id, leaf, and more) with ``at``, the place inside the group, and ``n``, its rows; and the largest n.

    Equal rows are put together with their number first and come apart again at the end.
    """
    others = [c for c in leaves.columns if c not in ("grp", "doc_id", "leaf")]
    distinct = written(
        leaves.groupBy("grp", "doc_id", "leaf", *others).agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("word", F.coalesce(F.shiftright("doc_id", WORD), F.lit(NO_ID).cast("long")))
        .withColumn("bit", F.coalesce(F.col("doc_id").bitwiseAND((1 << WORD) - 1), F.lit(0)).cast("int"))
        .withColumn("part", F.substring("leaf", 1, 4)), "leaves")
    slot = ["grp", "word", "bit"]
    ids = written(distinct.groupBy(*slot).agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("leaves")), "ids")
    directory = ranks(ids.drop("leaves"))

    # Rows of one id with several leaves: by the beginning of the leaf, then inside it.
    tied = distinct.join(ids.filter("leaves > 1").select(*slot), slot)
    parts = tied.groupBy(*slot, "part").agg(F.sum("copies").alias("n"))
    parts = running(parts, slot, "part", "n", "_before").drop("n")
    ties = written(
        running(tied, [*slot, "part"], "leaf", "copies", "_inside").join(parts, [*slot, "part"])
        .select(*slot, "leaf", (F.col("_before") + F.col("_inside")).alias("tie")), "ties")

    first, last = F.col("_first"), F.col("_first") + F.col("copies") - 1
    found = (
        distinct.withColumn("at0", F.shiftright("word", LEVELS[0] - WORD))
        .join(ties, [*slot, "leaf"], "left").join(directory, ["grp", "at0"])
        .withColumn("_first", F.col("before") + _rank("word", "bit") + F.coalesce("tie", F.lit(0)))
        .withColumn("_from", F.explode(F.sequence(first, last, F.lit(COPIES).cast("long"))))
        .withColumn("at", F.explode(F.sequence("_from", F.least(F.col("_from") + COPIES - 1, last)))))
    return found.select("grp", "doc_id", "leaf", *others, "at", "n"), directory.agg(F.max("n")).first()[0] or 0


def reduced(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """Runs of each level over ``nodes`` (grp, at, n, digest, and more): grp, at, n, run. A group ends with its root.

    ``run`` holds the nodes in the order of their slots, of the lowest level with all columns given.
    """
    levels = []
    while not levels or most > 1:
        held = F.struct("at", *[c for c in nodes.columns if c not in ("grp", "at", "n")])
        own = nodes if not levels else nodes.filter("n > 1")
        levels.append(written(
            own.withColumn("_up", F.shiftright("at", FAN.bit_length() - 1)).groupBy("grp", "_up")
            .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(held)).alias("run"))
            .withColumnRenamed("_up", "at"), f"{name}-{len(levels)}"))
        most = -(-most // FAN)
        nodes = levels[-1].filter("n > 1").select(
            "grp", "at", F.ceil(F.col("n") / FAN).alias("n"), F.sha2(F.concat_ws("", "run.digest"), 256).alias("digest"))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(grp, digest): what remains of each group."""
    alone = levels[0].filter("n = 1").select("grp", F.col("run")[0]["digest"].alias("digest"))
    for level in levels:
        last = level.filter(F.col("n").between(2, FAN))
        alone = alone.unionByName(last.select("grp", F.sha2(F.concat_ws("", "run.digest"), 256).alias("digest")))
    return alone


def _step(run: Column, i: Column) -> Column:
    """What stands left and right of slot ``i``."""
    side = lambda part: F.array_join(F.transform(part, lambda x: x["digest"]), "")
    return F.struct(
        side(F.slice(run, F.lit(1), i)).alias("left"),
        side(F.slice(run, i + 2, F.greatest(F.size(run) - i - 1, F.lit(0)))).alias("right"))


def paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the lowest level of ``levels`` with ``path``: a step for each level, their own first.

    ``above`` has grp, the path of each group's root, and other columns to hand on.
    """
    more = [c for c in above.columns if c not in ("grp", "path")]
    known = None
    for level in reversed(levels):
        last = level.filter(F.col("n") <= FAN).join(above, "grp")
        inner = level.filter(F.col("n") > FAN)
        runs = last if known is None else last.unionByName(inner.join(known, ["grp", "at"]))
        lowest = level is levels[0]
        step = F.when(F.col("n") > 1, F.array(_step(F.col("run"), F.col("_i")))).otherwise(F.array().cast("array<struct<left: string, right: string>>"))
        nodes = runs.select("grp", "n", "run", "path", *more, F.posexplode("run").alias("_i", "_node")).select(
            "grp", F.concat(step, "path").alias("path"), *more, "_node.*")
        known = nodes if lowest else nodes.drop("digest")
    return known


def folded(leaf: Column | str, path: Column | str) -> Column:
    """The root that ``leaf`` leads to along ``path``."""
    start = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(path, start, lambda a, x: F.sha2(F.concat(x["left"], a, x["right"]), 256))


def siblings(path: Column | str) -> Column:
    """The digests along ``path``, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def ordered(groups: DataFrame) -> tuple[DataFrame, int]:
    """``groups`` (grp, ...) with ``at``, the place in the order of grp, and ``n``; and their number.

    Ranges of groups are counted one by one, so no task sees all of them.
    """
    ranged = written(
        groups.repartitionByRange("grp").sortWithinPartitions("grp")
        .withColumn("_range", F.spark_partition_id()), "groups")
    sizes = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())  # one row a partition
    total, starts = 0, []
    for part, size in sizes:
        starts.append((part, total))
        total += size
    offsets = groups.sparkSession.createDataFrame(starts, "_range int, _start long")
    number = F.row_number().over(Window.partitionBy("_range").orderBy("grp"))
    return (ranged.withColumn("_number", number).join(F.broadcast(offsets), "_range")
            .withColumn("at", F.col("_start") + F.col("_number") - 1).withColumn("n", F.lit(total).cast("long"))
            .drop("_range", "_number", "_start")), total


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves`` (grp, doc_id, leaf, and more) with subroot, root and path; grp must not be null.

    A path is an array of (left, right), one for each level from the leaf to the root: the digests of the other
    nodes of the run, joined.
    """
    rows, most = placed(leaves)
    if not most:
        empty = F.array().cast("array<struct<left: string, right: string>>")
        return leaves.select("*", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), empty.alias("path")).filter(F.lit(False))
    levels = reduced(rows.withColumnRenamed("leaf", "digest"), most, "runs")
    subroots, count = ordered(roots(levels))
    top = reduced(subroots.select(F.lit(0).alias("grp"), "at", "n", "digest", F.col("grp").alias("name")), count, "top")
    root = roots(top).first()["digest"]
    whole = top[0].sparkSession.createDataFrame([(0, root)], "grp int, root string").withColumn(
        "path", F.array().cast("array<struct<left: string, right: string>>"))
    above = written(
        paths(top, whole).select(F.col("name").alias("grp"), "path", "root", F.col("digest").alias("subroot")), "subroots")
    return paths(levels, above).drop("at").withColumnRenamed("digest", "leaf")


def op12_bitmap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("string")
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    picked = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    leaves = table(spark, sf_dir, "documents").select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("grp"), fields[0].alias("doc_id"),
        leaf_digest(*fields, text).alias("leaf"), F.when(picked, leaf_digest(*fields, lower)).alias("tampered"))
    proved = manifest(leaves).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), "path"))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings("path"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) AS t(i))),
texts AS (
  SELECT *, CASE WHEN xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295) % 5 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM documents, crc_table),
fields AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(other) || ':' || other, '-') AS other
  FROM texts),
leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS id, *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY grp) AS n
  FROM (SELECT doc_id, grp, sha256(head || body) AS leaf, sha256(head || other) AS tampered FROM fields)),
tree AS (
  SELECT 0 AS lvl, grp, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT lvl + 1, grp, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY lvl, grp, pos // 16, n),
subroots AS MATERIALIZED (
  SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, n, digest FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 16, n),
sides AS MATERIALIZED (
  SELECT lvl, grp, pos, coalesce(string_agg(digest, '') OVER before, '') AS l, coalesce(string_agg(digest, '') OVER after, '') AS r
  FROM (SELECT lvl, grp, pos, n, digest FROM tree UNION ALL SELECT 100 + lvl, '', pos, n, digest FROM top) WHERE n > 1
  WINDOW before AS (PARTITION BY lvl, grp, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (PARTITION BY lvl, grp, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
walk AS (
  SELECT id, grp, 0 AS lvl, pos, n, tampered AS digest, '' AS proof FROM leaves
  UNION ALL
  SELECT id, grp, lvl + 1, pos // 16, (n + 15) // 16, sha256(l || digest || r), proof || l || r
  FROM walk JOIN sides USING (lvl, grp, pos) WHERE n > 1),
climb AS (
  SELECT id, 100 AS lvl, s.pos, s.n, w.digest, proof FROM (SELECT * FROM walk WHERE n = 1) w JOIN subroots s USING (grp)
  UNION ALL
  SELECT id, lvl + 1, pos // 16, (n + 15) // 16, sha256(l || digest || r), proof || l || r
  FROM climb JOIN (SELECT * FROM sides WHERE lvl >= 100) USING (lvl, pos) WHERE n > 1)
SELECT doc_id, leaf, s.digest AS subroot, root, sha256(proof) AS proof_sha256, c.digest AS folded_root, c.digest = root AS verified
FROM leaves JOIN subroots s USING (grp) JOIN (SELECT id, digest, proof FROM climb WHERE n = 1) c USING (id),
  (SELECT digest AS root FROM top WHERE n = 1)
"""
