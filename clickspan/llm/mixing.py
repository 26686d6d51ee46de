"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words. Each document of a source then has the same expected number
of copies, target / source size. The documents of a source are put in order of size, the expected copies
are summed up along that order, one random offset is added, and a document is emitted once per integer
that its stretch of the running sum crosses. Neighbours in the order have like sizes, so the words taken
follow the target closely.

The running sum is split up: rows are counted by (source, size, salt), the counts of the sizes are summed
along each source and those of the salts along each size, and rows are numbered only inside their chunk, so
a source or a size that holds a third of all rows is spread over ``salts`` chunks per size. Copies are
counted in integers of ``UNIT`` parts.

Cases: a null text has size 0; a null source is a source of its own, last in order; documents of a source
whose words are all missing are taken 0 times; equal rows are interchangeable; a null doc_id is ordered
first; an empty table gives no row. Columns of the input that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickspan.llm.tables import table

WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1_000_000_000
ADDED = ["size", "source_size", "target", "copies"]


def text_size(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _number(text: Column) -> Column:
    """32 bits of a digest as a number: the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], ratio: float, cap: float) -> DataFrame:
    """Targets per source by water filling.

    ``sizes`` has one row per source (``_null``, ``_source``, ``source_size``). Sources by code point, null
    last, take ``weights`` in turn. With caps in ascending order of cap per weight, the level after the
    first i caps is (total - those caps) / (weights left); the first level below its own cap is the level
    at which no source is above its cap any more.
    """
    by_name = W.orderBy("_null", "_source")
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    by_cap = W.orderBy("_ratio", "_null", "_source")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    levels = (
        sizes
        .withColumn("_weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn.cast("int")))
        .withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.lit(float(ratio)) * F.sum("source_size").over(everything))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                    / F.sum("_weight").over(onward))
        .withColumn("_open", F.when(F.col("_level") < F.col("_ratio"),
                                    F.struct("_ratio", "_null", "_source", "_level")))
        .withColumn("_final", F.min("_open").over(everything).getField("_level"))
    )
    return levels.select(
        "_null", "_source", "source_size",
        F.coalesce(F.least(F.col("_cap"), F.col("_final") * F.col("_weight")), F.col("_cap")).alias("target"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), ratio: float = 1.5, cap: float = 2.0,
        seed: str = "mix", salts: int = 32) -> DataFrame:
    """``docs`` (doc_id, text, source and any more) with ``size``, ``source_size``, ``target``, ``copies``.

    ``copies`` is how often the mix takes the document; it is at most ``cap`` rounded up.
    """
    if len(weights) == 0 or min(weights) <= 0 or ratio < 0 or cap < 0 or salts < 1:
        raise ValueError("weights and salts must be positive, ratio and cap not negative")
    chunk = ["_null", "_source", "size", "_salt"]
    rows = (
        docs.drop(*ADDED)
        .withColumn("size", text_size(F.col("text")))
        .withColumn("_null", F.col("source").isNull())
        .withColumn("_source", F.coalesce("source", F.lit("")))
        .withColumn("_salt", F.pmod(_number(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(salts)))
    )
    counts = rows.groupBy(*chunk).agg(F.count(F.lit(1)).alias("_n"))
    sizes = rows.groupBy("_null", "_source").agg(F.sum("size").alias("source_size"))
    parts = F.coalesce(F.round(F.col("target") / F.col("source_size") * UNIT), F.lit(0.0)).cast("long")
    offset = _number(F.concat(F.lit(seed + "|"), F.col("_null").cast("string"), F.lit("|"), F.col("_source"))) % UNIT
    # What comes before a chunk: all smaller sizes of the source, and smaller salts of the same size.
    shorter = W.partitionBy("_null", "_source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    salted = W.partitionBy("_null", "_source", "size").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    by_size = counts.groupBy("_null", "_source", "size").agg(F.sum("_n").alias("_m")).select(
        "_null", "_source", "size", F.coalesce(F.sum("_m").over(shorter), F.lit(0)).alias("_shorter"))
    placed = counts.withColumn("_same", F.coalesce(F.sum("_n").over(salted), F.lit(0))).join(by_size, ["_null", "_source", "size"])
    carries = (
        placed.join(source_targets(sizes, weights, ratio, cap), ["_null", "_source"])
        .withColumn("_parts", F.when(F.col("source_size") > 0, parts).otherwise(F.lit(0)))
        .withColumn("_before", F.col("_shorter") + F.col("_same"))
        # What lies before the chunk matters only modulo one copy, which keeps the product in 64 bits.
        .withColumn("_carry", (offset + (F.col("_before") % UNIT) * (F.col("_parts") % UNIT) % UNIT) % UNIT)
        .select(*chunk, "source_size", "target", "_parts", "_carry")
    )
    place = F.row_number().over(W.partitionBy(*chunk).orderBy("doc_id")).cast("long")
    return (
        rows.join(carries, chunk)
        .withColumn("_place", place)
        .withColumn("copies", F.expr(f"(_carry + _place * _parts) div {UNIT} - (_carry + (_place - 1) * _parts) div {UNIT}"))
        .select(*[c for c in docs.columns if c not in ADDED], *ADDED)
    )


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: one row of ``docs`` per copy taken, with the columns of ``docs``."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source")
    taken = mix(rows, **parameters).filter(F.col("copies") > 0)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
    )


OP10_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS n, coalesce(source, '') AS s,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 32 AS salt
  FROM documents),
sources AS (
  SELECT n, s, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY n, s) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY n, s),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio,
         1.5::DOUBLE * sum(source_size) OVER () AS total FROM sources),
filled AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, n, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, n, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM levels),
final AS (
  SELECT n, s, source_size,
         coalesce(least(cap, (SELECT arg_min(level, ratio) FROM filled WHERE level < ratio) * weight), cap) AS target
  FROM filled),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target / source_size * {UNIT})::BIGINT ELSE 0 END AS e,
         ('0x' || substr(md5('mix|' || n::VARCHAR || '|' || s), 1, 8))::BIGINT % {UNIT} AS u
  FROM final),
placed AS (
  SELECT doc_id, size, source_size, target, e, u,
         row_number() OVER (PARTITION BY n, s ORDER BY size, salt, doc_id NULLS FIRST)::HUGEINT AS k
  FROM sized JOIN parts USING (n, s))
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (((u + k * e) // {UNIT} - (u + (k - 1) * e) // {UNIT}) * size)::BIGINT AS taken
FROM placed
"""
