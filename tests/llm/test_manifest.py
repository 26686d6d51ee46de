import random
from hashlib import sha256

from pyspark.sql import functions as F

from clickspan.llm.manifest import folded, leaf_digest, manifest, ordered, siblings
from tests.llm import brute

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, at string, n string, path string"


def proved(spark, rows):
    """Sorted (grp, doc_id, leaf, subroot, root, proof, folded) by row."""
    docs = spark.createDataFrame([(*r, "clash", "x", "y") for r in rows], SCHEMA)
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("grp"), "doc_id",
        leaf_digest(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text"))).alias("leaf"))
    found = manifest(leaves).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(siblings("path"), 256).alias("proof"), folded("leaf", "path").alias("folded"))
    return sorted(tuple(r) for r in found.collect())


def rows_of(ids, source, text="t"):
    return [(i, source, "en", 1, f"{text}{i}") for i in ids]


def test_against_brute_force(spark):
    random.seed(2)
    rows = rows_of(random.sample(range(-5000, 5000), 700), "big") + rows_of(range(17), "seventeen") + rows_of([5], "one")
    rows += rows_of(range(16), "é") + rows_of(range(300), None) + rows_of(range(257), "") + rows_of([2**63 - 1, -2**63, 0, 1 << 40, -(1 << 50), 63, 64, 65], "wide")
    for s in range(40):
        rows += rows_of(random.sample(range(10**12), 3), f"small{s}")
    rows += [(None, None, None, None, None), (7, "nulls", None, None, None), (8, "nulls", "", 0, "")]
    assert proved(spark, rows) == brute.manifest(rows)


def test_ties_and_repeated_rows_are_leaves_each(spark):
    rows = rows_of(range(40), "a") + [(7, "a", "en", i, f"other{i}") for i in range(50)] + [(7, "a", "en", 1, "t7")] * 30
    rows += [(None, "a", "en", 1, f"none{i}") for i in range(30)] + [(None, "a", "en", 1, "none1")] * 20 + [(39, "a", "en", 1, "t39")] * 3
    assert proved(spark, rows) == brute.manifest(rows)


def test_long_text_and_single_leaf(spark):
    rows = [(1, "s", "en", 1, "é" * 300_000)]
    (row,) = proved(spark, rows)
    assert row[1] == row[2] == row[3] == row[5] == sha256(
        b"1:1" + b"1:s" + b"2:en" + b"1:1" + b"600000:" + ("é" * 300_000).encode()).hexdigest()


def test_empty_table(spark):
    assert proved(spark, []) == []


def test_tampered_leaf_leads_elsewhere(spark):
    leaves = spark.createDataFrame([("=a", i, sha256(b"%d" % i).hexdigest(), "f" * 64) for i in range(100)], "grp string, doc_id long, leaf string, other string")
    found = manifest(leaves).select((folded("leaf", "path") == F.col("root")).alias("own"), (folded("other", "path") == F.col("root")).alias("other"))
    assert {tuple(r) for r in found.collect()} == {(True, False)}


def test_groups_are_numbered_in_byte_order(spark):
    names = ["", "=", "=a", "=B", "=é", "=z", "=🙂", "=~"]
    groups, n = ordered(spark.createDataFrame([(g,) for g in names], "grp string"))
    assert n == len(names)
    assert [r["grp"] for r in groups.orderBy("at").collect()] == sorted(names, key=str.encode)
