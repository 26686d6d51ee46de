import random

import pytest
from pyspark.sql import functions as F

from clickspan.llm.quality import MEASURES, kept_documents, quality_verdicts
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, n_words string"


def verdicts(spark, rows):
    df = spark.createDataFrame([(i, t, s, "clash") for i, t, s in rows], SCHEMA)
    return {r["doc_id"]: r for r in quality_verdicts(df).collect()}


def test_measures_against_brute_force(spark):
    random.seed(1)
    vocabulary = ["a", "b", "the", "é", "##", "x|y", "\n", "  ", "\t", "longer", "🙂", "\x0b", " "]
    texts = [" ".join(random.choices(vocabulary, k=random.randint(0, 120))) for _ in range(200)]
    texts += [None, "", " \n ", "one", "one two", "a a a a", "x\nx\nx\n\ny", "w " * 20000, "a b c d " * 40]
    found = verdicts(spark, [(i, t, f"s{i % 5}") for i, t in enumerate(texts)])
    for i, text in enumerate(texts):
        assert tuple(found[i][c] for c in [*MEASURES, "base_failed"]) == brute.quality(text), repr(text)[:80]


def good(i):
    random.seed(i)
    return " ".join("".join(random.choices("abcdefgh", k=5)) for _ in range(60))


def test_host_habit_tips_documents(spark):
    noisy = lambda i: good(i) + " ###" * 10
    rows = [(i, noisy(i), "noisy") for i in range(50)] + [(100 + i, good(100 + i), "noisy") for i in range(50)]
    rows += [(200 + i, good(200 + i), "clean") for i in range(400)] + [(900, noisy(900), "clean")]
    found = verdicts(spark, rows)
    assert not any(found[i]["kept"] for i in range(50))
    assert all(found[i]["kept"] for i in range(100, 150))  # clean documents of a noisy host stay
    assert all(found[200 + i]["kept"] for i in range(400))
    assert found[900]["kept"]  # one slip of a clean host is no habit


def test_hopeless_host_loses_everything(spark):
    rows = [(i, "too short", "bad") for i in range(300)] + [(300, good(1), "bad")]
    rows += [(1000 + i, good(i), "fine") for i in range(300)] + [(2000, "short", None), (2001, good(7), None)]
    found = verdicts(spark, rows)
    assert not found[300]["kept"] and found[300]["host_rejected"]
    assert found[1000]["kept"] and found[2001]["kept"] and not found[2000]["kept"]


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_verdicts(empty).count() == 0
    assert kept_documents(empty).count() == 0
    rows = spark.createDataFrame([(1, good(1), "s", "x")] * 3 + [(None, good(2), None, None)], SCHEMA)
    kept = kept_documents(rows)
    assert kept.columns == rows.columns
    assert kept.count() == 4 and kept.filter(F.col("n_words") == "x").count() == 3


@pytest.mark.parametrize("column", ["text", "source"])
def test_all_null(spark, column):
    rows = spark.createDataFrame([(i, None if column == "text" else good(i), None if column == "source" else "s", None) for i in range(5)], SCHEMA)
    assert quality_verdicts(rows).filter("kept").count() == (0 if column == "text" else 5)
