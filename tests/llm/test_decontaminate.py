import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickspan.llm import decontaminate
from clickspan.llm.decontaminate import BITMAP, contamination, hashed, pieces, winnow
from clickspan.llm.hashing import word_hashes
from tests.llm import brute

DOCS = "doc_id long, text string, row string, size string, windows string"
ITEMS = "item_id long, text string, h string, doc_id string"


def found(spark, texts, items, **parameters):
    docs = spark.createDataFrame([(i, t, "clash", "x", "y") for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(i, t, "clash", "x") for i, t in items], ITEMS)
    rows, sets = contamination(docs, bench, **parameters)
    return {r["doc_id"]: r for r in rows.join(sets, "items_set", "left").collect()}


@pytest.fixture(scope="module")
def tables():
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "é", "naïve", "日本", "A1"]
    items = [(i, random.choice([" ", ", ", "\n"]).join(random.choices(vocabulary, k=random.randint(0, 40)))) for i in range(40)]
    items += [(50, items[3][1]), (51, "One two, three"), (52, "solo"), (53, None), (54, "--- !"), (None, "no id here at all"), (51, "four five six seven eight nine")]
    items += [(60, " ".join(["same"] * 12)), (61, "a b c d e f g h i"), (62, "x " * 10)]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(random.randint(0, 5)):
            words += random.choices(vocabulary, k=random.randint(0, 30))
            other = (random.choice(items)[1] or "").split()
            begin = random.randint(0, max(0, len(other) - 8))
            words += other[begin:begin + random.randint(5, 30)]
        texts.append(random.choice([" ", "--", "\t"]).join(words))
    texts += [None, "", " .. ", "ONE! two? THREE", "solo solo", "same " * 30, "same " * 9, "x x x", "No id; here at all.", "é É é É"]
    texts += [texts[5], texts[5], "long " * 30_000 + (items[0][1] or "") + " end" * 5_000]
    return texts, items


def check(spark, texts, items, width, **parameters):
    got = found(spark, texts, items, width=width, **parameters)
    for i, (n, hit, named) in enumerate(brute.contamination(texts, items, width)):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items"] or []) == (n, hit, named), repr(texts[i])[:200]
        covered = {p for w in r["windows"] or [] for p in range(w["begin"], w["end"])}
        assert len(covered) == hit


@pytest.mark.parametrize("width, cells", [(10, 1 << 20), (10, BITMAP), (4, 1 << 20)])
def test_against_brute_force(spark, tables, width, cells):
    check(spark, *tables, width, cells=cells)


def test_long_texts_are_hashed_piece_by_piece(spark, tables, monkeypatch):
    text = "Ab, cd-é " * 50
    cut = pieces(text.encode(), 20)
    assert len(cut) > 5 and b"".join(cut).decode() == text
    assert all(p.decode()[0] in ",- " for p in cut[1:])
    assert len(pieces(b"x" * 100, 20)) == 1
    monkeypatch.setattr(decontaminate, "pieces", lambda t: pieces(t, 64))
    (_, words, begins), = hashed([text.encode()])
    assert words.tolist() == word_hashes([text.encode()], True, decontaminate._BETWEEN)[0].tolist()
    assert begins.tolist() == [0, len(words)]


def test_equal_windows_select_the_same_gram():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 60).astype(np.uint64)
    twice = np.concatenate([words, rng.integers(0, 2**63, 7).astype(np.uint64), words])
    for size in (1, 3, 5, 6, 9, 10, 20):
        places, values = winnow(twice, size)
        for i in range(60 - size + 1):
            assert places[i] - i == places[67 + i] - 67 - i and values[places[i]] == values[places[67 + i]]
        assert np.all(np.diff(places) >= 0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    rows, _ = contamination(docs, items.filter("false"))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in rows.collect()) == [("1", 3, 0), ("1", 3, 0), ("None", 3, 0)]
    rows, _ = contamination(docs, items)
    assert [(r["n_words"], r["n_hit"]) for r in rows.collect()] == [(3, 2)] * 3
    rows, sets = contamination(docs.filter("false"), items)
    assert rows.count() == sets.count() == 0


def test_documents_with_one_passage_share_a_set(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("d"), "id", F.lit(f" {passage} e"), "id").alias("text"))
    items = spark.range(40).select(F.col("id").alias("item_id"), F.concat(F.lit("i"), "id", F.lit(f" {passage}")).alias("text"))
    rows, sets = contamination(docs, items)
    assert rows.select("n_hit", "items_set").distinct().count() == 1
    assert [(r["n_items"], len(r["items"])) for r in sets.collect()] == [(40, 40)]


def test_parameters_are_checked(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError):
        contamination(docs, docs.withColumnRenamed("doc_id", "item_id"), cells=1000)
    with pytest.raises(ValueError):
        contamination(docs, docs.withColumnRenamed("doc_id", "item_id"), width=0)
