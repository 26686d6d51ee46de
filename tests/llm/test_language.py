import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickspan.llm.language import _votes, features, identify, margins
from clickspan.llm.queries import QUERIES

WORDS = {
    "en": "the of and with this that from there where thing only when another house water".split(),
    "de": "der die und nicht über schön auch wird haus wasser können zeit möglich straße".split(),
    "fr": "le la être avec où château même eau maison très après depuis français".split(),
    "es": "el los años con niño mañana agua también después ciudad está señor".split(),
    "xx": "qo zup wixi qozu pwix zuqo".split(),
}


def docs(spark, languages, each=60):
    random.seed(8)
    rows = []
    for lang in languages:
        for _ in range(each):
            rows.append((len(rows), " ".join(random.choices(WORDS[lang], k=random.randint(1, 80))), lang, "clash"))
    rows += [(1000, None, "en", ""), (1001, "12 34 !!", "en", ""), (1002, "", "fr", ""), (1003, "Der schöne WASSER und die Straße", None, ""),
             (None, "the house of the water", None, ""), (1004, "the water " * 30_000, None, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_family_then_language(spark):
    rows = docs(spark, list(WORDS))
    held_out = F.coalesce(F.col("doc_id") % 4 == 2, F.lit(False))
    found = identify(rows, ~held_out, ["doc_id"])
    assert found.columns == ["doc_id", "lang_pred", "score"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found.collect()}
    truth = {r["doc_id"]: r["lang"] for r in rows.collect()}
    tested = [d for d in range(300) if d % 4 == 2]
    assert np.mean([got[d][0] == truth[d] for d in tested]) > 0.97
    assert [got[d] for d in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003][0] == "de" and got[None][0] == "en" and got[1004][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(rows.repartition(5), ~held_out, ["doc_id"]).collect()}
    assert {d: v[0] for d, v in again.items()} == {d: v[0] for d, v in got.items()}
    assert all(abs(again[d][1] - got[d][1]) < 1e-6 for d in got)


def test_one_language_and_none(spark):
    one = {r["doc_id"]: tuple(r)[1:] for r in identify(docs(spark, ["en"]), F.lit(True) & (F.col("lang") == "en"), ["doc_id"]).collect()}
    assert one[3] == ("en", 1.0) and one[1000] == ("und", 0.0)
    none = identify(docs(spark, ["en"]), F.lit(False), ["doc_id"])
    assert {tuple(r)[1:] for r in none.collect()} == {("und", 0.0)}
    empty = docs(spark, ["en"]).limit(0)
    assert identify(empty, F.lit(True), ["doc_id"]).count() == 0


def test_rows_without_ids_are_learnt_from(spark):
    rows = docs(spark, list(WORDS)).filter("doc_id < 300").withColumn("doc_id", F.lit(None).cast("long"))
    found = identify(rows.unionByName(rows.limit(1)), F.lit(True), ["doc_id", "lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97


def test_texts_do_not_touch_each_other():
    weights = np.random.Generator(np.random.PCG64(1)).normal(size=(1 << 14, 3))
    texts = [b"abc def", b"", b"x", "é ü ñ".encode(), b"  --  ", b"abc def"]
    together = margins(texts, weights)
    for text, row in zip(texts, together):
        assert np.allclose(margins([text], weights)[0], row)
    assert [len(i) > 0 for i, _ in features(texts)] == [True, False, True, True, False, True]


def test_votes():
    assert _votes(["a"], {}) == ("a", np.inf)
    assert _votes(["a", "b", "c"], {("a", "b"): 1.0, ("a", "c"): -2.0, ("b", "c"): 1.0})[0] == "c"
    assert _votes(["a", "b"], {("a", "b"): -0.5}) == ("b", 0.5)


@pytest.mark.parametrize("least", [0.95])
def test_held_out_accuracy(spark, least):
    sf_dir = "/root/testdata/sf0.01"
    found = QUERIES["op1_family_svm"](spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= least
