import random

import numpy as np
import pytest

from clickspan.llm.hashing import window_hashes, word_hashes
from clickspan.llm.substring import SLICE, anchors, without_repeats
from tests.llm import brute


def kept(spark, texts, **parameters):
    df = spark.createDataFrame([(i, t, "clash", "k") for i, t in enumerate(texts)], "doc_id long, text string, at string, key string")
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in without_repeats(df, **parameters).collect()}


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    passages = [[f"p{i}_{j}" for j in range(random.randint(30, 90))] for i in range(8)]
    out = []
    for d in range(120):
        words = []
        for _ in range(random.randint(0, 4)):
            words += [f"u{d}_{random.random()}" for _ in range(random.randint(0, 50))]
            words += random.choice(passages)[random.randint(0, 20):]
        out.append(random.choice([" ", "\n", "\t  "]).join(words))
    out += [None, "", " \n ", "same " * 40, "same " * 36, "ab " * 35, "é à " * 20, "É à " * 20, out[3], out[3]]
    out += [" ".join(f"long{i}" for i in range(30_000)), " ".join(f"long{i}" for i in range(500, 700))]
    return out


@pytest.mark.parametrize("width, cells", [(35, 1 << 20), (35, SLICE), (5, SLICE)])
def test_against_brute_force(spark, texts, width, cells):
    want = brute.substring(texts, width)
    got = kept(spark, texts, width=width, cells=cells)
    for i, text in enumerate(texts):
        assert got[i] == (len(brute.words(text)), len(brute.words(text)) - len(want[i]), " ".join(want[i]))


def test_equal_windows_have_equal_anchors_at_different_places():
    words, _ = word_hashes([b"a b c d e f g h i j k l m n o p q r s t a b c d e f g h i j k l m n o p q r s t"])
    places, values = anchors(words, 16)
    for i in range(5):
        assert values[places[i]] == values[places[20 + i]] and places[i] != places[20 + i]
    assert np.all(np.diff(places) >= 0)


def test_word_hashes_depend_on_the_word_alone():
    one, begins = word_hashes([b"x abc  d", b"", b"abc\nABC"])
    assert begins.tolist() == [0, 3, 3, 5]
    assert one[1] == one[3] != one[4]
    assert word_hashes([b"ABC"], lower=True)[0][0] == one[1]
    assert len(window_hashes(one, 9)) == 0


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, "x")], "doc_id long, text string")
    assert sorted((r["n_removed"] for r in without_repeats(df).collect())) == [0, 40, 40]
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cells_are_checked(spark):
    with pytest.raises(ValueError):
        without_repeats(spark.createDataFrame([(1, "x")], "doc_id long, text string"), cells=1000)
