import random

import numpy as np
import pytest

from clickspan.llm import neardup
from clickspan.llm.graph import components
from clickspan.llm.neardup import band_keys, estimates, near_duplicates, one_of_each, registers, shingle_sets
from tests.llm import brute


def near(spark, rows):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_shingles string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()}


def edited(base, edits, seed):
    random.seed(seed)
    words = list(base)
    for _ in range(edits):
        words[random.randrange(len(words))] = f"new{seed}x{random.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def family():
    """Near copies around the threshold of several bases, chains, short texts and odd ones."""
    random.seed(9)
    texts = []
    for b in range(6):
        base = [f"w{b}_{random.randrange(10**6)}" for _ in range(random.choice([30, 120, 400]))]
        texts += [edited(base, k % 7, 100 * b + k) for k in range(25)]
        chain = list(base)
        for k in range(12):
            chain[(7 * k) % len(chain)] = f"c{b}_{k}"
            texts.append(" ".join(chain))
    texts += ["a b c", "A b\tC", "a b c d", "one", "One", None, "", " \n", "x " * 5000, "x " * 300, "é É a b c d e", "É é a b c d e"]
    texts += [" ".join(f"s{i}" for i in range(k)) for k in range(4, 16)]
    random.shuffle(texts)
    return list(enumerate(texts, start=3))


def test_against_brute_force(spark, family):
    want = brute.near(dict(family))
    got = near(spark, family)
    assert got == {d: (n, c, d == c) for d, (n, c) in want.items()}


def test_small_chunks_lose_nothing(spark, family, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 4)
    want = brute.near(dict(family))
    assert {d: v[1] for d, v in near(spark, family).items()} == {d: c for d, (_, c) in want.items()}


def test_repeated_rows_and_missing_ids(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (9, "z"), (9, "z")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    found = sorted((tuple(r) for r in near_duplicates(df).collect()), key=repr)
    assert found == sorted([(5, 2, 2, False)] * 2 + [(2, 2, 2, True), (None, 2, 2, False)] + [(9, 1, 9, True)] * 2, key=repr)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [2, 9]


def test_groups_without_ids_and_ids_with_several_texts(spark):
    base = [f"w{i}" for i in range(200)]
    one, two, other = " ".join(base), " ".join([*base[:-1], "new"]), " ".join(f"o{i}" for i in range(50))
    rows = [(None, one), (None, one), (None, two), (None, None), (None, None), (None, "q"), (4, other), (4, "k l m"), (3, "k l m"), (8, " ")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, hash string")
    found = [tuple(r) for r in near_duplicates(df).collect()]
    assert len(found) == len(rows)
    assert sorted(r for r in found if r[0] is not None) == [(3, 1, 3, True), (4, 1, 3, False), (4, 46, 4, True), (8, 0, 8, True)]
    assert sorted(r[1:] for r in found if r[0] is None)[:3] == [(0, None, True)] * 2 + [(1, None, True)]
    # Of the group of three rows without ids those of one text are kept; of them one stays.
    assert len({r[3] for r in found if r[0] is None and r[1] == 196}) == 2
    kept = sorted(((r["doc_id"], r["text"]) for r in one_of_each(df).collect()), key=repr)
    assert one_of_each(df).columns == df.columns
    assert [k for k in kept if k[0] is not None] == [(3, "k l m"), (4, other), (8, " ")]
    left = [k[1] for k in kept if k[0] is None]
    assert len(left) == 3 and None in left and "q" in left and ({one, two} & set(left))


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_is_close_and_bands_meet():
    random.seed(3)
    for jaccard in (0.85, 0.95):
        missed, found = 0, []
        for trial in range(60):
            words = [f"{trial}_{i}" for i in range(600)]
            cut = round(len(words) * (1 - jaccard) / (1 + jaccard))
            one, other = shingle_sets([" ".join(words[cut:]).encode(), " ".join(words[:len(words) - cut]).encode()])
            sketches = np.stack([registers(one), registers(other)])
            found.append(estimates(sketches[0], sketches[1:])[0][0])
            keys = band_keys(sketches)
            missed += not (keys[0] == keys[1]).any()
        assert missed == 0
        assert abs(np.mean(found) - jaccard) < 0.03


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.seed(1)
    random.shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    found = dict(map(tuple, components(edges).collect()))
    assert found == {**dict.fromkeys(range(300), 0), 1000: 1000, 1001: 1000}
