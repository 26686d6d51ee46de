"""The pipeline, stage by stage, against plain versions of what the stages promise."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from clickspan.llm.packing import WordIds, _default_tokenizer
from clickspan.llm.tables import table, written
from tests.llm import brute
from tests.llm.test_mixing import fill


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = written(stage(spark, docs, sf_dir), name)
    return out


def test_columns(stages):
    names = stages["input"].dtypes
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].dtypes == names


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality(stages):
    before, after = rows(stages["input"]), rows(stages["quality"])
    assert set(after) <= set(before) and all(after[d] == before[d] for d in after)
    assert not any(brute.quality(r["text"])[5] for r in after.values())
    for d in set(before) - set(after):
        n, chars, symbols, duplicate, _, failed = brute.quality(before[d]["text"])
        lines = len([x for x in before[d]["text"].split("\n") if brute.words(x)])
        assert failed or 10 * symbols > n or 10 * duplicate > 3 * lines or not 3 * n <= chars <= 12 * n


def test_near_duplicates(stages):
    before, after = rows(stages["quality"]), rows(stages["near_duplicates"])
    want = brute.near({d: r["text"] for d, r in before.items()}, 80)
    assert set(after) == {d for d, (_, c) in want.items() if d == c}


def test_personal_data(stages):
    before, after = rows(stages["near_duplicates"]), rows(stages["personal_data"])
    assert set(before) == set(after)
    for d in before:
        if brute.entities(before[d]["text"]):
            assert after[d]["text"] != before[d]["text"] and after[d]["n_chars"] == len(after[d]["text"])
            for _, a, b in brute.entities(before[d]["text"]):
                assert before[d]["text"][a:b] not in after[d]["text"]
        else:
            assert after[d] == before[d]


def test_mixing(stages):
    before, copies = rows(stages["personal_data"]), Counter(r["doc_id"] for r in stages["mixing"].collect())
    assert set(copies) <= set(before) and max(copies.values()) <= 2
    size = {d: len(brute.words(r["text"])) for d, r in before.items()}
    # Along ascending sizes the copies are never off by a whole one, so a source is off by two documents at most.
    sources = {}
    for d, r in before.items():
        sources.setdefault(r["source"], []).append(d)
    order = sorted(sources, key=lambda x: (x is None, x or ""))
    targets = fill([sum(size[d] for d in sources[s]) for s in order], [[5, 2, 1][i % 3] for i in range(len(order))])
    for s, target in zip(order, targets):
        taken = sum(size[d] * copies[d] for d in sources[s])
        assert abs(taken - target) <= 2 * max(size[d] for d in sources[s]) + 1


def test_packing(stages):
    ids = WordIds(_default_tokenizer())
    want = Counter()
    for r in stages["mixing"].collect():
        tokens = ids.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(tokens), 4096):
            part = np.array(tokens[k:k + 4096], dtype="<u4")
            want[r["doc_id"], k // 4096, k, len(part), zlib.crc32(part.tobytes())] += 1
    found = stages["packing"].collect()
    assert Counter(tuple(r)[:5] for r in found) == want
    assert len({r["sequence_id"] for r in found}) <= -(-sum(r["length"] for r in found) // 4096) + 1


def test_run_gives_the_same_pieces(spark, sf_dir, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    one, two = (Counter(map(tuple, df.select(*key).collect())) for df in (corpus_pipeline.run(spark, sf_dir), stages["packing"]))
    assert one == two


def test_empty(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    assert docs.count() == 0


def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    def text(k):
        return " ".join(f"t{k}w{i} is here" if i % 4 else f"t{k}w{i}." for i in range(40))
    long = " ".join(f"long{i} word" for i in range(30_000))
    rows = [(k, text(k), "en", "a" if k % 2 else "b", len(text(k))) for k in range(12)]
    return [*rows, rows[3], rows[3], (None, text(20), None, None, None), (None, text(20), None, None, None), (21, text(20), "en", None, None),
            (30, None, "en", "a", 0), (31, "", None, "b", 0), (32, " \n\t", "en", "a", None), (None, None, None, None, None),
            (40, long, "en", "a", len(long)), (41, text(41) + " mail x@y.org or " + "z" * 300, "en", "c", 1)]


def test_odd_rows_and_clashing_columns(spark, sf_dir):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    more = ["size", "kept", "key", "hash", "digest", "base", "n_words", "_host"]
    rows = [(*r, *[f"{c}-{r[0]}" for c in more]) for r in odd_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in more))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == [*names, *more]
            assert all(r[c] == f"{c}-{r['doc_id']}" for r in kept[name] for c in more)
    ids = lambda name: sorted((r["doc_id"] for r in kept[name]), key=lambda d: (d is None, d or 0))
    assert ids("quality") == [0, 1, 2, 3, 3, 3, *range(4, 12), 21, 40, 41, None, None]
    assert ids("near_duplicates") == [*range(12), 21, 40, 41]
    assert ids("personal_data") == ids("near_duplicates")
    assert [r["text"].count("[EMAIL]") for r in kept["personal_data"] if r["doc_id"] == 41] == [1]
    assert set(ids("mixing")) <= set(ids("personal_data"))
    assert {r["doc_id"] for r in kept["packing"]} == set(ids("mixing"))
    assert max(r["piece"] for r in kept["packing"]) > 0
