import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickspan.llm import neighbours as module
from clickspan.llm.neighbours import neighbours, walk
from clickspan.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, queries, k):
    seen = {(i, tuple(v)) for i, v in rows}
    out = {}
    for q, x in queries.items():
        scored = sorted((-float((np.array(x) * np.array(v)).sum()), i) for i, v in seen if i != q)
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def found(df, is_query, **parameters):
    out = {}
    for r in neighbours(df, is_query, **parameters).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.Generator(np.random.PCG64(4))
    return [(i, [float(np.float32(x)) for x in rng.normal(size=8) * (1 + i % 5)]) for i in range(600)]


def test_whole_index_is_exact(spark, rows, monkeypatch):
    monkeypatch.setattr(module, "ENTRY_BLOCK", 50)
    monkeypatch.setattr(module, "QUERY_BLOCK", 7)
    same = [(1000 + i, rows[20][1]) for i in range(90)] + [(2000, rows[40][1])] * 3
    odd = [(5000, None), (5020, []), (5040, [0.0] * 8), (5060, [1.0] * 7), (5080, [1.0] * 7 + [None]), (5100, [math.nan] * 8),
           (5120, [math.inf] + [0.0] * 7), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows + same + odd], SCHEMA)
    queries = {i: v for i, v in rows + same if i % 20 == 0}
    got = found(df, F.col("vec_id") % 20 == 0, share=1.0)
    want = brute([*rows, *same], queries, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [x[:2] for x in got[q]] == [x[:2] for x in want[q]]
        assert np.allclose([x[2] for x in got[q]], [x[2] for x in want[q]], rtol=0, atol=1e-12)


def test_fewer_candidates_than_asked(spark, rows):
    df = spark.createDataFrame([(i, v, "") for i, v in rows[:6]], SCHEMA)
    got = found(df, F.col("vec_id") < 2)
    assert {q: len(v) for q, v in got.items()} == {0: 5, 1: 5}
    assert found(df.limit(0), F.lit(True)) == {} and found(df.limit(1), F.lit(True)) == {}
    assert found(df, F.lit(False)) == {}


def test_walk_is_in_order_and_complete():
    random.seed(1)
    one, two = np.array([random.random() for _ in range(7)]), np.array([random.random() for _ in range(5)])
    held = np.ones((7, 5), dtype=int)
    cells = list(walk(one, two, held, 100))
    assert sorted(cells) == [(a, b) for a in range(7) for b in range(5)]
    sums = [one[a] + two[b] for a, b in cells]
    assert sums == sorted(sums)
    assert len(list(walk(one, two, held, 9))) == 9


def test_recall_on_test_vectors(spark):
    sf_dir = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in table]), np.array([r[1] for r in table], dtype=float)
    got = {}
    for r in neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        order = [j for j in np.lexsort((ids, -(x * x[i]).sum(axis=1))) if j != i][:20]
        hits += len(got[int(ids[i])] & set(ids[order].tolist()))
        total += 20
    assert hits / total >= 0.9
    assert QUERIES["op7_multi_index"](spark, sf_dir).count() == total
