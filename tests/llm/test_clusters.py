import random

import numpy as np
import pytest

from clickspan.llm import clusters as module
from clickspan.llm.clusters import clusters, means, moved
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, cluster string, x string"


def run(spark, vectors, **parameters):
    df = spark.createDataFrame([(i, v, "clash", "y") for i, v in vectors], SCHEMA)
    found, centroids = clusters(df, **parameters)
    return sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), centroids.tolist()


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(5, 8))
    return [(i, (middles[i % 5] + rng.normal(scale=0.2, size=8)).astype(np.float32).tolist()) for i in range(300)]


@pytest.mark.parametrize("k, rounds", [(16, 3), (3, 5), (1, 1), (4, 0)])
def test_against_brute_force(spark, vectors, k, rounds):
    assert run(spark, vectors, k=k, rounds=rounds, dims=8) == brute.clusters(vectors, k, rounds, 8)


def test_what_takes_no_part(spark, vectors):
    odd = [(900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 7 + [None]), (904, [float("nan")] * 8), (905, [float("inf")] + [0.0] * 7), (906, [3e6] + [0.0] * 7)]
    assert run(spark, vectors + odd, k=5, dims=8) == run(spark, vectors, k=5, dims=8)


def test_ties_and_repeated_rows(spark):
    random.seed(8)
    same = [(i, [0.5, -0.5]) for i in range(20)] + [(3, [0.5, -0.5])] * 5 + [(50 + i, [random.random(), -1e5]) for i in range(9)]
    assert run(spark, same, k=6, dims=2) == brute.clusters(same, 6, 3, 2)


def test_few_vectors_and_empty_table(spark):
    few = [(1, [0.1, 0.2]), (2, [3.0, 4.0])]
    assert run(spark, few, k=16, dims=2) == brute.clusters(few, 16, 3, 2)
    assert run(spark, [], dims=2) == ([], [])
    assert run(spark, [(None, [0.1, 0.2])], dims=2)[0] == [(None, 0, 0)]


def test_products_stay_those_of_the_centroids(spark, vectors):
    found, centroids = clusters(spark.createDataFrame([(i, v, "", "") for i, v in vectors], SCHEMA), k=4, dims=8)
    for r in found.collect():
        assert r["dots"] == (centroids @ np.array(r["x"])).tolist() and r["norm"] == sum(v * v for v in r["x"])


def test_a_round_without_moves_writes_nothing(spark, monkeypatch):
    written = []
    monkeypatch.setattr(module, "moved", lambda state, before, after: written.append(after) or moved(state, before, after))
    run(spark, [(1, [0.0, 0.0]), (2, [9.0, 9.0])], k=2, dims=2)
    assert len(written) == 1


def test_empty_cluster_keeps_its_centroid(spark):
    state = spark.createDataFrame([([2, 3], 0), ([-5, 0], 0)], "x array<int>, cluster int")
    assert means(state, np.array([[9, 9], [7, 7]])).tolist() == [[-2, 1], [7, 7]]
