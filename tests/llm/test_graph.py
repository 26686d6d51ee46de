import random

import pytest

from clickspan.llm import graph
from clickspan.llm.graph import components
from clickspan.llm.tables import written


def plain(edges):
    parent = {x: x for e in edges for x in e}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return sorted((x, find(x)) for x in parent)


def found(spark, edges):
    return sorted(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([30, 300])
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.3, 0.6, 1.2])))]
    assert found(spark, edges) == plain(edges)


@pytest.mark.parametrize("shape", ["up", "down", "zigzag", "star", "tree"])
def test_long_shapes(spark, shape):
    n = 300
    edges = {
        "up": [(i, i + 1) for i in range(n)], "down": [(i + 1, i) for i in range(n)],
        "zigzag": [(i, n + i) for i in range(n)] + [(n + i, i + 1) for i in range(n - 1)],
        "star": [(n, i) for i in range(n)], "tree": [(i, (i * 7919) % (i or 1)) for i in range(1, n)],
    }[shape]
    assert found(spark, edges) == plain(edges)


def test_loops_repeats_nulls_and_nothing(spark):
    assert found(spark, [(1, 1), (2, 3), (3, 2), (2, 3)]) == [(1, 1), (2, 2), (3, 2)]
    assert components(spark.createDataFrame([(None, 1), (4, 5)], "a long, b long")).count() == 2
    assert found(spark, []) == []


def test_steps_written(spark, monkeypatch):
    """Pointers that lead to a root in three jumps settle in one written step."""
    steps = []
    monkeypatch.setattr(graph, "written", lambda df, name: steps.append(name) or written(df, name))
    assert found(spark, [(1, 2), (2, 3), (3, 4)]) == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert steps == ["edges", "labels", "labels", "edges"] or steps == ["edges", "labels", "labels", "labels", "edges"]
