import random

import pytest
from pyspark.sql import functions as F

from clickspan.llm.mixing import mix, mixed

SCHEMA = "doc_id long, text string, source string, size string"


def fill(sizes, weights, ratio=1.5, cap=2.0):
    """Targets by resharing the excess again and again."""
    total = ratio * sum(sizes)
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = (total - sum(target[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > cap * sizes[i]}
        for i in open_:
            target[i] = cap * sizes[i] if i in over else level * weights[i]
        if not over:
            break
        open_ -= over
    return target


def rows(spark, docs):
    return spark.createDataFrame([(i, t, s, "clash") for i, t, s in docs], SCHEMA)


def test_targets_and_copies(spark):
    random.seed(4)
    docs = [(i, " ".join(["w"] * random.randint(0, 60)), random.choice(["b", "a", "c", "a", "a", "é", None])) for i in range(3000)]
    found = mix(rows(spark, docs)).collect()
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(s for s in sizes if s is not None) + [None]
    want = dict(zip(order, fill([sizes[s] for s in order], [[5, 2, 1][i % 3] for i in range(len(order))])))
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 130, s  # two documents of the largest size


def test_runs_agree_whatever_the_partitions(spark):
    docs = [(i, "w " * (i % 7), "abc"[i % 3]) for i in range(500)]
    one, two = (mix(rows(spark, d).repartition(n)).select("doc_id", "copies") for d, n in ((docs, 2), (docs[::-1], 7)))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_edges(spark):
    assert mix(rows(spark, [])).count() == 0
    nothing = mix(rows(spark, [(1, None, "a"), (2, "", "a"), (None, " \n", None)])).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in nothing] == [(0, 0.0, 0)] * 3
    same = mix(rows(spark, [(1, "x y", "a")] * 4))
    assert sum(r["copies"] for r in same.collect()) == 6  # 1.5 copies of each
    copies = mixed(rows(spark, [(1, "x y", "a")] * 4))
    assert copies.count() == 6 and copies.columns == ["doc_id", "text", "source", "size"]
    assert copies.filter("size = 'clash'").count() == 6
    long = mix(rows(spark, [(1, "w " * 200_000, "a"), (2, "w", "b")])).collect()
    assert {r["doc_id"]: r["size"] for r in long} == {1: 200_000, 2: 1}


def test_hot_source_is_whole(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"),
                                      F.when(F.col("id") % 10 < 9, "hot").otherwise("b").alias("source"))
    found = mix(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r["t"] - r["w"]) <= 6 for r in found)


def test_parameters(spark):
    with pytest.raises(ValueError):
        mix(rows(spark, []), weights=())
