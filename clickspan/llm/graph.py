"""Connected components as a Spark loop over written tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspan.llm.tables import written


def _least(labels: DataFrame, more: DataFrame) -> DataFrame:
    return labels.unionByName(more).groupBy("id").agg(F.min("component").alias("component"))


def _followed(labels: DataFrame, onward: DataFrame) -> DataFrame:
    """``labels`` (id, component) whose component is led on by ``onward`` (id, component)."""
    step = onward.select(F.col("id").alias("component"), F.col("component").alias("_onward"))
    return labels.join(step, "component").select("id", F.col("_onward").alias("component"))


def _jumped(labels: DataFrame, pointers: DataFrame) -> DataFrame:
    """``labels`` (id, component) with every component led on by ``pointers``, and whether it ``moved``."""
    step = pointers.filter("component < id").select(F.col("id").alias("component"), F.col("component").alias("_onward"))
    return labels.join(step, "component", "left").select(
        "id", F.coalesce("_onward", "component").alias("component"), F.col("_onward").isNotNull().alias("moved"))


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id that can be reached.

    Every node points to its smallest neighbour, or to itself where that is larger, and follows the pointers of
    its pointer, twice in a written step, until it points to a root. Then edges lead between roots, loops and repeats go, and the rest is
    another, smaller graph. Stars take one round and chains one round of a few jumps. Every step is written, which cuts the lineage. Loops and repeated edges do
    no harm.
    """
    usable = edges.filter("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, levels = written(usable, "edges"), []
    for _ in range(most_rounds):
        both = left.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
            left.select(F.col("b").alias("id"), F.col("a").alias("component")))
        labels = written(both.groupBy("id").agg(F.least("id", F.min("component")).alias("component")), "labels")
        for _ in range(most_rounds):
            labels = written(_jumped(_jumped(labels, labels).drop("moved"), labels), "labels")
            settled, labels = labels.filter("moved").isEmpty(), labels.drop("moved")
            if settled:
                break
        else:
            raise RuntimeError(f"pointers did not settle in {most_rounds} rounds")
        levels.append(labels)
        named = [labels.select(F.col("id").alias(c), F.col("component").alias(f"_{c}")) for c in ("a", "b")]
        between = left.join(named[0], "a").join(named[1], "b").filter("_a <> _b")
        left = written(between.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
        if left.isEmpty():
            return levels[0] if len(levels) == 1 else written(
                reduce(lambda known, level: _least(known, _followed(known, level)), levels), "labels")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
