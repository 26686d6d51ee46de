"""Nearest neighbours by an inverted multi-index.

Each vector is cut into two halves, each half quantised by its own codebook, and a pair of centroids is a
cell. For a query the centroids of each half are ordered by distance (here the negative inner product, the
measure asked for), and a heap walks the pairs in order of summed distance until the cells seen hold
``share`` of all entries, and ``least`` at any rate. The entries of those cells are reranked by the exact
inner product in double precision.

Codebooks are learnt on ``sample`` vectors at most (the smallest by hash); every vector is indexed. Equal
vectors are one entry that keeps its k + 1 smallest ids, which is all that a result of k can show, so a
vector that a third of the rows share is one entry. Entries and queries meet in blocks of bounded size; a
block knows only one centroid of the first half.

Vectors without structure need a large share: on the random test vectors 0.9 recall takes half of the
entries. ``share`` should be lowered where vectors form clusters.

Cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows without vec_id; equal rows count once; of several vectors with the id
of a query the smallest is the query; ties go to the smaller vec_id; an empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickspan.llm.tables import table, written

ENTRY_BLOCK, QUERY_BLOCK = 8192, 1024
#: Entries per cell aimed at, and the most centroids per half.
PER_CELL, MOST_CENTROIDS = 16, 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (
        vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector"))
        .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .filter(finite & F.exists("vector", lambda x: x != 0))
    )
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (usual["n"] if usual else 0))


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def codebook(points: np.ndarray, centroids: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a bounded sample by k-means; the first ones are spread evenly over the sample."""
    book = points[np.linspace(0, len(points) - 1, centroids).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmin((book**2).sum(axis=1) - 2 * points @ book.T, axis=1)
        for c in np.unique(nearest):
            book[c] = points[nearest == c].mean(axis=0)
    return book


def walk(one: np.ndarray, two: np.ndarray, held: np.ndarray, wanted: int) -> Iterator[tuple[int, int]]:
    """Cells in order of one[i] + two[j], smallest first, until they hold ``wanted`` entries."""
    first, second = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    one, two, held = one.tolist(), two.tolist(), held.tolist()
    heap = [(one[first[0]] + two[second[0]], 0, 0)]
    while heap and wanted > 0:
        _, i, j = heapq.heappop(heap)
        a, b = first[i], second[j]
        if held[a][b]:
            yield a, b
            wanted -= held[a][b]
        # Each pair is pushed once: along the second half from everywhere, along the first from its edge.
        if j + 1 < len(second):
            heapq.heappush(heap, (one[a] + two[second[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (one[first[i + 1]] + two[b], i + 1, 0))


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, share: float = 0.65, sample: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of ``vectors`` that ``is_query`` holds for."""
    rows = usable(vectors)
    by_vector = W.partitionBy("vector").orderBy("vec_id")
    entries = written(
        rows.withColumn("_rank", F.dense_rank().over(by_vector)).filter(F.col("_rank") <= k + 1)
        .groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "entries")
    total = entries.count()
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    learnt = entries.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample).toArrow()
    points = _matrix(learnt.column("vector").combine_chunks())
    half = points.shape[1] // 2
    centroids = max(1, min(MOST_CENTROIDS, len(points), round((total / PER_CELL) ** 0.5)))
    books = codebook(points[:, :half], centroids), codebook(points[:, half:], centroids)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"))
            cells = [np.argmin((book**2).sum(axis=1) - 2 * part @ book.T, axis=1)
                     for book, part in zip(books, (x[:, :half], x[:, half:]))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c.astype(np.int32)) for c in cells]], [*batch.schema.names, "c1", "c2"])

    kind = dict(rows.dtypes)["vector"]
    placed = written(entries.mapInArrow(place, f"vector {kind}, ids array<long>, c1 int, c2 int"), "cells")
    held = np.zeros((centroids, centroids), dtype=np.int64)
    for c1, c2, n in placed.groupBy("c1", "c2").count().collect():
        held[c1, c2] = n
    blocks = np.ceil(held.sum(axis=1) / ENTRY_BLOCK).astype(np.int64)
    wanted = max(k + 1, int(np.ceil(share * total)))

    asked = rows.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    asked = written(asked, "asked")
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"))
            near = [-part @ book.T for book, part in zip(books, (x[:, :half], x[:, half:]))]
            rows, c1s, lists = [], [], []
            for i in range(len(x)):
                seen: dict[int, list[int]] = {}
                for a, b in walk(near[0][i], near[1][i], held, wanted):
                    seen.setdefault(a, []).append(b)
                rows += [i] * len(seen)
                c1s += seen
                lists += seen.values()
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(rows)) for c in batch.columns], pa.array(c1s, pa.int32()), pa.array(lists, pa.list_(pa.int32()))],
                [*batch.schema.names, "c1", "c2s"])

    per_c1 = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("c1") + 1)
    left = placed.withColumn("eb", F.pmod(F.xxhash64("vector"), per_c1).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = (
        asked.mapInArrow(visit, f"query_id long, vector {kind}, c1 int, c2s array<int>")
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
        .withColumn("eb", F.explode(F.sequence(F.lit(0), per_c1.cast("int") - 1)))
    )

    def rerank(entry: pa.Table, query: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if entry.num_rows and query.num_rows:
            x, q = (_matrix(t.column("vector").combine_chunks()) for t in (entry, query))
            c2 = entry.column("c2").to_numpy()
            ids = entry.column("ids").to_pylist()
            scores = np.full((len(q), len(x)), -np.inf)
            visits = query.column("c2s").to_pylist()
            for cell in np.unique(c2):
                of = np.flatnonzero(c2 == cell)
                who = np.array([i for i, cells in enumerate(visits) if cell in cells], dtype=np.int64)
                if len(who):
                    scores[np.ix_(who, of)] = q[who] @ x[of].T
            keep = min(len(x), k + 9)  # a few more, for the last bits of a product differ by its place in a block
            best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
            for i, query_id in enumerate(query.column("query_id").to_pylist()):
                chosen = best[i][scores[i, best[i]] > -np.inf]
                exact = (x[chosen] * q[i]).sum(axis=1)
                found = [(-s, v) for s, e in zip(exact.tolist(), chosen.tolist()) for v in ids[e] if v != query_id]
                found.sort()
                found = found[:k]
                if found:
                    s, v = zip(*found)
                    out.append((np.full(len(v), query_id), np.array(v), -np.array(s)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float64)]
        return pa.table([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    key = ["c1", "eb", "qb"]
    parts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
