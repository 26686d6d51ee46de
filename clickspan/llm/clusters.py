"""Centroid clustering on an incremental distance matrix of exact integers.

Every vector is turned into integers, and its dot products with all centroids are kept beside it in a written
table. A squared distance is |x|² - 2 x·c + |c|², so only the dot products depend on the centroids. When a
round moves a centroid, the products change by x·(new - old), which takes only the components in which the
centroid moved; centroids and components that stay cost nothing, and a round in which nothing moves writes no
table. The argmin is recomputed from the table. What each task closes over is centroids x components numbers.

Sums of clusters are added up in the tasks first, one row per cluster and task, so a cluster that holds most
vectors is no hot key. Everything is integer arithmetic, so results don't depend on the order of rows.

Cases: vectors that are null, of another length, or with a null or non-finite component take no part, nor do
those with a component of 2²¹ or more in magnitude, whose squared distances would not fit a long; repeated
rows count each; a null vec_id is hashed as an empty one; equal hashes are ordered by their components; fewer
vectors than centroids make fewer centroids; an empty table gives no row. An empty cluster keeps its centroid.
Other columns, clashing ones too, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickspan.llm.tables import table, written

#: Vectors with a larger component are outside exact long arithmetic.
MOST = float(1 << 21)
_STATE = "vec_id long, x array<int>, norm long, dots array<long>, cluster int, distance long"


def integers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x) of the vectors that take part: floor(scale * component)."""
    x = F.col("embedding").cast("array<double>")
    fit = (F.size(x) == dims) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < MOST), F.lit(False)))
    return vectors.filter(fit).select(
        F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("x"))


def seeds(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes, in their order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(order.alias("_order"), "x").orderBy("_order", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(values.reshape(-1), kind))


def moved(state: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """``state`` with dot products, nearest centroid and distance for the centroids ``after``, written.

    Only the components in which a centroid differs from ``before`` are read.
    """
    change = after - before
    touched = [(c, np.flatnonzero(change[c])) for c in range(len(after)) if change[c].any()]
    squares = (after * after).sum(axis=1)

    def update(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), np.int64)
            dots = _matrix(batch.column("dots"), np.int64)
            for c, parts in touched:
                dots[:, c] += x[:, parts] @ change[c, parts]
            norm = batch.column("norm").to_numpy()
            far = norm[:, None] - 2 * dots + squares
            nearest = far.argmin(axis=1)  # the first of equals
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), batch.column("norm"), _lists(dots, pa.int64()),
                 pa.array(nearest.astype(np.int32)), pa.array(far[np.arange(len(far)), nearest])],
                ["vec_id", "x", "norm", "dots", "cluster", "distance"])

    return written(state.mapInArrow(update, _STATE), "distances")


def means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Floored componentwise means of the clusters; an empty one keeps its centroid."""
    k, dims = before.shape

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cluster = _matrix(batch.column("x"), np.int64), batch.column("cluster").to_numpy()
            for c in np.unique(cluster):
                own = cluster == c
                sums[c] += x[own].sum(axis=0)
                counts[c] += own.sum()
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.astype(np.int32)), _lists(sums[own], pa.int64()), pa.array(counts[own])], ["cluster", "sums", "n"])

    parts = state.select("x", "cluster").mapInArrow(add, "cluster int, sums array<long>, n long")
    totals = (
        parts.select("cluster", "n", F.posexplode("sums").alias("at", "value")).groupBy("cluster", "at")
        .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")))
    after = before.copy()
    for r in totals.collect():  # centroids x components numbers
        after[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return after


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, norm, dots, cluster, distance) of ``vectors`` (vec_id, embedding), and the final centroids."""
    kept = integers(vectors, dims, scale)
    centroids = seeds(kept, k, seed)
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], _STATE), np.zeros((0, dims), dtype=np.int64)
    square = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * v)
    none = F.array_repeat(F.lit(0).cast("long"), len(centroids))
    start = kept.select("vec_id", "x", square.alias("norm"), none.alias("dots"))
    state = moved(start, np.zeros_like(centroids), centroids)
    for _ in range(rounds):
        after = means(state, centroids)
        if (after == centroids).all():
            break
        state = moved(state, centroids, after)
        centroids = after
    return state, centroids


def op13_incremental_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clusters(table(spark, sf_dir, "embeddings"))
    digests = [(c, sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_sum")).collect()  # k rows
    by_cluster = {r["cluster"]: int(r["_sum"]) for r in sums}
    facts = spark.createDataFrame(
        [(c, by_cluster.get(c, 0), sum(by_cluster.values()), digest) for c, digest in digests],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 16, rounds: int = 3) -> str:
    parts = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: isfinite(v))) = 64),
flat AS MATERIALIZED (SELECT id, j, x[j] AS v FROM kept, unnest(range(1, 65)) AS t(j)),
c0 AS MATERIALIZED (
  SELECT c, j, x[j] AS v FROM (
    SELECT x, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), x) - 1 AS c FROM kept
    QUALIFY c < {k}), unnest(range(1, 65)) AS t(j))"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT id, c, far FROM (
    SELECT id, c, sum((flat.v - c{r}.v) * (flat.v - c{r}.v)) AS far FROM flat JOIN c{r} USING (j) GROUP BY id, c)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY far, c) = 1)""")
        if r < rounds:
            parts.append(f"""
m{r} AS (SELECT c, j, floor_div AS v FROM (
  SELECT c, j, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
  FROM flat JOIN a{r} USING (id) GROUP BY c, j)),
c{r + 1} AS MATERIALIZED (SELECT c, j, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c, j))""")
    return ",".join(parts) + f""",
named AS (SELECT c, sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, far::BIGINT AS distance, (sum(far) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(far) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN a{rounds} USING (id) JOIN named USING (c)
"""


OP13_SQL = _sql()
