"""Near-duplicate groups by HyperMinHash.

A document is the set of its distinct five-word shingles (A-Z lower-cased; with fewer words, the whole
sequence is its one shingle). Documents are linked when 100 * intersection >= 85 * union (a parameter), and
a group is what links connect.

* A sketch has 256 buckets. A shingle's hash picks the bucket; of the smallest remaining value in a bucket
  the number of leading zeros (capped at 14) and four mantissa bits after the leading one are kept: a byte.
* Equal sets (128-bit digest of the sorted shingles) are one node with a number of its own from here on, so that
  thousands of exact copies cost one row each and null or repeated ids do no harm.
* Bands of six registers meet in 42 hash tables. Empty registers borrow from others by a fixed probe order,
  so that short documents don't meet by emptiness. A pair at 0.85 misses all bands with probability 2e-9.
* The Jaccard estimate, corrected for chance collisions of the compressed registers, sorts out pairs that
  lie 5.5 standard deviations below the threshold; all others are verified on the full sets.
* Every document is first held against the smallest document that it meets; what that links is settled.
  Only pairs of different components are left then. In each bucket those that the estimate lets through
  give a spanning forest, not all pairs; what the forests connect is a group, and inside a group documents
  meet on their full sets. Buckets and groups are cut into chunks of 256 documents that meet chunk by
  chunk, so no task holds one whole.

Cases: a document without words has an empty set, no link and itself as component; rows with a null doc_id are
linked like others, but give no component its number: a group of such rows only has a null component. A doc_id
with several texts is linked by each of them, and each of its rows has the component of its own text. Repeated rows
get a row each. A row is kept if its doc_id is the component's; in a group without ids the rows of one text are, and
of rows without words all. Very long texts are whole sets. Other columns are ignored, clashing ones too; an empty
table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickspan.llm.batches import byte_texts, runs
from clickspan.llm.graph import components
from clickspan.llm.hashing import blocks, mix, stretches, window_hashes, word_hashes
from clickspan.llm.tables import table, written

WIDTH = 5
BUCKETS, BANDS, ROWS = 256, 42, 6
SIGMAS = 5.5
CHUNK = 256
FIRST_BANDS = 6
_random = np.random.Generator(np.random.PCG64(777))
_PROBES = np.stack([_random.permutation(BUCKETS) for _ in range(BUCKETS)])
_BAND_BASE = int(_random.integers(2**62, 2**63)) | 1


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, begins = word_hashes(texts, lower=True)
    windows = window_hashes(words, width)
    for begin, end in zip(begins, begins[1:]):
        if end - begin >= width:
            yield np.unique(windows[begin:end - width + 1])
        elif end > begin:
            yield stretches(words[begin:end], np.array([0]), np.array([end - begin]), 3 + 2 * int(end - begin))
        else:
            yield windows[:0]


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash sketch of sorted distinct hashes; 0 marks an empty bucket."""
    found = np.zeros(BUCKETS, dtype=np.uint8)
    if len(shingles):
        bucket = (shingles >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        mantissa, bits = np.frexp((shingles[first] & np.uint64(2**56 - 1)).astype(np.float64))
        zeros = np.minimum(56 - bits, 14)
        found[bucket[first]] = 1 + 16 * zeros + np.clip((mantissa - 0.5) * 32, 0, 15).astype(np.int64)
    return found


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """Hash of each band of each sketch, after empty registers have borrowed."""
    full = sketches.copy()
    for row in np.flatnonzero((sketches == 0).any(axis=1) & (sketches != 0).any(axis=1)):
        have = sketches[row] != 0
        empty = np.flatnonzero(~have)
        probes = _PROBES[empty]
        full[row, empty] = sketches[row, probes[np.arange(len(empty)), have[probes].argmax(axis=1)]]
    bands = full[:, :BANDS * ROWS].reshape(len(full), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
    for i in range(ROWS):
        key = mix(key * np.uint64(_BAND_BASE) + bands[:, :, i])
    return key


def _chance() -> float:
    """Probability that the registers of two unrelated minima agree (same zeros, same mantissa)."""
    zeros = [2.0 ** -(z + 1) for z in range(14)] + [2.0 ** -14]
    return sum(p * p for p in zeros) / 16


def estimates(one: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of a sketch against others, corrected for collisions, and the buckets they rest on."""
    used = np.maximum(((others != 0) | (one != 0)).sum(axis=1), 1)
    agree = ((others == one) & (others != 0)).sum(axis=1) / used
    return (agree - _chance()) / (1 - _chance()), used


def likely(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs can reach the threshold by their sizes and, within SIGMAS, by the estimate."""
    t = percent / 100
    found, used = estimates(one, others)
    fit = 100 * np.minimum(size, sizes) >= percent * np.maximum(size, sizes)
    return fit & (found >= t - SIGMAS * np.sqrt(t * (1 - t) / used))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, hash, n_shingles, digest of the set and sketch of each row of (doc_id, hash, text)."""
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in byte_texts(batch.column(2))]
            for begin, end in blocks(texts):
                sizes, digests, sketches = [], [], []
                for shingles in shingle_sets(texts[begin:end]):
                    sizes.append(len(shingles))
                    digests.append(blake2b(shingles.tobytes(), digest_size=16).digest())
                    sketches.append(registers(shingles).tobytes())
                own = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(sketches, pa.binary())], ["doc_id", "hash", "n_shingles", "digest", "sketch"])

    return docs.select("doc_id", "hash", "text").mapInArrow(
        sign, "doc_id long, hash binary, n_shingles long, digest binary, sketch binary")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS)


def _bands(nodes: DataFrame) -> DataFrame:
    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = band_keys(_sketches(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, BANDS)),
                 pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(ids)))], ["key", "id", "band"])

    return nodes.select("id", "sketch").mapInArrow(spread, "key long, id long, band int")


def _first_pairs(meeting: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Each node with the smallest one that it meets, where the sketches allow a link."""
    pairs = meeting.filter("least_id < id").groupBy("id").agg(F.min("least_id").alias("a")).withColumnRenamed("id", "b")
    sides = [nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab"]

    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ones, others = _sketches(batch.column("s_a")), _sketches(batch.column("s_b"))
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            t = percent / 100
            found, used = estimates(ones, others)
            keep = (found >= t - SIGMAS * np.sqrt(t * (1 - t) / used)) & (
                100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(sides[1], "b").join(sides[0], "a")
    return joined.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(sift, "a long, b long")


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from sorted batches."""
    group: list[pa.RecordBatch] = []
    last = None
    for key, part in runs(batches, keys):
        if key != last and group:
            yield pa.Table.from_batches(group)
            group = []
        last = key
        group.append(part)
    if group:
        yield pa.Table.from_batches(group)


def _as_pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _open_groups(meeting: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(id, component): what pairs of different components connect that share a bucket and may be linked.

    A task sees two chunks of a bucket at most and returns a spanning forest of its pairs, so the result
    has no more rows than the bucket. The first few bands connect nearly everything; the others are then
    held only where they may connect more.
    """
    edges = _forests(meeting.filter(F.col("band") < FIRST_BANDS), labels, labels.limit(0), nodes, percent)
    edges = written(edges, "forests")
    groups = components(edges)
    more = written(_forests(meeting, labels, groups, nodes, percent), "forests")
    return components(groups.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more))


def _forests(meeting: DataFrame, labels: DataFrame, groups: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Spanning forests (a, b) by bucket over what differs in both component and group."""
    placed = (
        meeting.select("key", "id").join(labels.withColumnRenamed("component", "c"), "id", "left")
        .join(groups.withColumnRenamed("component", "g"), "id", "left")
        .withColumns({"c": F.coalesce("c", "id"), "g": F.coalesce("g", "id")})
    )
    several = placed.groupBy("key").agg(
        F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("g").alias("lo_g"), F.max("g").alias("hi_g"),
        F.count(F.lit(1)).alias("m")).filter("lo < hi and lo_g < hi_g")
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    rows = (
        placed.join(several.select("key", chunks.alias("chunks")), "key")
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        # A row goes to every pair of chunks that its own chunk is part of.
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .join(nodes.select("id", "n", "sketch"), "id")
        .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "c", "g", "n", "sketch")
        .repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "own", "id")
    )

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in _groups(batches, ["key", "x", "y"]):
            own, ids, c, n, tree = (group.column(k).to_numpy() for k in ("own", "id", "c", "n", "g"))
            x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
            sketches = _sketches(group.column("sketch"))
            tree = tree.copy()
            second = int(np.searchsorted(own, y))
            for i in range(len(ids) if x == y else second):
                # Within a chunk each pair once; else a row of one chunk with all of the other.
                begin = i + 1 if x == y else second
                rest = begin + np.flatnonzero((c[begin:] != c[i]) & (tree[begin:] != tree[i]))
                if len(rest):
                    hits = rest[likely(sketches[i], n[i], sketches[rest], n[rest], percent)]
                    joined, first = np.unique(tree[hits], return_index=True)
                    found += [(int(ids[i]), int(ids[j])) for j in hits[first]]
                    tree[np.isin(tree, joined)] = tree[i]
            if len(found) >= 10_000:
                yield _as_pairs(found)
                found = []
        if found:
            yield _as_pairs(found)

    return rows.mapInArrow(meet, "a long, b long")


def _open_links(groups: DataFrame, labels: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Verified links (a, b) between different components inside each group, as far as they join something.

    The documents of a group are dealt into chunks: those of a component with more than CHUNK documents
    into chunks of its own, all others together by component. Only pairs of chunks that can hold different
    components meet, so a large settled component is not held against itself.
    """
    rows = groups.select("id", F.col("component").alias("g")).join(
        labels.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    sizes = rows.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m")).withColumn("big", F.col("m") > CHUNK)
    small = sizes.groupBy("g").agg(F.sum(F.when(~F.col("big"), F.col("m")).otherwise(0)).alias("rest"))
    slots = lambda m: F.greatest(F.ceil(m / CHUNK), F.lit(1))
    rows = rows.join(sizes, ["g", "c"]).join(small, "g").select("g", "id", "c", F.when(
        F.col("big"), F.concat_ws(":", "c", F.pmod(F.xxhash64("id"), slots(F.col("m")))))
        .otherwise(F.concat_ws(":", F.lit("small"), F.pmod(F.xxhash64("c"), slots(F.col("rest"))))).alias("chunk"),
        F.when(F.col("big"), F.col("c").cast("string")).otherwise(F.col("id").cast("string")).alias("sole"))
    rows = written(rows, "chunks")
    chunks = rows.groupBy("g", "chunk").agg(F.min("sole").alias("lo"), F.max("sole").alias("hi"))
    other = chunks.select("g", *[F.col(k).alias(f"{k}_2") for k in ("chunk", "lo", "hi")])
    meetings = chunks.join(other, "g").filter("chunk <= chunk_2 and not (lo = hi and lo = lo_2 and lo_2 = hi_2)").select(
        "g", F.col("chunk").alias("x"), F.col("chunk_2").alias("y"))
    ones = rows.withColumnRenamed("chunk", "x").join(meetings, ["g", "x"]).select("g", "x", "y", F.lit(0).alias("side"), "id", "c")
    others = rows.withColumnRenamed("chunk", "y").join(meetings.filter("x < y"), ["g", "y"]).select(
        "g", "x", "y", F.lit(1).alias("side"), "id", "c")
    placed = (
        ones.unionByName(others).join(texts, "id").select("g", "x", "y", "side", "id", "c", "text")
        .repartition("g", "x", "y").sortWithinPartitions("g", "x", "y", "side", "id")
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["g", "x", "y"]):
            side, ids, tree = (group.column(k).to_numpy() for k in ("side", "id", "c"))
            tree = tree.copy()
            alone = group.column("x")[0].as_py() == group.column("y")[0].as_py()
            whole = [t or b"" for t in byte_texts(group.column("text"))]
            sets = [s for begin, end in blocks(whole) for s in shingle_sets(whole[begin:end], width)]
            sketches, n = np.stack([registers(s) for s in sets]), np.array([len(s) for s in sets])
            second = int(np.searchsorted(side, 1))
            found = []
            for i in range(len(ids) if alone else second):
                begin = i + 1 if alone else second
                rest = begin + np.flatnonzero(tree[begin:] != tree[i])
                if not len(rest):
                    continue
                for j in rest[likely(sketches[i], n[i], sketches[rest], n[rest], percent)]:
                    if tree[i] != tree[j]:
                        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * shared >= percent * (n[i] + n[j] - shared):
                            found.append((int(ids[i]), int(ids[j])))
                            tree[tree == tree[j]] = tree[i]
            if found:
                yield _as_pairs(found)

    return placed.mapInArrow(compare, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold; ``texts`` has id and text."""
    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                both = [list(shingle_sets([t or b"" for t in byte_texts(part.column(c))], width)) for c in ("t_a", "t_b")]
                for i, (one, other) in enumerate(zip(*both)):
                    shared = len(np.intersect1d(one, other, assume_unique=True))
                    keep[at + i] = shared > 0 and 100 * shared >= percent * (len(one) + len(other) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    a = texts.select(F.col("id").alias("a"), F.col("text").alias("t_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("t_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "t_a", "t_b").mapInArrow(compare, "a long, b long")


def _hashed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``hash``, 128 bits of the text."""
    return docs.withColumn("hash", F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))


def _classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The written signatures of ``docs`` (doc_id, text), and for every digest with shingles the ``best`` row of its
    group: the one with the smallest (doc_id, hash), null ids last.

    Whatever rows are joined with is written first: copies that share a digest or a band key then stand on a side
    that adaptive execution can split.
    """
    docs = _hashed(docs.select(F.col("doc_id").cast("long"), "text"))
    signed = written(signatures(docs), "signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("best")
    sets = written(
        signed.filter("n_shingles > 0").groupBy("digest")
        .agg(best, F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))  # equal sets, equal sketches
        .withColumn("id", F.monotonically_increasing_id()), "sets")
    # A table of its own, so that Spark knows the sketches' size: of columns of a wider table it only guesses it, and
    # would broadcast sketches far beyond its limit.
    nodes = written(sets.select("id", "n", "sketch"), "nodes")
    bands = _bands(nodes)
    shared = written(bands.groupBy("key").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("m")).filter("m > 1")
                     .select("key", "least_id"), "shared")
    meeting = written(bands.join(shared, "key"), "meeting")  # key, id, band, least_id
    wanted = written(
        sets.select("id", F.col("best.doc_id").alias("_doc"), F.col("best.hash").alias("_hash"))
        .join(meeting.select("id").distinct(), "id", "left_semi"), "wanted")
    texts = written(
        # Never broadcast: the wanted rows grow with the documents. Texts go through one shuffle at every size.
        docs.join(wanted.hint("merge"), F.col("hash").eqNullSafe(F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
        .groupBy("id").agg(F.max("text").alias("text")), "texts")
    first = written(verified(_first_pairs(meeting, nodes, percent), texts, percent), "links")
    labels = components(first)
    groups = _open_groups(meeting, labels, nodes, percent)
    more = written(_open_links(groups, labels, texts, percent, WIDTH), "links")
    labels = components(labels.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more))
    linked = sets.select("id", "digest", "best").join(labels, "id", "left").select(
        "digest", "best", F.coalesce("component", "id").alias("component"))
    least = written(linked.groupBy("component").agg(F.min("best").alias("best")), "least")
    return signed, written(linked.select("digest", "component").join(least, "component").select("digest", "best"), "classes")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    signed, classes = _classes(docs, percent)
    none = F.col("best").isNull()
    kept = F.when(none, F.lit(True)).when(F.col("best.none"), F.col("hash") == F.col("best.hash")).otherwise(
        F.coalesce(F.col("doc_id") == F.col("best.doc_id"), F.lit(False)))
    return signed.select("doc_id", "hash", "n_shingles", "digest").join(classes, "digest", "left").select(
        "doc_id", "n_shingles", F.when(none, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        kept.alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row with the smallest doc_id, and of equal rows one.

    Rows without words are in no group; of those equal in doc_id and text one stays.
    """
    signed, classes = _classes(docs, percent)
    left = written(
        classes.select("best.doc_id", "best.hash").unionByName(signed.filter("n_shingles = 0").select("doc_id", "hash"))
        .distinct().select(F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash")), "left")
    rows = _hashed(docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long"), "text"))
    return (
        rows.join(left, F.col("hash").eqNullSafe(F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
        .dropDuplicates(["doc_id", "hash"]).select("_row.*"))


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, sides.b FROM reach JOIN sides ON reach.r = sides.a),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least ON doc_id = id LEFT JOIN sizes USING (doc_id)
"""
