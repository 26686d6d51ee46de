"""Substring deduplication: windows of words that occur anywhere else lose their words.

1. Count-min prefilter. Every window of ``width`` words is represented by its anchor: of the runs of
   ``ANCHOR`` words inside it the one with the smallest hash, leftmost first. Equal windows have equal
   anchors at places that differ, so the count of an anchor (places, each once) is never less than that of
   its windows, and there are about twelve times fewer anchors than windows. Each task counts its anchors
   in a sketch of ``depth`` rows; the sketches are merged slice by slice, with counts that stop at two.
   What the tasks read back is one bit per cell, ``depth * cells / 8`` bytes whatever the size of the
   corpus (16 MB by default). Beyond some billion words ``cells`` should grow with the corpus: a full
   sketch lets more windows through, never fewer.
2. Exact pass. Windows whose anchor is estimated at two or more are grouped by a 96-bit hash, counted with
   map-side combining, and those with a count of two or more are joined back to their places.
3. Each document loses the words that such windows cover.

Cases: a null or blank text has no words and the digest of the empty string; texts with fewer words than
the window lose nothing; rows that are equal in every column repeat each other's windows; a null doc_id is
kept as it is; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickspan.llm.batches import byte_texts, runs
from clickspan.llm.hashing import blocks, mix, window_hashes, word_hashes
from clickspan.llm.tables import table, written

ANCHOR = 12
SLICE = 1 << 16
#: Anchors that a task counts before it emits what it has.
HELD = 1 << 22


def anchors(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``width`` words the place of its anchor; and the hash of the run at each place."""
    size = min(ANCHOR, width)
    values = window_hashes(words, size)
    places = np.arange(len(values))
    span, choices = 1, width - size + 1
    while span < choices:
        step = min(span, choices - span)
        left, right = places[:-step], places[step:]
        places = np.where(values[left] <= values[right], left, right)
        span += step
    return places, values


def _windows(texts: list[bytes], width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: first and last text, word hashes, word offsets, and the windows inside one text."""
    for begin, end in blocks(texts):
        words, begins = word_hashes(texts[begin:end])
        inside = np.ones(max(0, len(words) - width + 1), dtype=bool)
        for at in begins[1:-1]:
            inside[max(0, at - width + 1):at] = False
        yield begin, end, words, begins, np.flatnonzero(inside)


def _cells(values: np.ndarray, row: int, cells: int) -> np.ndarray:
    return mix(values + np.uint64(0x9E3779B97F4A7C15 * (row + 1) % 2**64)) & np.uint64(cells - 1)


def sketch(docs: DataFrame, width: int, depth: int, cells: int) -> dict[int, bytes]:
    """Merged count-min sketch: by slice of cells, one bit per cell whose count is two or more."""
    if cells % SLICE or cells & (cells - 1):
        raise ValueError(f"cells must be a power of two and at least {SLICE}")

    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = np.concatenate(held)
        for row in range(depth):
            found, n = np.unique(_cells(values, row, cells), return_counts=True)
            part = (found // np.uint64(SLICE)).astype(np.int64)
            place = (found % np.uint64(SLICE)).astype(np.uint16)
            cuts = np.flatnonzero(np.diff(part)) + 1
            rows = [(row * (cells // SLICE) + int(p[0]), q[k == 1].tobytes(), q[k > 1].tobytes())
                    for p, q, k in zip(np.split(part, cuts), np.split(place, cuts), np.split(n, cuts))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.binary(), pa.binary()])], ["slice", "once", "more"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0
        for batch in batches:
            texts = [t or b"" for t in byte_texts(batch.column(0))]
            for _, _, words, _, inside in _windows(texts, width):
                if len(inside):
                    places, values = anchors(words, width)
                    # Along a text the places never go back: each counts once.
                    own = places[inside]
                    held.append(values[own[np.concatenate([[True], own[1:] != own[:-1]])]])
                    total += len(held[-1])
                if total >= HELD:
                    yield from emit(held)
                    held, total = [], 0
        if held:
            yield from emit(held)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.packbits(seen > 1).tobytes()])], ["slice", "bits"])

        last, seen = None, np.zeros(SLICE, dtype=np.uint8)
        for (key,), rows in runs(batches, ["slice"]):
            if key != last:
                if last is not None:
                    yield close()
                last, seen = key, np.zeros(SLICE, dtype=np.uint8)
            for once, more in zip(rows.column("once").to_pylist(), rows.column("more").to_pylist()):
                at = np.frombuffer(once, dtype=np.uint16)
                seen[at] = np.minimum(seen[at] + 1, 2)
                seen[np.frombuffer(more, dtype=np.uint16)] = 2
        if last is not None:
            yield close()

    parts = docs.select("text").mapInArrow(count, "slice int, once binary, more binary")
    merged = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, bits binary")
    return {r["slice"]: bytes(r["bits"]) for r in merged.collect()}


def repeated_windows(docs: DataFrame, width: int = 35, depth: int = 2, cells: int = 1 << 26) -> DataFrame:
    """(key, at): the windows of ``docs`` (key, text) whose words also start anywhere else, by first word."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(sketch(docs, width, depth, cells))
    slices = cells // SLICE

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = bytes(SLICE // 8)
        rows = [np.frombuffer(b"".join(bits.value.get(r * slices + s, blank) for s in range(slices)), dtype=np.uint8)
                for r in range(depth)]

        def often(values: np.ndarray) -> np.ndarray:
            keep = np.ones(len(values), dtype=bool)
            for r in range(depth):
                cell = _cells(values, r, cells).astype(np.int64)
                keep &= (rows[r][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
            return keep

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [t or b"" for t in byte_texts(batch.column(1))]
            for begin, _, words, begins, inside in _windows(texts, width):
                if not len(inside):
                    continue
                places, values = anchors(words, width)
                at = inside[often(values)[places[inside]]]
                if not len(at):
                    continue
                h, g = window_hashes(words, width)[at], window_hashes(words, width, salt=1)[at]
                text = np.searchsorted(begins, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[begin + text]), pa.array((at - begins[text]).astype(np.int32)),
                     pa.array(h.view(np.int64)), pa.array((g >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                    ["key", "at", "h", "g"])

    found = docs.select("key", "text").mapInArrow(candidates, "key long, at int, h long, g int")
    # Written first: the places of a very common window then stand on a side that adaptive execution can split.
    repeated = written(
        found.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "g"), "repeated")
    return found.join(repeated, ["h", "g"]).select("key", "at")


def without_repeats(docs: DataFrame, width: int = 35, depth: int = 2, cells: int = 1 << 26) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, n_words, n_removed, kept_text."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("key", F.xxhash64("doc_id", "text"))
    places = repeated_windows(rows, width, depth, cells).groupBy("key").agg(F.collect_set("at").alias("at"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, at in zip(byte_texts(batch.column("text")), batch.column("at")):
                words = (text or b"").split()
                counts.append(len(words))
                if at.is_valid:
                    begin = at.values.to_numpy()
                    change = np.zeros(len(words) + 1, dtype=np.int32)
                    change[begin] += 1
                    change[begin + width] -= 1  # the places are distinct
                    keep = np.cumsum(change[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    joined = rows.join(places, "key", "left").select("doc_id", "text", "at")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT id, i, md5(array_to_string(w[i:i + 34], ' ')) AS win FROM words, unnest(range(1, len(w) - 33)) AS t(i)),
again AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY win) AS c FROM windows) WHERE c > 1),
placed AS (SELECT id, doc_id, i, w[i] AS word FROM words, unnest(range(1, len(w) + 1)) AS t(i)),
covered AS (
  SELECT id, i, max(last) OVER (PARTITION BY id ORDER BY i) AS last
  FROM placed LEFT JOIN (SELECT id, i, i + 34 AS last FROM again) USING (id, i)),
kept AS (
  SELECT id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM placed JOIN covered USING (id, i) WHERE last IS NULL OR last < i GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (id)
"""
