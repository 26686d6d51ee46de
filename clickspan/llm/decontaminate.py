"""Benchmark decontamination by winnowing.

1. Windows. An item's windows are its runs of ``width`` words; an item with fewer words is one window.
2. Fingerprints. Of the k-word grams inside a window the one with the smallest hash, rightmost first, is the
   window's fingerprint. Equal windows have equal fingerprints, so a document that shares ``width`` words
   with an item shares a fingerprint with it, wherever the shared stretch stands: none is missed. Neighbouring
   windows mostly select the same gram, so there are far fewer fingerprints than words. Windows shorter than
   ``width`` are winnowed by their own size, over shorter grams where they have to be.
3. Join. The items' fingerprints set two bits each in a table of ``cells`` bits (8 MB by default, whatever
   the size of the benchmark); tasks that read documents drop fingerprints whose bits are unset, and the
   others are joined with the items' distinct fingerprints. A benchmark of very many windows fills the
   table: more fingerprints then reach the join, none is lost.
4. Extension. Each fingerprint that met is extended to the windows that selected it, and these are joined
   with the items' distinct windows by 128 hash bits. The distinct sides have one row per key and are
   written before the joins, so a passage that fills a third of the documents neither multiplies rows nor
   keeps adaptive execution from splitting its partition.

Documents that hold the same windows form one set, and the items of a set are listed once, however many
documents and items share a passage.

Cases: a null or blank text has no words and hits nothing; rows with equal or null ids are rows of their own;
an item without words has no window; an item without an id marks words, but is not listed; several items of
one id are listed once; an empty table of documents gives no row, an empty benchmark leaves all documents
clean. Very long texts are hashed piece by piece. Other columns of either table are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickspan.llm.batches import byte_texts
from clickspan.llm.hashing import BLOCK, blocks, window_hashes, word_hashes
from clickspan.llm.tables import table, written

#: Words of a gram, at most.
GRAM = 5
#: Bits of the table that documents are held against.
CELLS = 1 << 26
BITMAP = 1 << 15

_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_WINDOWS = "array<struct<at: int, h: bigint, g: bigint>>"


def pieces(text: bytes, size: int = BLOCK) -> list[bytes]:
    """``text`` cut between words, each piece at least ``size`` bytes long, the last one excepted."""
    out, begin = [], 0
    while len(text) - begin > size and (gap := _GAP.search(text, begin + size)):
        out.append(text[begin:gap.start()])
        begin = gap.start()
    return [*out, text[begin:]]


def hashed(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of texts: number of the first, word hashes in lower case, and where each text begins."""
    for begin, end in blocks(texts):
        if end - begin == 1:
            words = np.concatenate([word_hashes([p], True, _BETWEEN)[0] for p in pieces(texts[begin])])
            yield begin, words, np.array([0, len(words)])
        else:
            yield begin, *word_hashes(texts[begin:end], True, _BETWEEN)


def winnow(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``size`` words the place of its fingerprint; and the hash of the gram at each place."""
    gram = min(GRAM, size)
    values = window_hashes(words, gram, salt=size)
    places, span, choices = np.arange(len(values)), 1, size - gram + 1
    while span < choices:
        step = min(span, choices - span)
        left, right = places[:-step], places[step:]
        places = np.where(values[right] <= values[left], right, left)
        span += step
    return places, values


def _window_rows(words: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """128 bits of each window that begins at ``at``."""
    return [window_hashes(words, size, salt)[at].view(np.int64) for salt in (0, 1)]


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, size, gram, h, g) of every window of ``items`` (item_id, text), written."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, words, begins in hashed([t or b"" for t in byte_texts(batch.column(1))]):
                lengths = np.diff(begins)
                for size in np.unique(np.minimum(lengths, width)):
                    if not size:
                        continue
                    own = np.flatnonzero(lengths >= width if size == width else lengths == size)
                    at = np.concatenate([np.arange(begins[i], begins[i + 1] - size + 1) for i in own])
                    text = np.repeat(own, lengths[own] - size + 1)
                    places, values = winnow(words, int(size))
                    h, g = _window_rows(words, at, int(size))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(first + text)), pa.array(np.full(len(at), size, dtype=np.int32)),
                         pa.array(values[places[at]].view(np.int64)), pa.array(h), pa.array(g)],
                        ["item_id", "size", "gram", "h", "g"])

    rows = items.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return written(rows.mapInArrow(cut, "item_id string, size int, gram long, h long, g long"), "item-windows")


def gram_bits(grams: DataFrame, cells: int) -> bytes:
    """Two bits for each of ``grams``: ``cells / 8`` bytes."""
    mask = F.lit(cells - 1)
    cell = F.explode(F.array(F.col("gram").bitwiseAND(mask), F.shiftrightunsigned("gram", 32).bitwiseAND(mask)) ).alias("cell")
    parts = (
        grams.select(cell).select((F.col("cell") + 1).alias("cell"))
        .groupBy(F.bitmap_bucket_number("cell").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")))
    bits = bytearray(cells // 8)
    for row in parts.toLocalIterator():
        begin = (row["part"] - 1) * BITMAP // 8
        bits[begin:begin + BITMAP // 8] = row["bits"]
    return bytes(bits)


def fingerprints(docs: DataFrame, sizes: list[int], bits: bytes, cells: int) -> DataFrame:
    """Written rows of two kinds: (row, doc_id, n_words) for every document, (row, size, gram, windows) for every
    fingerprint of it whose bits are set, with the windows that selected it."""
    known = docs.sparkSession.sparkContext.broadcast(bits)
    schema = f"row long, doc_id long, n_words long, size int, gram long, windows {_WINDOWS}"
    names = ["row", "doc_id", "n_words", "size", "gram", "windows"]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(known.value, dtype=np.uint8)
        mask = np.uint64(cells - 1)

        def often(values: np.ndarray) -> np.ndarray:
            keep = np.ones(len(values), dtype=bool)
            for cell in (values & mask, (values >> np.uint64(32)) & mask):
                keep &= (table[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
            return keep

        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            counts = np.zeros(len(rows), dtype=np.int64)
            for first, words, begins in hashed([t or b"" for t in byte_texts(batch.column(2))]):
                lengths = np.diff(begins)
                counts[first:first + len(lengths)] = lengths
                for size in sizes:
                    if len(words) < size:
                        continue
                    places, values = winnow(words, size)
                    inside = np.ones(len(places), dtype=bool)
                    for end in begins[1:-1]:
                        inside[max(0, end - size + 1):end] = False
                    at = np.flatnonzero(inside)
                    at = at[often(values)[places[at]]]
                    if not len(at):
                        continue
                    text = np.searchsorted(begins, at, side="right") - 1
                    # Windows that follow each other and selected the same gram are one fingerprint.
                    cuts = np.flatnonzero(np.concatenate([[True], places[at][1:] != places[at][:-1]]))
                    h, g = _window_rows(words, at, size)
                    windows = pa.StructArray.from_arrays(
                        [pa.array((at - begins[text]).astype(np.int32)), pa.array(h), pa.array(g)], ["at", "h", "g"])
                    n = len(cuts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[first + text[cuts]]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                         pa.array(np.full(n, size, dtype=np.int32)), pa.array(values[places[at[cuts]]].view(np.int64)),
                         pa.ListArray.from_arrays(pa.array(np.append(cuts, len(at)).astype(np.int32)), windows)], names)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column(1), pa.array(counts), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()),
                 pa.nulls(n, pa.list_(pa.struct([("at", pa.int32()), ("h", pa.int64()), ("g", pa.int64())])))], names)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(rows.mapInArrow(find, schema), "fingerprints")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """What ``docs`` (doc_id, text) share with ``items`` (item_id, text).

    Two tables: a row for each document with doc_id, n_words, n_hit, windows (begin and end of every occurrence,
    in words) and items_set; and for each items_set its items, sorted as strings, and their number.
    """
    if cells % BITMAP or cells & (cells - 1):
        raise ValueError(f"cells must be a power of two and at least {BITMAP}")
    if width < 1:
        raise ValueError("width must be positive")
    of_items = item_windows(items, width)
    grams = written(of_items.select("size", "gram").distinct(), "grams")
    windows = written(of_items.select("size", "h", "g").distinct(), "windows")
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # ``width`` of them at most
    found = fingerprints(docs, sizes, gram_bits(grams, cells), cells)

    met = (
        found.filter("gram is not null").join(grams, ["size", "gram"], "left_semi")
        .select("row", "size", F.explode("windows").alias("_w")).select("row", "size", "_w.*")
        .join(windows, ["size", "h", "g"], "left_semi"))
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach"))
    verdict = written(
        met.groupBy("row").agg(
            F.array_sort(F.collect_set(F.struct(F.col("at").alias("begin"), (F.col("at") + F.col("size")).alias("end")))).alias("windows"),
            F.array_sort(F.collect_set(F.struct("size", "h", "g"))).alias("_set"))
        .withColumn("n_hit", F.aggregate("windows", start, lambda a, x: F.struct(
            (a["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["begin"], a["reach"]))).alias("hit"),
            F.greatest(a["reach"], x["end"]).alias("reach")), lambda a: a["hit"].cast("long")))
        .withColumn("items_set", F.sha2(F.to_json("_set"), 256)), "contaminated")
    sets = (
        verdict.groupBy("items_set").agg(F.first("_set").alias("_set"))
        .select("items_set", F.explode("_set").alias("_w")).select("items_set", "_w.*")
        .join(of_items.select("item_id", "size", "h", "g").distinct(), ["size", "h", "g"])
        .groupBy("items_set").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .withColumn("n_items", F.size("items").cast("long")))
    rows = (
        found.filter("gram is null").select("row", "doc_id", "n_words")
        .join(verdict.drop("_set"), "row", "left").drop("row")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))))
    return rows, sets


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sets = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digests = written(
        sets.select("items_set", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "item-sets")
    return rows.join(digests, "items_set", "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP11_SQL = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper_case, 'abcdefghijklmnopqrstuvwxyz' AS lower_case),
docs AS (
  SELECT row_number() OVER () AS id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), upper_case, lower_case), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents, letters),
items AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), upper_case, lower_case), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark, letters),
cut AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT *, least(10, len(w)) AS m FROM items WHERE len(w) > 0), unnest(range(1, len(w) - m + 2)) AS t(i)),
shown AS (
  SELECT id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM docs, (SELECT DISTINCT m FROM cut), unnest(range(1, len(w) - m + 2)) AS t(i)),
met AS (SELECT id, i, m, win FROM shown WHERE (m, win) IN (SELECT (m, win) FROM cut)),
hit AS (SELECT id, count(DISTINCT p) AS n_hit FROM met, unnest(range(i, i + m)) AS t(p) GROUP BY id),
named AS (SELECT DISTINCT id, item_id::VARCHAR AS item FROM met JOIN cut USING (m, win) WHERE item_id IS NOT NULL),
listed AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM named GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (id) LEFT JOIN listed USING (id)
"""
