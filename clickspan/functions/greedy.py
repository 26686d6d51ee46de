"""Greedy selection along a key: a row is kept when its floor is not before the last kept row.

With rows in order of ``pos``, row j may follow row i when ``floor[j] >= pos[i]``. A cooldown is of that kind
(floor = time - wait), and so are conversions that start over (floor = just before the chain's start). What
is kept depends on all rows before, yet only through one number, the position of the last kept row. So

1. every (key, block of positions) becomes a map from the number that enters it to the number that leaves it:
   a row's successor is the first one whose floor allows it, and successors of successors are taken by pointer
   jumping until they leave the block. The map is a step function with few steps, one for every row that
   can be the first one kept;
2. the maps of a key are applied one after the other, one slim row per block;
3. each block marks its kept rows, starting from its own entry.

No task sees more than one block of a key's rows. Successors are data-dependent jumps, which window functions
can't follow, so steps 1 to 3 read Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Run = tuple[str, int, np.ndarray, np.ndarray, "int | None"]


def _runs(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list]]:
    """Stretches of equal (key, block) of sorted batches, with numpy columns ``names``; each stretch once."""
    held, own = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, blocks = batch.column("_key"), batch.column("_block").to_numpy()
        codes = keys.dictionary_encode().indices.to_numpy()
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            now = (keys[begin].as_py(), int(blocks[begin]))
            if now != held:
                if own:
                    yield held, [np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*own)]
                held, own = now, []
            own.append([c[begin:end] for c in columns])
    if own:
        yield held, [np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*own)]


def step_map(pos: np.ndarray, floor: np.ndarray, begin: int) -> tuple[list[int], list[int]]:
    """Map of a block that begins at ``begin``: an entry up to limits[i], and over limits[i - 1], leaves as exits[i];
    a larger one leaves as it came."""
    if len(pos) == 1:
        return floor.tolist(), pos.tolist()
    highest = np.maximum.accumulate(floor)
    follows = np.searchsorted(highest, pos)  # the first row whose floor is at or after this one
    last = np.where(follows < len(pos), follows, np.arange(len(pos)))
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    limits, first = np.unique(highest, return_index=True)
    # Entries come from before the block: of the limits that all of them meet only the first counts.
    most = int(np.searchsorted(limits, begin - 1)) + 1
    limits, exits = limits[:most], pos[last[first[:most]]]
    keep = np.append(exits[1:] != exits[:-1], True)
    return limits[keep].tolist(), exits[keep].tolist()


def walk(pos: np.ndarray, floor: np.ndarray, entry: int | None) -> list[int]:
    """Indices of the kept rows of a block."""
    highest = np.maximum.accumulate(floor)
    at = 0 if entry is None else int(np.searchsorted(highest, entry))
    kept, follows = [], np.searchsorted(highest, pos).tolist()
    while at < len(pos):
        kept.append(at)
        at = follows[at]
    return kept


def greedy(rows: DataFrame, keys: Sequence[str], pos: str, floor: str, length: int) -> DataFrame:
    """Kept rows as (``_key``, *keys*, ``pos``, ``floor``, ``_before``): the last kept position before, null for the first.

    ``rows`` has one row per key and position, both columns bigint; a floor at or above its own position counts as just
    below it. ``_key`` tells keys apart, nulls included. Blocks have ``length`` positions.
    """
    keys = list(keys)
    placed = rows.select(
        F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key"),
        F.floor(F.col(pos) / F.lit(length)).cast("bigint").alias("_block"),
        F.col(pos).alias("_pos"), F.least(F.col(floor), F.col(pos) - 1).alias("_floor"))
    dealt = placed.repartition("_key", "_block")

    def summarize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for (key, block), (at, low) in _runs(batches, ["_pos", "_floor"]):
            found.append((key, block, *step_map(at, low, block * length)))
            if len(found) == 10_000:
                yield _rows(found, MAPS)
                found = []
        yield _rows(found, MAPS)

    def carry(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = None, None
        for batch in batches:
            entries = []
            for key, limits, exits in zip(*(batch.column(n).to_pylist() for n in ("_key", "limits", "exits"))):
                if key != known:
                    known, last = key, None
                entries.append(last)
                at = 0 if last is None else bisect_left(limits, last)
                last = exits[at] if at < len(exits) else last
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("_block"), pa.array(entries, pa.int64())], ["_key", "_block", "_entry"])

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for (key, _), (at, low, entry) in _runs(batches, ["_pos", "_floor", "_entry"]):
            before = None if np.isnan(float(entry[0])) else int(entry[0])
            for i in walk(at, low, before):
                found.append((key, int(at[i]), int(low[i]), before))
                before = int(at[i])
            if len(found) >= 10_000:
                yield _rows(found, KEPT)
                found = []
        yield _rows(found, KEPT)

    order = ["_key", "_block", "_pos"]
    maps = dealt.sortWithinPartitions(*order).mapInArrow(summarize, "_key string, _block bigint, limits array<bigint>, exits array<bigint>")
    entries = maps.repartition("_key").sortWithinPartitions("_key", "_block").mapInArrow(
        carry, "_key string, _block bigint, _entry bigint")
    # An entry is null for the first block of a key; as a double it is exact up to 2 ** 53.
    entered = dealt.join(entries.withColumn("_entry", F.col("_entry").cast("double")), ["_key", "_block"])
    kept = entered.sortWithinPartitions(*order).mapInArrow(mark, "_key string, _pos bigint, _floor bigint, _before bigint")
    struct = rows.select(*keys).schema
    return kept.select(
        "_key", F.from_json("_key", struct).alias("_k"), F.col("_pos").alias(pos), F.col("_floor").alias(floor), "_before",
    ).select("_key", "_k.*", pos, floor, "_before")


MAPS = pa.schema([("_key", pa.string()), ("_block", pa.int64()), ("limits", pa.list_(pa.int64())), ("exits", pa.list_(pa.int64()))])
KEPT = pa.schema([("_key", pa.string()), ("_pos", pa.int64()), ("_floor", pa.int64()), ("_before", pa.int64())])


def _rows(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
