"""Best-fit packing with large-item matching.

Documents become token pieces of at most ``capacity`` tokens. Which sequence a piece goes to depends on its
length alone, so the packing is planned on the number of pieces of each length, at most ``capacity``
numbers however many documents there are:

1. Of pieces above a third of the capacity at most two fit in a sequence. They are matched greedily, from
   the longest down, each with the longest other one that still fits; the rest begin a sequence alone.
2. Shorter pieces, from the longest down, go to the sequences with the smallest gap that holds them, and
   begin new sequences when no gap does.

The plan is a list of runs: pieces number a to b of a length go into sequences from s on, c in each, from
token o. A step uses up a length or a group of like sequences, so the plan has a few rows per length.
Pieces are numbered within their length by (length, salt) counts, so that no length meets in one task.

Cases: a null or empty text is the end token alone; equal rows are packed each on its own; a null doc_id is
kept; an empty table gives no row. Strings of special tokens inside a text count as ordinary text.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickspan.llm.batches import byte_texts
from clickspan.llm.tables import table, written

if TYPE_CHECKING:
    from tokenizers import Tokenizer

END = (1).to_bytes(4, "little")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _opened(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are then ordinary text
    return tokenizer


class TextIds:
    """Token ids of whole texts as little-endian 32-bit numbers, by any tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = _opened(path)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]


class WordIds(dict):
    """Token ids by words, for a tokenizer that drops white space and never joins what it divides.

    A text's ids are then those of its words in a row. A new word of plain letters and marks is looked up by its
    two parts, in lower case; new parts are encoded together, divided by white space alone since nothing else
    divides them, and told apart by the tokens that end a part. All other words are encoded one by one.
    Words and parts are forgotten when there are ``most`` of them.
    """

    PLAIN = re.compile(r"([a-zß-öø-ÿ]*)([.,!?;:#%&$*|]*)")

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.most = most
        self.tokenizer = _opened(path)
        self.divided = Tokenizer(self.tokenizer.model)
        self.divided.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.parts: dict[str, bytes] = {"": b""}
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True

    @staticmethod
    def fits(path: str) -> bool:
        """Whether the file says that the tokenizer is of that kind: lower case, words divided and white space dropped
        before anything else, bytes as letters, and tokens that end a word marked."""
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        steps = (told.get("normalizer") or {}).get("normalizers") or []
        before = (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
        return (
            [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in before] == ["Split", "ByteLevel"]
            and before[0]["behavior"] == "Removed" and before[0]["invert"] and not before[1]["add_prefix_space"]
            and before[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and (told.get("model") or {}).get("end_of_word_suffix") == "</w>")

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # bytes.split() divides at ASCII white space only.
        split = [text.split() for text in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.__getitem__, words)) for words in split]

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _learn_parts(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.parts]
        for at in range(0, len(new), 500):
            some = new[at:at + 500]
            ids = np.array(self.divided.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(some):
                data = ids.tobytes()
                self.parts.update(zip(some, [data[i:j] for i, j in zip([0, *cuts], cuts)]))
            else:
                self.parts.update(zip(some, self._encode(some)))

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            self.parts = {"": b""}
            new = words
        # Lists of strings, not of tuples: these would make the collector of cycles walk through all known words.
        plain, letters, marks, other, match = [], [], [], [], self.PLAIN.fullmatch
        for word in new:
            both = match(word.decode().lower())
            if both:
                plain.append(word)
                letters.append(both[1])
                marks.append(both[2])
            else:
                other.append(word)
        parts = set(letters)
        parts.update(marks)
        self._learn_parts(parts)
        known = self.parts
        self.update(zip(plain, [known[a] + known[b] if b else known[a] for a, b in zip(letters, marks)]))
        self.update(zip(other, self._encode([w.decode() for w in other])))


@functools.lru_cache(maxsize=1)
def _ids(path: str) -> WordIds | TextIds:
    return WordIds(path) if WordIds.fits(path) else TextIds(path)


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the CRC-32 of its ids.

    ``tokenizer`` is a tokenizer file that every executor has; by default the installed public one. One whose file
    doesn't promise that words can be encoded apart encodes whole texts.
    """
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(tokenizer or _default_tokenizer())
        for batch in batches:
            rows: list[tuple] = []
            texts = byte_texts(batch.column(1))
            for at in range(0, len(texts), 128):
                for doc_id, data in zip(batch.column(0).slice(at, 128).to_pylist(), ids.encode([t or b"" for t in texts[at:at + 128]])):
                    data += END
                    for k, begin in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[begin:begin + 4 * capacity]
                        rows.append((doc_id, k, begin // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first number, first sequence, pieces per sequence, first token) by length and number."""
    left = {length: n for length, n in sorted(counts.items(), reverse=True) if n > 0}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    numbered = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # by gap: first sequence and number of sequences
    order: list[int] = []  # the gaps, ascending
    sequences = 0

    def put(length: int, first: int, bins: int, each: int, token: int) -> None:
        runs.append((length, numbered[length], first, each, token))
        numbered[length] += bins * each
        left[length] -= bins * each

    def leave(gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, bins))

    large = sorted(length for length in left if 3 * length > capacity)
    for longest in reversed(large):
        while left[longest]:
            at = bisect.bisect_right(large, min(longest, capacity - longest)) - 1
            while at >= 0 and left[large[at]] < 1 + (large[at] == longest):
                at -= 1
            if at < 0:
                bins = left[longest]
                put(longest, sequences, bins, 1, 0)
                leave(capacity - longest, sequences, bins)
            else:
                other = large[at]
                bins = left[longest] // 2 if other == longest else min(left[longest], left[other])
                if other == longest:
                    put(longest, sequences, bins, 2, 0)
                else:
                    put(longest, sequences, bins, 1, 0)
                    put(other, sequences, bins, 1, longest)
                leave(capacity - longest - other, sequences, bins)
            sequences += bins

    for length in [x for x in left if 3 * x <= capacity]:
        while left[length]:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                gap, first, bins = capacity, sequences, max(1, left[length] // each)
                sequences += bins
            else:
                gap = order[at]
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
                each = gap // length
            full = min(bins, left[length] // each)
            if full:
                put(length, first, full, each, capacity - gap)
                leave(gap - each * length, first, full)
            elif left[length]:
                rest = left[length]
                put(length, first, 1, rest, capacity - gap)
                leave(gap - rest * length, first, 1)
                full = 1
            leave(gap, first + full, bins - full)
    return sorted(runs)


def packed(cut: DataFrame, capacity: int = 4096, salts: int = 32) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``cut`` has ``length`` and is read several times."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(plan(counts, capacity), dtype=np.int64).reshape(-1, 5)
    key = ["length", "_salt"]
    rows = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    carries = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).select(
        *key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy(*key).orderBy("doc_id", "piece"))
    numbered = rows.join(carries, key).withColumn("_number", F.col("_before") + place - 1).drop("_salt", "_before")

    def lay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Runs are sorted by (length, first number): a piece belongs to the last run at or before it.
        begins = {int(length): int(at) for length, at in zip(*np.unique(runs[:, 0], return_index=True))}
        ends = {length: at for length, at in zip(begins, [*list(begins.values())[1:], len(runs)])}
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("_number").to_numpy(zero_copy_only=False)
            run = np.empty(len(length), dtype=np.int64)
            for one in np.unique(length):
                of = length == one
                begin, end = begins[int(one)], ends[int(one)]
                run[of] = begin + np.searchsorted(runs[begin:end, 1], number[of], side="right") - 1
            _, first, sequence, each, token = runs[run].T if len(run) else np.zeros((5, 0), dtype=np.int64)
            inside = number - first
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence + inside // np.maximum(each, 1)),
                 pa.array(token + inside % np.maximum(each, 1) * length)],
                [*names, "sequence_id", "offset"])

    names = [f.name for f in cut.schema]
    schema = numbered.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return numbered.select(*names, "_number").mapInArrow(lay, schema)


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """Documents (doc_id, text) cut and packed: one row per piece."""
    return packed(written(pieces(docs, capacity, tokenizer), "pieces"), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
