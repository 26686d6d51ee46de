"""Language identification by family first, then by one-versus-one linear support vector machines.

Languages belong to families (a parameter; a language that no family names is a family of its own). One
machine per pair of families decides the family by votes, then one per pair of its languages decides the
language. A text is described by the relative frequencies of its byte 2-, 3- and 4-grams (lower-cased
letters, everything else a space), hashed into ``DIMENSIONS``; a machine's margin is then the mean of its
weights over all n-grams of the whole text, which needs no vector per text.

Machines are learnt on at most ``per_language`` documents of each language (the smallest by hash) and four
examples of each: the whole text and three windows, so that short texts are known too. Each machine is
trained in a task of its own by stochastic subgradient steps on the hinge loss with averaging.

The score is 1 / (1 + exp(-2 m)), m the smallest margin by which the chosen family and language won.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when there is
nothing to learn from; with one language only it is always predicted, with score 1; null languages are not
learnt from, nor are texts without a letter; a null doc_id is never held out, and rows with null or repeated ids
are learnt from like others, equal rows once; equal rows give equal results; a very long text is described by all
of its n-grams; other columns are ignored, clashing ones too; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickspan.llm.hashing import blocks
from clickspan.llm.tables import table

#: Families of common languages (fixed values).
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "indic": ["hi", "bn", "mr", "ne", "pa", "gu", "ur", "si"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tt"],
    "uralic": ["fi", "et", "hu"],
    "baltic": ["lt", "lv"],
    "sinitic": ["zh", "yue", "wuu"],
    "semitic": ["ar", "he", "mt", "am"],
}
ORDERS = (2, 3, 4)
DIMENSIONS = 1 << 14
WINDOWS = (60, 160, 500)
MOST_BROADCAST = 1_000_000
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashed n-grams of all texts in a row, and the text of each."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    clean = np.where(_LETTER[data], data, 32).astype(np.uint32)
    # A space after a space tells nothing: n-grams that begin there are left out.
    told = np.ones(len(clean), dtype=bool)
    told[:-1] = (clean[:-1] != 32) | (clean[1:] != 32)
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    code = clean.copy()
    for n in range(2, max(ORDERS) + 1):
        code = code[:-1] * np.uint32(257) + clean[n - 1:]
        if n in ORDERS:
            mixed = (code ^ np.uint32(n * 0x9E3779B9 % 2**32)) * np.uint32(0x85EBCA6B)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            # n-grams that reach over the end of their text are left out.
            at = np.flatnonzero(told[:min(len(code), len(owner))])
            at = at[at + n <= begins[owner[at] + 1] + 1]
            yield (mixed[at] >> np.uint32(18)).astype(np.int64), owner[at]


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indices and relative frequencies of each text's n-grams."""
    parts = list(_grams(texts))
    index, owner = (np.concatenate(p) for p in zip(*parts))
    key, n = np.unique(owner * DIMENSIONS + index, return_counts=True)
    cuts = np.searchsorted(key, np.arange(1, len(texts)) * DIMENSIONS)
    return [(k % DIMENSIONS, c / max(1, c.sum())) for k, c in zip(np.split(key, cuts), np.split(n, cuts))]


def margins(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Mean weight of each text's n-grams for each machine (columns of ``weights``)."""
    total, count = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for index, owner in _grams(texts):
        count += np.bincount(owner, minlength=len(texts))
        for machine in range(weights.shape[1]):
            total[:, machine] += np.bincount(owner, weights=weights[index, machine], minlength=len(texts))
    return total / np.maximum(count, 1)[:, None]


def train(labels: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray]], rounds: int = 12, decay: float = 1e-4) -> np.ndarray:
    """Weights of a linear machine on examples of unit length, averaged over the second half of the steps."""
    order = np.random.Generator(np.random.PCG64(5))
    weights, average, taken, scale, step = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0, 1.0, 0
    vectors = [(i, v / max(1e-12, float(np.sqrt((v * v).sum())))) for i, v in examples]
    balance = {y: len(labels) / (2 * max(1, int((labels == y).sum()))) for y in (-1, 1)}
    steps = rounds * len(labels)
    for _ in range(rounds):
        for at in order.permutation(len(labels)):
            index, value = vectors[at]
            rate = 1.0 / (1 + decay * 10 * step)
            scale *= 1 - rate * decay
            if labels[at] * scale * float(weights[index] @ value) < 1:
                np.add.at(weights, index, rate * labels[at] * balance[int(labels[at])] / scale * value)
            step += 1
            if 2 * step > steps and step % 50 == 0:
                average += scale * weights
                taken += 1
    return average / taken if taken else scale * weights


def family_of(language: str, families: dict[str, list[str]]) -> str:
    return next((f for f, members in families.items() if language in members), f"own:{language}")


def _votes(names: list[str], wins: dict[tuple[str, str], float]) -> tuple[str, float]:
    """The name with most pairwise wins (then the larger sum of margins) and its smallest margin."""
    if len(names) == 1:
        return names[0], np.inf
    own = {a: [m if a == x else -m for (x, y), m in wins.items() if a in (x, y)] for a in names}
    best = max(names, key=lambda a: (sum(m > 0 for m in own[a]), sum(own[a]), a))
    return best, min(own[best])


def learn(docs: DataFrame, learnable: Column, families: dict[str, list[str]] | None = None,
          per_language: int = 300) -> tuple[dict[str, list[str]], list[tuple[str, str, str]], np.ndarray]:
    """Languages by family, machines (group, first, second) and their weights, from the rows ``learnable``."""
    families = families or FAMILIES
    # Rows are told apart by id and text together, for ids may be null or repeat.
    rows = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn(
        "_key", F.xxhash64("doc_id", "text"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("_key"))
    chosen = rows.select("_key", "lang").withColumn("_n", place).filter(F.col("_n") <= per_language).drop("_n").distinct()
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    known: dict[str, list[str]] = {}
    for language in languages:
        known.setdefault(family_of(language, families), []).append(language)
    machines = [("", a, b) for a, b in combinations(sorted(known), 2)]
    machines += [(family, a, b) for family in sorted(known) for a, b in combinations(known[family], 2)]
    if not machines:
        return known, machines, np.zeros((DIMENSIONS, 0))

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, lang, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")]):
                whole = lowered(text)
                order = np.random.Generator(np.random.PCG64(abs(int(doc_id or 0))))
                texts = [whole]
                for size in WINDOWS:
                    at = int(order.integers(0, max(1, len(whole) - size)))
                    texts.append(whole[at:at + size])
                found = [(i, v) for i, v in features(texts) if len(i)]
                family = family_of(lang, families)
                rows = []
                for number, (group, a, b) in enumerate(machines):
                    name = lang if group else family
                    if name in (a, b) and group in ("", family):
                        rows += [(number, 1 if name == a else -1, i, v) for i, v in found]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64())])],
                        ["machine", "label", "at", "value"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        # The order of rows in a group varies from run to run: sorting makes the weights repeatable.
        group = group.assign(_k=[(int(y), a.tobytes(), v.tobytes()) for y, a, v in zip(group["label"], group["at"], group["value"])])
        group = group.sort_values("_k")
        weights = train(group["label"].to_numpy(), list(zip(group["at"], group["value"])))
        return pd.DataFrame({"machine": [int(group["machine"].iloc[0])], "weights": [weights]})

    # At most per_language ids a language: broadcast up to a bound, so that texts are not shuffled for it.
    small = F.broadcast(chosen) if per_language * len(languages) <= MOST_BROADCAST else chosen
    sample = rows.join(small, ["_key", "lang"], "left_semi").dropDuplicates(["_key", "lang"])
    examples = sample.select("doc_id", "lang", "text").mapInArrow(
        describe, "machine int, label int, at array<long>, value array<double>")
    weights = np.zeros((DIMENSIONS, len(machines)))
    for row in examples.groupBy("machine").applyInPandas(fit, "machine int, weights array<double>").collect():
        weights[:, row["machine"]] = row["weights"]
    return known, machines, weights


def predict(docs: DataFrame, known: dict[str, list[str]], machines: list[tuple[str, str, str]], weights: np.ndarray,
            keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score, from the whole of ``text``."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("text").to_pylist()
            texts = [lowered(t) for t in whole]
            for begin, end in blocks(texts):
                found = margins(texts[begin:end], model.value)
                names, scores = [], []
                for text, values in zip(whole[begin:end], found):
                    if not known or not has_letter(text):
                        names.append("und")
                        scores.append(0.0)
                        continue
                    family, one = _votes(sorted(known), {(a, b): v for (g, a, b), v in zip(machines, values) if not g})
                    language, two = _votes(known[family], {(a, b): v for (g, a, b), v in zip(machines, values) if g == family})
                    names.append(language)
                    scores.append(float(1 / (1 + np.exp(-np.clip(2 * SHARPNESS * min(one, two), -50, 50)))))
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    [*keep, "lang_pred", "score"])

    slim = docs.select(*keep, "text")
    return slim.mapInArrow(name, slim.drop("text").schema.add("lang_pred", "string").add("score", "double"))


#: Margins of whole texts are means over many n-grams and small; this brings them to the scale of the hinge.
SHARPNESS = 20.0


def identify(docs: DataFrame, learnable: Column, keep: list[str], families: dict[str, list[str]] | None = None,
             per_language: int = 300) -> DataFrame:
    """Learn from the rows ``learnable`` and predict every row of ``docs`` (doc_id, text, lang)."""
    return predict(docs, *learn(docs, learnable, families, per_language), keep)


def op1_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang").withColumn("held_out", held_out)
    return identify(docs, ~F.col("held_out"), ["doc_id", "held_out"])
