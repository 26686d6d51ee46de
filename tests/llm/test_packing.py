import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clickspan.llm.packing import TextIds, WordIds, _default_tokenizer, pack, plan


def laid(counts, capacity):
    """Contents of the sequences of a plan, by position."""
    runs, sequences = plan(counts, capacity), {}
    for i, (length, first, sequence, each, token) in enumerate(runs):
        after = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else counts[length]
        for k in range(after - first):
            sequences.setdefault(sequence + k // each, []).append((token + k % each * length, length))
    return sequences


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=20), st.integers(40, 60))
@settings(max_examples=200, deadline=None)
def test_plan_is_gapless_and_fits(counts, capacity):
    sequences = laid(counts, capacity)
    for content in sequences.values():
        at = 0
        for place, length in sorted(content):
            assert place == at
            at += length
        assert at <= capacity
    assert sum(map(len, sequences.values())) == sum(counts.values())


def test_plan_is_close_to_the_bound():
    random.seed(1)
    counts = {}
    for _ in range(50_000):
        length = min(4096, max(1, int(random.lognormvariate(6.3, 1.1))))
        counts[length] = counts.get(length, 0) + 1
    bound = -(-sum(length * n for length, n in counts.items()) // 4096)
    assert len(laid(counts, 4096)) <= bound + 2


def test_large_pieces_pair(capacity=100):
    assert len(laid({60: 5, 40: 5}, capacity)) == 5
    assert len(laid({50: 6, 34: 3}, capacity)) == 5
    with pytest.raises(ValueError):
        plan({101: 1}, 100)


@pytest.fixture(scope="module")
def ids():
    return WordIds(_default_tokenizer())


@given(st.text(alphabet="aAéÉΣσς'’.,!? \t\n\x0b\x0c\r ́​中🙂Ⅷ½9s<|endoftext|>ßẞİ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_words_give_the_text_s_ids(ids, text):
    split = text.encode().split()
    ids.learn(set(split))
    got = np.frombuffer(b"".join(ids[w] for w in split), dtype="<u4").tolist()
    assert got == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_and_places(spark, ids):
    random.seed(2)
    texts = [" ".join(random.choices(["the", "of", "anblewh", "9", "É"], k=random.randint(0, 90))) for _ in range(300)]
    texts += [None, "", "the " * 9000, "x"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(7, "again the same", None)] * 2 + [(None, "no id", None)]
    found = pack(spark.createDataFrame(rows, "doc_id long, text string, length string")).collect()
    want = []
    for i, text, _ in rows:
        all_ids = ids.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(all_ids), 4096):
            part = np.array(all_ids[k:k + 4096], dtype="<u4")
            want.append((i, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[:5] for r in found], key=key) == sorted(want, key=key)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in sequences.values():
        at = 0
        for place, length in sorted(content):
            assert place == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r["length"] for r in found) // 4096) + 1


def test_other_tokenizers_encode_whole_texts(spark, ids):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert WordIds.fits(_default_tokenizer()) and not WordIds.fits(path)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    texts = ["The  Quick\tbrown\n\nfox ", None, "", " É<|endoftext|> ß", "x" * 20_000, "word " * 9_000]
    found = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer=path).collect()
    want = []
    for i, text in enumerate(texts):
        all_ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(all_ids), 4096):
            part = np.array(all_ids[k:k + 4096], dtype="<u4")
            want.append((i, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted(tuple(r)[:5] for r in found) == sorted(want)


def test_words_are_forgotten_and_learnt_again():
    few = WordIds(_default_tokenizer(), most=50)
    texts = [" ".join(f"wo{chr(97 + i % 26)}{chr(97 + i // 26)}rd{m}" for m in ("", ".", "!?")) for i in range(200)]
    whole = TextIds(_default_tokenizer())
    assert [x for at in range(0, 200, 7) for x in few.encode([t.encode() for t in texts[at:at + 7]])] == whole.encode([t.encode() for t in texts])


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
