import hashlib
import random

import pytest

from clickspan.llm.pii import KINDS, personal_data, redacted
from tests.llm import brute


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, base string")
    return {r["doc_id"]: r for r in personal_data(df).collect()}


def spans(items):
    return [(s["kind"], s["start"], s["end"]) for s in items]


def test_base_against_brute_force(spark):
    random.seed(3)
    alphabet = list("abZ09..@@++--  ()%_é🙂1234567890123456789\n") + ["+1 (555) ", "a@b.c ", "4111111111111111 "]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 100))) for _ in range(1500)]
    texts += [None, "", "4111 1111 1111 1111 " * 300, "a@b.co " * 300 + "x" * 30_000, "1" * 5000, "1.2.3.4 " * 900,
              "a@b.c_d@e.f.g@h.i 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 +1+2"]
    got = found(spark, list(enumerate(texts)))
    for i, text in enumerate(texts):
        assert spans(got[i]["base"]) == brute.entities(text), repr(text)[:100]


def context_rows():
    rows = [(i, f"filler words here my phone is +49 30 1234{i:03d}5 and more text") for i in range(10)]
    rows += [(100 + i, f"some other words my phone is 030-12345{i}6 thanks") for i in range(5)]
    rows += [(200, "order number 123456789 total"), (201, "again 030-1234506 shows up"), (202, "the code 7654321 of the day")]
    return rows + [(300 + i, f"the code is here of the {i}") for i in range(20)]


def test_patterns_discover_unseen_identifiers(spark):
    rows = context_rows()
    got = found(spark, rows)
    texts = dict(rows)
    for i in range(100, 105):
        assert [texts[i][a:b] for _, a, b in spans(got[i]["added"])] == [f"030-12345{i - 100}6"]
        assert got[i]["added"][0]["kind"] == "phone"
    assert spans(got[201]["added"]) == [("phone", 6, 17)]  # known from its pattern, found without it
    assert not any(got[i]["added"] for i in (200, 202, *range(10), *range(300, 320)))


def test_patterns_without_base_entity_are_reached_over_instances(spark):
    rows = [(i, f"filler words here my phone is +49 30 1234{i:03d}5 and more text") for i in range(10)]
    rows += [(100 + i, f"some other words my phone is 030-12345{i}6 thanks") for i in range(5)]
    # "reach me" reaches its confidence only when that of "phone is" has come near 1.
    rows += [(200 + i, f"you can reach me 030-12345{i}6 any day") for i in range(5)]
    rows += [(300 + i, f"you can reach me 040-98765{i}1 any day") for i in range(4)]
    # A chain of patterns, each known by the numbers new after the one before.
    for k in range(6):
        new = [f"040-98765{i}1" if k == 0 else f"05{k}-11122{i}" for i in range(4)]
        rows += [(1000 + 100 * k + 10 * j + i, f"then word{k} link{k} {x} too") for j in range(2) for i, x in enumerate(new)]
        rows += [(1050 + 100 * k + i, f"then word{k} link{k} 05{k + 1}-11122{i} too") for i in range(4)]
    rows += [(5000 + i, f"the item code 77{i}-55555 is sold") for i in range(5)]
    got, texts = found(spark, rows), dict(rows)
    for i, text in rows:
        want = [] if i < 100 or i >= 5000 else [next(w for w in text.split() if sum(c.isdigit() for c in w) >= 5)]
        assert [text[a:b] for _, a, b in spans(got[i]["added"])] == want, text
        assert all(s["kind"] == "phone" for s in got[i]["added"])


def test_identifiers_in_groups(spark):
    grouped = ["030 1234 5678", "(030) 123 4567", "4111 1111 1111 1112", "(555) 010-9999", "030-1234567", "01 23 45"]
    rows = [(i, f"filler words here my phone is +49 30 1234{i:03d}5 and more text") for i in range(40)]
    rows += [(100 + i, f"some other words my phone is {x}{end}") for i, (x, end) in enumerate(zip(grouped, [" thanks", ".", ", or", "", " 3rd", " 12:30"]))]
    # Not in one run: two blanks, a line end, a group with letters; and too few digits.
    apart = [("030 12345  678901", "030 12345"), ("12345\n67890", "12345"), ("12345 6x", "12345"), ("12 34 of", None)]
    rows += [(200 + i, f"some other words my phone is {x}") for i, (x, _) in enumerate(apart)]
    # Groups beside a base entity: the run that is none stays a candidate.
    rows += [(300, "some other words my phone is 030-1234506 10.0.0.1 now"), (301, "my phone is (12345) 4111 1111 1111 1111 now")]
    rows += [(400, "1 2 " * 9000), (401, "1 2 3 4 5 " * 9000 + "x"), (402, "(1) " * 9000 + "x " * 9000)]
    got, texts = found(spark, rows), dict(rows)
    text = lambda i: [texts[i][s["start"]:s["end"]] for s in got[i]["added"]]
    assert [text(100 + i) for i in range(6)] == [[x] for x in grouped]
    assert [text(200 + i)[:1] for i in range(4)] == [[x] if x else [] for _, x in apart]
    assert text(300) == ["030-1234506"] and spans(got[300]["base"]) == [("ip", 41, 49)]
    assert text(301) == ["(12345"]


def test_repeated_rows_discover_the_same(spark):
    rows = context_rows()
    rows = [(i, t, "clash") for i, t in rows + [(None, "here my phone is 030-9876543 so")]]
    schema = "doc_id long, text string, base string"
    one, three = (personal_data(spark.createDataFrame(r, schema)).collect() for r in (rows, rows * 2 + rows[:7] * 5 + rows))
    want = {(r["doc_id"], r["text"]): spans(r["added"]) for r in one}
    assert sum(map(bool, want.values())) == 7
    assert len(three) == 3 * len(one) + 35
    assert all(spans(r["added"]) == want[r["doc_id"], r["text"]] for r in three)


def test_common_words_are_no_pattern(spark):
    rows = [(i, f"we speak of the +1 555 12345{i:02d} line") for i in range(10)]
    rows += [(100 + i, "out of the blue of the moon of the day") for i in range(20)] + [(200, "of the 1234567 ones")]
    assert not found(spark, rows)[200]["added"]


def test_redaction(spark):
    rows = [(1, "mail a@b.co now", 15), (2, None, None), (3, "", 0), (4, "no data", 7), (5, "🙂 +1 (555) 123-4567 or 1.2.3.4", 0),
            (6, "4111111111111111@x.org", 22)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in redacted(df).collect()}
    assert got[1] == ("mail [EMAIL] now", 16)
    assert got[2][0] is None and got[3] == ("", 0) and got[4] == ("no data", 7)
    assert got[5][0] == "🙂 [PHONE] or [IP]"
    assert got[6][0] == "[CARD]" or got[6][0] == "[EMAIL]"


def test_redaction_of_many_spans(spark):
    random.seed(8)
    texts = []
    for n in (1, 63, 64, 65, 128, 300):
        pieces = []
        for i in range(n):
            pieces.append(random.choice(["🙂 word", "", "ä b", "x" * 90]))
            pieces.append(random.choice([f"u{i}@mail.example.org", f"10.0.{i % 256}.7", "+1 (555) 123-4567", "4111111111111111@x.org"]))
        texts.append(" ".join(pieces))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places = {r["doc_id"]: sorted((s["start"], s["end"], s["kind"]) for s in [*r["base"], *r["added"]]) for r in personal_data(df).collect()}
    got = {r["doc_id"]: r["text"] for r in redacted(df).collect()}
    for d, text in enumerate(texts):
        want, reach = "", 0
        for start, end, kind in places[d]:
            if start >= reach:
                want += text[reach:start] + f"[{kind.upper()}]"
            reach = max(reach, end)
        assert got[d] == want + text[reach:]


def test_words_longer_than_the_reach(spark):
    """A pattern's words are whole, however long; else it never meets its count in the corpus."""
    long = "w" * 150
    rows = [(i, f"and {long} code a{i}@mail.example.org") for i in range(4)] + [(9, f"then {long} code 77123-45x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    added = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["added"]] for r in personal_data(df).collect()}
    begin = len(f"then {long} code ")
    assert added == {**dict.fromkeys(range(4), []), 9: [(begin, begin + 9, "email")]}


def test_repeated_rows_missing_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a@b.co")] * 3 + [(None, "1.2.3.4")], "doc_id long, text string")
    got = personal_data(df).collect()
    assert sorted(len(r["base"]) for r in got) == [1] * 4
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert personal_data(empty).count() == 0 and redacted(empty).count() == 0


@pytest.mark.parametrize("name", ["op6_context_pii"])
def test_query_on_documents(spark, sf_dir, name):
    from clickspan.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute.entities(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(brute.shown(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(b[0] == k for b in base) for k in KINDS]
        assert set(brute.shown(base).split(",")) - {""} <= set(r["spans"].split(","))
