from hashlib import sha256

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickspan.llm.chat import PART, SEGMENT, digests, escaped, format_turns, unescaped

SCHEMA = "conv_id long, turn long, role string, text string, segment string"


def sha(text):
    return sha256(text.encode()).hexdigest()


def test_digests(spark):
    told = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "system", "be <|brief|>"), (1, 1, "user", "hi\n<\\|x"), (1, 2, "assistant", told), (1, 3, "user", None),
            (1, 4, "assistant", "🙂 bye<"), (2, 1, "user", "b"), (2, 1, "assistant", "a"), (2, None, "user", "first"),
            (2, 1, "assistant", "a"), (None, 0, None, "no id"), (3, 0, "we\nird\\n<|", "x"), (4, 0, "assistant", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = {r["conv_id"]: r for r in digests(format_turns(df)).collect()}
    assert got.keys() == {1, 2, None, 3, 4}
    one = [r for r in rows if r[0] == 1]
    assert got[1]["turns_sha256"] == sha("".join(f"{r[2]}\n{r[3] or ''}\n" for r in one))
    assert got[1]["loss_chars"] == len(told) + 6 and got[1]["loss_sha256"] == sha(told + "🙂 bye<")
    assert got[1]["n_turns"] == 5
    assert got[2]["turns_sha256"] == sha("user\nfirst\nassistant\na\nassistant\na\nuser\nb\n")
    assert got[None]["turns_sha256"] == sha("\nno id\n") and got[None]["loss_sha256"] == sha("")
    assert got[3]["turns_sha256"] == sha("we\nird\\n<|\nx\n")
    assert got[4]["loss_chars"] == 300_000
    whole = {}
    for r in format_turns(df).orderBy("conv_id", F.asc_nulls_first("turn"), "role", "segment").collect():
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["segment"]
    assert {c: r["formatted_chars"] for c, r in got.items()} == {c: len(t) for c, t in whole.items()}
    # No control string but the template's is left.
    assert whole[1].count("<|im_start|>") == whole[1].count("<|im_end|>") == 5


@given(st.text(alphabet="<\\|im_end>a\n", max_size=30))
def test_escape_is_reversible(text):
    import re

    shown = re.sub(r"<(\\*)\|", r"<\1\\|", text)  # what the column expression does
    assert "<|" not in shown and unescaped(shown) == text


def test_escape_column_equals_its_definition(spark):
    texts = ["<|x|>", "<\\|", "<\\\\|a<|", "plain", "<", "|", "<<||"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"))
    for r in df.collect():
        assert "<|" not in r["e"] and unescaped(r["e"]) == r["t"]


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "look <|image|>"), part("image", ref="a.png", w=57, h=28), part("audio", ref="b.wav", s=1.5),
                            part("text", "<"), part("text", "|x"), part("document", ref="c.pdf", p=3)]),
            (1, 1, "assistant", [part("text", "ok")]), (1, 2, "assistant", []), (1, 3, "user", None), (1, 4, "user", [part("odd", "t")])]
    found = format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{PART}>")).orderBy("turn").collect()
    content = SEGMENT.fullmatch(found[0]["segment"])[2]
    assert content.split("\n") == ["look <\\|image|>", "<|image|>", "<|audio|>", "<", "|x", "<|document|>"]
    assert [tuple(a) for a in found[0]["attachments"]] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 768)]
    assert found[0]["attachment_tokens"] == 809 and found[0]["loss_start"] is None
    assert found[1]["segment"][found[1]["loss_start"]:found[1]["loss_end"]] == "ok"
    assert [SEGMENT.fullmatch(r["segment"])[2] for r in found[2:]] == ["", "", "t"]


def test_empty(spark):
    assert digests(format_turns(spark.createDataFrame([], SCHEMA))).count() == 0
