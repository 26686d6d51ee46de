import html
import random
import re
import time

import pytest

from clickspan.llm.html import main_blocks, main_text, source_side
from clickspan.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>Site title</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1><a href="/">Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div id="cookie-notice"><p>We use cookies to make this site better for you.</p></div><!-- comment <p>no</p> -->
<form action=/x><article class="post"><header class="post-header"><h1>T &amp; t</h1></header>
<p>First   para with&nbsp;space and <a href=x>a link</a> in it.<p>Second one<br>line two.
<ul><li>one<li>two</ul><aside>See also this and that.</aside><div class="ad">Buy our thing today, it is cheap.</div>
<table><tr><td>a<td>b</table><p hidden>unseen</p><form><label>Name</label><input><button>Go</button></form>
<section class="comments"><p>Great article, thanks so much for writing it all down!</p></section></article></form>
<div class="sidebar"><p>Popular posts of this week are listed over here.</p></div><footer>&copy; 2020 Site</footer>"""


def test_a_page():
    assert main_blocks(PAGE) == ["T & t", "First para with space and a link in it.", "Second one line two.", "one", "two", "a b"]


def test_without_semantic_tags():
    page = ("<div><p>This is a long paragraph of text, which goes on for a while.</p><p>Short.</p><p>Another one that is about as "
            "long as the first one was, more or less.</p></div><ul><li><a href=a>A</a></li><li><a href=b>B</a></li></ul>")
    assert main_blocks(page) == [
        "This is a long paragraph of text, which goes on for a while.", "Short.",
        "Another one that is about as long as the first one was, more or less."]


@pytest.mark.parametrize("page, blocks", [
    ("", []), ("plain text < 3 & more", ["plain text < 3 & more"]), ("<p>a long enough text here<!-- open", ["a long enough text here"]),
    ("<script>x", []), ("<article><p>&lt;b&gt; &eacute;&#233;", ["<b> éé"]), ("</div></p><article>x</article></p>", ["x"]),
    ("<article><b>bold</b>er <i>x", ["bolder x"]),
])
def test_odd_pages(page, blocks):
    assert main_blocks(page) == blocks


@pytest.mark.parametrize("page, blocks", [
    ('<svg class="i"/><article><p>All the text.</p></article>', ["All the text."]),
    ('<svg d="a>b" /><article><p>All <svg-icon></svg-icon>the text.</p></article>', ["All the text."]),
    ("<article><p>One.<svg><path/><foreignObject><div>no</div></foreignObject></svg></p><p>Two.</p></article>", ["One.", "Two."]),
    ("<svg><path><article><p>All the text.</p><svg><text>no</text></svg></article>", ["All the text."]),
    ("<title>Site<body><article><p>All the text.</p><svg><title>no</title></svg></article>", ["All the text."]),
    ("<article><select><option>no<p>All the text.</p></article>", ["All the text."]),
    ("<title>The &lt;p> and <p> tags</title><article><p>All the text.</p></article>", ["All the text."]),
])
def test_elements_without_end(page, blocks):
    assert main_blocks(page) == blocks


def test_form_around_the_page():
    long = " ".join(["word"] * 500)
    assert main_blocks(f"<body><form id=f><div><p>{long}</p></div></form></body>") == [long]
    assert main_blocks(f"<body><form><div><fieldset><p>{long}</p></fieldset></div></form></body>") == [long]
    some = "Leave your address here, and we will write to you once a week about all of this."
    assert main_blocks(f"<body><div><p>{long}</p></div><form><p>{some}</p></form></body>") == [long]
    assert main_blocks(f"<body><form><div><p>{long}</p></div><form><p>{some}</p></form></form></body>") == [long]


def test_many_elements_without_end():
    assert main_blocks("<svg>" * 20_000 + "<article><p>All the text." + "<select>" * 20_000) == ["All the text."]


def test_minimum_cut_against_all_labellings():
    random.seed(2)
    for _ in range(60):
        n = random.randint(1, 8)
        source, sink = ([random.choice([0.0, random.random() * 3]) for _ in range(n)] for _ in range(2))
        edges = [(a, b, random.random()) for a in range(n) for b in range(a) if random.random() < 0.5]

        def cost(side):
            return sum(source[i] for i in range(n) if not side[i]) + sum(sink[i] for i in range(n) if side[i]) + sum(
                c for a, b, c in edges if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(source_side(source, sink, edges)) == pytest.approx(best, abs=1e-6)


def test_many_blocks_and_deep_pages():
    assert len(main_blocks("<article>" + "<p>Some words of a paragraph.</p>" * 5000)) == 5000
    assert main_blocks("<div>" * 3000 + "<p>Some words of a paragraph that is long.</p>") == ["Some words of a paragraph that is long."]


def test_alternating_blocks_take_linear_time():
    def page(n):
        story = "<p>A paragraph of the story that goes on for some words, with a full stop.</p>"
        links = "<ul><li><a href='#'>Read this instead</a></li></ul>"
        return f"<body><div>{(story + links) * n}</div></body>"

    def seconds(n):
        begin = time.perf_counter()
        found = main_blocks(page(n))
        assert len([b for b in found if b.startswith("A paragraph")]) == n
        return time.perf_counter() - begin

    seconds(200)
    assert seconds(8000) < 10 * max(seconds(2000), 0.05)


def test_table_of_pages(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted((tuple(r) for r in main_text(df).collect()), key=repr)
    text = "\n\n".join(main_blocks(PAGE))
    assert found == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert main_text(df.limit(0)).count() == 0


def test_articles_of_the_test_pages(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for row in QUERIES["op3_min_cut"](spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", pages[row["page_id"]], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        want = "\n\n".join(p for p in parts if p)
        assert row["text"] == want and row["n_chars"] == len(want)
