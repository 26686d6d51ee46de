"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text (what stands between block-level tags). A linear classifier over the
block's surroundings (sections it is in, words in class and id), its own tag, length, links and punctuation
gives a score; the costs of calling the block boilerplate or content are log(1 + e^score) and
log(1 + e^-score). They are the capacities from the source and to the sink. Smoothness edges join blocks
that follow each other and blocks that are next in the same container; crossing into another section makes
an edge weak. The blocks on the source side of a minimum cut are the main text.

There are no labelled pages to learn from, so the classifier's weights are stated below as parameters.

Cases: a null or empty page has empty text; text outside of any tag is a block; unclosed and stray tags are
borne; a comment, script or style without end reaches to the end of the page, other left-out elements without
end (title, select, svg and the like) to the next block tag; the weight of a form is off where it holds more
than half of the page's text, so that a form around the whole page does no harm; equal rows give equal results; a
null url or page_id is kept; an empty table gives no row.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import exp, log, log1p

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickspan.llm.tables import table

ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody tfoot thead tr ul button caption".split())
#: Comments; scripts and styles; what is left out up to its end tag, or without one up to the next block tag; tags.
_NO_NAME = r"(?![a-z0-9:-])"
_ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+"
_LEFT_OUT = "noscript|template|textarea|title|svg|iframe|select"
TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style){_NO_NAME}[^>]*>.*?(?:</\1\s*>|\Z)"
    rf"|<(svg){_NO_NAME}{_ATTRIBUTES}(?<=/)>"
    rf"|<({_LEFT_OUT}){_NO_NAME}[^>]*>(?:[^<]++|<(?!/?\3{_NO_NAME}))*+</\3\s*>"
    rf"|<({_LEFT_OUT}){_NO_NAME}[^>]*>(?:[^<]++|<(?!/\4\s*>|/?(?:{'|'.join(sorted(BLOCK))}){_NO_NAME}))*+(?:</\4\s*>)?"
    rf"|<(/?)([a-z][a-z0-9:-]*)({_ATTRIBUTES})>|<[!?/][^>]*>", re.I | re.S)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SPACED = {"br", "td", "th", "img", "input"}
SECTIONS = {"article", "main", "nav", "aside", "footer", "header", "form", "section", "div", "body", "dialog", "menu"}
#: A start tag ends these, up to the nearest element of the second set.
ENDS = {
    **{tag: ({"p"}, {"article", "section", "div", "body", "td", "li", "blockquote"}) for tag in BLOCK - {"body", "html", "head"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "body": ({"head"}, {"html"}),
}
BAD = set(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer disqus footer header masthead menu modal nav navbar navigation newsletter notice notification pager pagination "
    "popup promo promoted promotion recommended related share sharing sidebar signup social sponsor sponsored subscribe teaser "
    "toolbar topbar widget".split())
LAYOUT = set("footer header masthead menu nav navbar navigation sidebar toolbar topbar widget".split())
GOOD = set("article body content entry main post story text".split())

#: Weights of the classifier.
IN_ARTICLE, IN_SIDE, IN_FORM, BAD_NAME, GOOD_NAME = 4.0, -9.0, -7.0, -9.0, 1.5
LINKS, LENGTH, SHORT, SENTENCE, LEGAL = -5.0, 0.6, -0.8, 0.4, -2.0
OWN = {"p": 0.5, "pre": 0.5, "blockquote": 0.3, "h1": 0.5, "h2": 0.4, "h3": 0.3, "li": -0.4, "button": -6.0}
NEXT, SAME, CROSSING = 0.8, 0.6, 0.15
LEGAL_TEXT = re.compile(r"^\s*(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)


@dataclass(slots=True)
class Element:
    tag: str
    container: int
    score: float = 0.0
    #: The innermost form since the article and of all, by number; 0 is none.
    form: int = 0
    within: int = 0
    article: bool = False
    hidden: bool = False


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    container: int
    score: float
    links: int
    hidden: bool
    form: int = 0
    within: int = 0
    size: int = field(default=0)


def _named(element: Element, parent: Element, attributes: str) -> None:
    """Take class, id, role and visibility into the element's score."""
    names: set[str] = set()
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            names.update(w.lower() for w in WORDS.findall(value))
        elif key == "role":
            if value == "main":
                names.add("main")
            elif value in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog"):
                element.score += IN_SIDE
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            element.hidden = True
    if element.tag in ("html", "body"):
        return
    bad = names & BAD
    if element.tag in ("article", "main") or parent.article:
        bad -= LAYOUT - {"sidebar", "footer", "nav", "menu"}
    if element.tag in ("article", "main"):
        bad -= LAYOUT
    if bad:
        element.score += BAD_NAME
    elif names & GOOD and not parent.article:
        element.score += GOOD_NAME


def _open(tag: str, attributes: str, parent: Element, fresh: int, form: int) -> Element:
    element = Element(tag, fresh if tag in SECTIONS else parent.container, parent.score, parent.form, parent.within, parent.article, parent.hidden)
    if tag in ("article", "main"):
        if not parent.article:
            element.score += IN_ARTICLE
        element.article, element.form = True, 0
    elif tag in ("nav", "aside", "footer", "dialog", "menu") or tag == "header" and not parent.article:
        element.score += IN_SIDE
    elif tag in ("form", "fieldset"):
        element.form = element.within = form
    if attributes:
        _named(element, parent, attributes)
    return element


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order."""
    root = Element("", 0)
    stack, found, pieces = [root], [], []
    fresh, links, linked, at, owner = 0, 0, 0, 0, root
    outer = [0]  # of each form the one it stands in

    def text(piece: str) -> None:
        nonlocal links, owner
        if not piece:
            return
        if "&" in piece:
            piece = html.unescape(piece)
        if not piece.isspace():
            if linked:
                links += len(piece)
            if not any(not p.isspace() for p in pieces):
                owner = stack[-1]
        pieces.append(piece)

    def close() -> None:
        nonlocal pieces, links
        whole = " ".join("".join(pieces).split())
        if whole:
            tag = next((e.tag for e in reversed(stack) if e.tag in BLOCK), "")
            found.append(Block(whole, tag, owner.container, owner.score, links, owner.hidden, owner.form, owner.within, len(whole)))
        pieces, links = [], 0

    for match in TAG.finditer(page):
        text(page[at:match.start()])
        at = match.end()
        tag = match[6]
        if not tag:
            if match[1] or match[2] or match[3] or match[4]:
                pieces.append(" ")
            continue
        tag = tag.lower()
        if tag in BLOCK:
            close()
        elif tag in SPACED:
            pieces.append(" ")
        if match[5]:
            if tag == "a":
                linked = max(0, linked - 1)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                # An inline end tag does not end the blocks it stands in.
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break
            continue
        if tag == "a":
            linked += not match[7].endswith("/")
        if tag in ENDS:
            closed, fence = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closed:
                    linked = 0
                    del stack[i:]
                    break
                if stack[i].tag in fence:
                    break
        if tag not in VOID and not match[7].endswith("/"):
            fresh += 1
            if tag in ("form", "fieldset"):
                outer.append(stack[-1].within)
            stack.append(_open(tag, match[7], stack[-1], fresh, len(outer) - 1))
    text(page[at:])
    close()
    held = [0] * len(outer)
    for block in found:
        held[block.within] += 0 if block.hidden else block.size
    for i in range(len(outer) - 1, 0, -1):
        held[outer[i]] += held[i]
    for block in found:
        if block.form and 2 * held[block.form] <= held[0]:
            block.score += IN_FORM
    return found


def score(block: Block) -> float:
    words = block.text.count(" ") + 1
    value = block.score + OWN.get(block.tag, 0.0) + LINKS * block.links / block.size + LENGTH * log1p(words) + SHORT
    if block.text[-1] in ".!?…\"”»":
        value += SENTENCE
    if LEGAL_TEXT.match(block.text):
        value += LEGAL
    return value


def source_side(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source side of a minimum cut; ``edges`` are undirected.

    What a node could send straight from source to sink is taken off first, so flow runs only from nodes
    with more on the source's side to nodes with more on the sink's. Each such node sends along shortest paths of
    its own until it has nothing left or no way. In the second case no way leads out of the nodes it reached, now or
    later: they are on the source side, and no further search enters them.
    """
    spare = [a - b for a, b in zip(source, sink)]
    near: list[dict[int, float]] = [{} for _ in spare]
    for a, b, capacity in edges:
        near[a][b] = near[a].get(b, 0.0) + capacity
        near[b][a] = near[b].get(a, 0.0) + capacity
    tiny = 1e-9
    closed = [False] * len(spare)
    for start in range(len(spare)):
        while spare[start] > tiny and not closed[start]:
            come, queue, end = {start: start}, deque([start]), -1
            while queue and end < 0:
                i = queue.popleft()
                for j, capacity in near[i].items():
                    if capacity > tiny and j not in come and not closed[j]:
                        come[j] = i
                        if spare[j] < -tiny:
                            end = j
                            break
                        queue.append(j)
            if end < 0:
                for i in come:
                    closed[i] = True
                break
            flow, i = min(spare[start], -spare[end]), end
            while i != start:
                flow, i = min(flow, near[come[i]][i]), come[i]
            spare[start] -= flow
            spare[end] += flow
            i = end
            while i != start:
                near[come[i]][i] -= flow
                near[i][come[i]] += flow
                i = come[i]
    return closed


def _softplus(x: float) -> float:
    return x if x > 30 else log(1 + exp(x))


def main_blocks(page: str) -> list[str]:
    """Texts of the content blocks of a page."""
    found = [b for b in blocks(page) if not b.hidden]
    scores = [score(b) for b in found]
    edges = []
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT if found[i - 1].container == block.container else CROSSING))
        before = last.get(block.container)
        if before is not None and before < i - 1:
            edges.append((before, i, SAME))
        last[block.container] = i
    content = source_side([_softplus(s) for s in scores], [_softplus(-s) for s in scores], edges)
    return [b.text for b, keep in zip(found, content) if keep]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = ["\n\n".join(main_blocks(page or "")) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()),
                     pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        extract, "page_id long, url string, text string, n_chars long")


def op3_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
