"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A small linear classifier (``WEIGHTS``) scores each block from its place in the DOM
(elements and class or id words above it), its share of link text, its length and its punctuation; the score becomes
the capacity of the block's edge to the content terminal or to the boilerplate terminal. Blocks that stand next to each
other, and successive blocks of one parent element, are joined by smoothness edges whose capacity falls with their
distance in the DOM. Class and id words are compared whole; what they say inside content, or against each other, is a
cost that text and edges can outweigh. A maximum flow between the terminals gives the minimum cut, and with it the labelling of least
total cost. Blocks whose own score outweighs all their edges are settled beforehand, which leaves the cut unchanged.

Pages are independent, so they are worked where they are read; a task holds one Arrow batch of them.

Nulls and odd rows: a null or empty page gives an empty text; a page cut off anywhere, or with unclosed or crossed
elements, is read as far as it goes and in time that grows with its length (only script, style, textarea and title reach to the page's end where they are not
closed, as in a browser); repeated rows give repeated results; a null page_id or url is passed on; an empty
table gives none. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import table

#: Classifier weights in hundredths; positive speaks for content.
WEIGHTS = {
    "inside_boilerplate": -600, "inside_content": 400, "hinted": -180, "outside_content": -250, "many_links": -300, "some_links": -80,
    "long": 200, "short": -120, "sentence": 80, "paragraph": 60, "heading": 80, "list_item": -20, "copyright": -300,
}
SMOOTHNESS = 80

# Possessive, so that a tag without an end is given up at once and not retried at every length.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|<[!?/][^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*+)[^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HINT = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

_UNREAD = frozenset("script style template noscript iframe object svg math canvas audio video select textarea button title".split())
#: Read to their closing tag or to the page's end, whatever stands in them.
_RAW = frozenset("script style textarea title".split())
_FOREIGN = frozenset(("svg", "math"))
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
_VOID = frozenset("area base col embed hr img input link meta param source track".split())
_CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "td": ("tr",), "th": ("tr",), "tr": ("table",), "dt": ("dl",), "dd": ("dl",), "p": ("",), "option": ("select",)}
_BOILERPLATE_TAGS = frozenset("nav aside footer form menu dialog fieldset".split())
_CONTENT_TAGS = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOILERPLATE_WORDS = frozenset("""
    ad ads adv adbox adslot adsense adsbygoogle advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos
    promotion promotions banner banners nav navbar navigation navlinks navlist topnav mainnav subnav sidenav leftnav rightnav menu menus menubar
    mainmenu topmenu submenu footer footers pagefooter sitefooter footerlinks side sidebar sidebars rail aside widget widgets widgetarea cookie
    cookies cookiebar cookiebanner cookieconsent cookienotice consent gdpr notification notifications popup popups modal overlay subscribe
    subscription newsletter newsletters sharebar sharebuttons sharing sharedaddy social socialbar sociallinks socialmedia socialicons
    recommended recommendations breadcrumb breadcrumbs pagination pager copyright disclaimer tags login signup search skip form hidden legal
    toolbar masthead""".split())
#: Boilerplate only as a whole name, or with another word that says what there is more of.
_ALONE = frozenset("foot notice alert share related promoted recommend subscriptions".split())
_MORE = frozenset("posts post articles article stories story links content news items reading videos topics buttons button bar icons box".split())
_COMMENT_WORDS = frozenset("comment comments commentlist commentform disqus respond reply replies".split())
_CONTENT_WORDS = frozenset("""article articles articlebody content contentbody maincontent post posts postbody postcontent entry entries entrycontent
    story stories storybody main prose blog blogpost hentry""".split())
#: First or last words of names that tell a state or a category of the element, not what it is.
_STATE_FIRST = frozenset("has no with without category cat tag topic type status format author term".split())
_STATE_LAST = frozenset("open closed enabled disabled allowed".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

NEUTRAL, CONTENT, SOFT, HARD, HINTED = 0, 1, 2, 3, 4


@dataclass
class Block:
    text: str
    parent: int
    depth: int
    kind: int
    tag: str
    link_share: float


def _said(name: str) -> int:
    """What one class or id says: HARD for comments, SOFT for other boilerplate, CONTENT, or nothing."""
    words = _HINT.findall(_CAMEL.sub(" ", name).lower())
    if not words or len(words) > 1 and (words[0] in _STATE_FIRST or words[-1] in _STATE_LAST):
        return NEUTRAL
    if any(w in _COMMENT_WORDS for w in words):
        return HARD
    if any(w in _BOILERPLATE_WORDS for w in words):
        return SOFT
    if words[0] in _ALONE and (len(words) == 1 or words[1] in _MORE):
        return SOFT
    return CONTENT if any(w in _CONTENT_WORDS for w in words) else NEUTRAL


def _hint(tag: str, attributes: str, kind: int) -> int:
    """What an element says about the text inside it, given what stands above it."""
    if kind == HARD:
        return HARD
    if tag in _BOILERPLATE_TAGS:
        return HARD
    names, role, hidden = [], "", False
    if attributes and not attributes.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                names += value.split()
            elif name == "role":
                role = value.strip().lower()
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                hidden = True
    if hidden or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"):
        return HARD
    if tag in ("html", "body"):
        return kind
    said = {_said(name) for name in names}
    good = CONTENT in said
    if HARD in said and not good:
        return HARD
    if tag in _CONTENT_TAGS or role in ("main", "article"):
        return CONTENT
    if HARD in said or SOFT in said:
        return HINTED if good or kind in (CONTENT, HINTED) else SOFT
    if not good and kind != CONTENT and (tag == "header" or any("header" in _HINT.findall(_CAMEL.sub(" ", name).lower()) for name in names)):
        return HINTED if kind == HINTED else SOFT
    return CONTENT if good and kind not in (SOFT, HINTED) else kind


def _ends(page: str, tag: str) -> dict[int, int]:
    """Start of each opening tag of ``tag`` that is closed -> end of its closing tag; a closing tag belongs to the nearest open one."""
    attributes = r"""(?:"[^"]*+"|'[^']*+'|[^'">])*+"""
    pattern = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|textarea)(?=[\s/>]){attributes}>.*?(?:</\1\s*>|\Z)|<(/?){re.escape(tag)}(?=[\s/>])({attributes})>", re.S | re.I)
    found, waiting = {}, []
    for m in pattern.finditer(page):
        if m[2] is None:
            continue
        if m[2]:
            if waiting:
                found[waiting.pop()] = m.end()
        elif tag in _FOREIGN and m[3].endswith("/"):
            found[m.start()] = m.end()
        else:
            waiting.append(m.start())
    return found


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in page order."""
    out: list[Block] = []
    stack = [("", 0, NEUTRAL)]  # (tag, number, kind)
    standing: Counter[str] = Counter()  # how often each tag is on the stack
    made, linked, parts, size = 0, 0, [], [0, 0]
    ends: dict[str, dict[int, int]] = {}

    def text(raw: str) -> None:
        if "&" in raw:
            raw = html.unescape(raw)
        parts.append(raw)
        n = len(raw)
        size[0] += n
        if linked:
            size[1] += n

    def flush() -> None:
        if parts:
            joined = " ".join("".join(parts).split())
            if joined:
                tag, number, kind = stack[-1]
                out.append(Block(joined, number, len(stack), kind, tag, size[1] / max(1, size[0])))
            parts.clear()
            size[0] = size[1] = 0

    def close(tag: str, within: tuple = ()) -> None:
        if not standing[tag]:  # without this, closing tags of nothing would search a deep stack each
            return
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] == tag:
                standing.subtract(s[0] for s in stack[at:])
                del stack[at:]
                return
            if stack[at][0] in within:
                return

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if m[1]:
            if tag == "a":
                linked = max(0, linked - 1)
            elif tag not in _INLINE or standing[tag]:
                flush()
                close(tag)
            continue
        if tag in _UNREAD:
            flush()
            if tag in _RAW:
                closing = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = closing.end() if closing else end
            else:
                if tag not in ends:
                    ends[tag] = _ends(page, tag)
                at = ends[tag].get(m.start(), at)
            continue
        if tag == "head":  # what belongs there has no text that is read; anything else stands in the body
            flush()
            continue
        attributes = m[3] or ""
        kind = stack[-1][2]
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _INLINE:
            if tag == "a":
                linked = linked + 1 if not linked else linked
            if not attributes or _hint(tag, attributes, kind) in (kind, CONTENT):
                continue
        flush()
        if tag in _CLOSED_BY_SAME:
            close(tag, _CLOSED_BY_SAME[tag])
        if stack[-1][0] == "p" and tag not in _INLINE:
            stack.pop()
            standing["p"] -= 1
        made += 1
        standing[tag] += 1
        stack.append((tag, made, _hint(tag, attributes, stack[-1][2])))
    flush()
    return out


def score(block: Block, has_content: bool) -> int:
    w, words = WEIGHTS, block.text.count(" ") + 1
    if block.kind in (SOFT, HARD):
        return w["inside_boilerplate"]
    s = w["inside_content"] if block.kind == CONTENT else w["hinted"] if block.kind == HINTED else w["outside_content"] if has_content else 0
    if block.link_share > 0.66:
        s += w["many_links"] if words < 30 and block.tag not in _HEADINGS else w["some_links"]
    elif block.link_share > 0.33:
        s += w["some_links"]
    if words >= 15:
        s += w["long"]
    elif words < 5 and block.tag not in _HEADINGS:
        s += w["short"]
    s += w["sentence"] * (block.text[-1] in ".!?…。") + w["paragraph"] * (block.tag in ("p", "blockquote", "pre"))
    s += w["heading"] * (block.tag in _HEADINGS) + w["list_item"] * (block.tag == "li")
    return s + (w["copyright"] if block.text[0] == "©" or block.text.lower().startswith("copyright") else 0)


def _edges(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Neighbours in the page, and successive blocks of one parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            distance = abs(a.depth - b.depth) + (a.parent != b.parent)
            out.append((i - 1, i, SMOOTHNESS // (1 + distance)))
        before = last.get(b.parent)
        if before is not None and before != i - 1:
            out.append((before, i, SMOOTHNESS))
        last[b.parent] = i
    return out


def min_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the blocks on the content side of the minimum cut; ties go to boilerplate."""
    n = len(scores)
    scores, label = list(scores), [None] * n
    around: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        around[a][b] = around[a].get(b, 0) + c
        around[b][a] = around[b].get(a, 0) + c
    # A block whose score is at least the sum of its edges keeps its side in a minimum cut; its edges then count as score.
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is None and abs(scores[i]) >= sum(around[i].values()):
            label[i] = scores[i] > 0
            for j, c in around[i].items():
                del around[j][i]
                scores[j] += c if label[i] else -c
                todo.append(j)
            around[i] = {}
    open_blocks = [i for i in range(n) if label[i] is None]
    if open_blocks:
        content = _source_side(open_blocks, scores, around)
        for i in open_blocks:
            label[i] = i in content
    return [bool(x) for x in label]


def _source_side(nodes: list[int], scores: list[int], around: list[dict[int, int]]) -> set[int]:
    """Augmenting paths until none is left; then what the content terminal still reaches."""
    source, sink = -1, -2
    residual: dict[int, dict[int, int]] = {i: dict(around[i]) for i in nodes}
    residual[source], residual[sink] = {}, {}
    for i in nodes:
        if scores[i] > 0:
            residual[source][i], residual[i][source] = scores[i], 0
        elif scores[i] < 0:
            residual[i][sink], residual[sink][i] = -scores[i], 0
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            a = queue.popleft()
            for b, c in residual[a].items():
                if c > 0 and b not in came:
                    came[b] = a
                    queue.append(b)
        if sink not in came:
            return set(came) - {source}
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        flow = min(residual[a][b] for a, b in path)
        for a, b in path:
            residual[a][b] -= flow
            residual[b][a] += flow


def main_text(page: str | None) -> str:
    """The article of a page: its content blocks in page order, joined by one space."""
    if not page:
        return ""
    blocks = blocks_of(page)
    has_content = any(b.kind == CONTENT for b in blocks)
    labels = min_cut([score(b, has_content) for b in blocks], _edges(blocks))
    return " ".join(b.text for b, content in zip(blocks, labels) if content)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([main_text(page.as_py()) for page in batch.column(2)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(_extracted, "page_id long, url string, text string")


def op2_mincut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
