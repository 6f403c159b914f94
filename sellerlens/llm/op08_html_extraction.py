"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks (text between block-level tags) with the open
elements around each. A linear classifier over a block's markup and text gives
its cost of being content and of being boilerplate, which are the capacities
to the two terminals. Edges join neighbouring blocks, and each block with the
one before it under the same parent, the stronger the closer they are in the
document tree. The minimum cut labels all blocks of a page at once, so a short
line within an article stays and a long advert outside of it goes. Blocks whose
terminal outweighs all their edges are settled first (they keep that label in
every minimum cut), and those with one or two neighbours are replaced by the capacities that they let through; maximum flow decides the rest.

Names of boilerplate are matched on whole class tokens and ids (`sidebar`, `ad-box`; not
`has-sidebar`, `tag-python`). A strong name or a form counts only where it does not hold the
page's article, and a weak one (`discussion`, `legal`) only where no article is around, at or below it.

The work is per page, in an Arrow UDF over whole batches; nothing is shuffled.

White space within a block becomes one blank; character references are decoded;
blocks are joined by a line feed. Scripts, styles, templates, titles, comments
and hidden elements are never content. Defined cases: null and empty pages, and
pages without content, give an empty text; broken markup is read as far as it
goes (an unclosed element ends with its parent, an unfinished tag is dropped);
equal rows are extracted one by one; a very long or deep page takes time in proportion to its length; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens.llm.common import table

#: The classifier: score = sum of weight * feature; positive for content.
WEIGHTS = {
    "bias": -1.0, "in_article": 3.5, "paragraph": 1.5, "heading": 0.5, "log2_words": 0.4, "ends_sentence": 0.5,
    "link_share": -4.0, "boilerplate_element": -8.0, "boilerplate_name": -8.0,
}
MOST_LOG2_WORDS = 6.0
SENTENCE_ENDS = ".!?…\"”»"
#: Capacity between two blocks that are siblings; divided by half the steps between them in the tree.
SMOOTHNESS = 1.0
MOST_STEPS = 64

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes template xmp".split())
UNSEEN = frozenset("svg math canvas object audio video head".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section
    select summary table tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}}
PARAGRAPH_BARRIERS = frozenset(("button", "td", "th", "table"))
#: An inline element isn't closed from within a cell.
CELLS = frozenset(("td", "th", "table"))
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

#: What the classifier knows of boilerplate.
BOILERPLATE_ELEMENTS = frozenset("nav footer aside menu dialog button select search".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar status".split())
#: A class token or id is one of these names if it has no other parts than their words and PARTS.
STRONG_NAMES = frozenset("""ad ads advert adverts advertisement advertisements adbox adsense banner banners sponsored promo promos nav navbar
    navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer footers siteheader pageheader masthead comment comments commentlist disqus
    reply replies cookie gdpr popup popups modal modals overlay overlays newsletter newsletters subscribe signup login share social related
    recommended readmore widget widgets toolbar toolbars pagination pager tags consent consents onetrust cookiebar cookiebanner
    cookieconsent""".split())
WEAK_NAMES = frozenset("""advertising sponsor sponsors promotion promotions response responses discussion cookies notice notices alert alerts
    subscription subscriptions sharing recommend recommendation recommendations tag copyright legal disclaimer search""".split())
PARTS = frozenset("""area article articles aside bar bars block blocks body bottom box boxes btn button buttons card cards center col column columns
    container content desktop div entry fixed float footer form global google gpt group header holder icon icons inline inner item items left link links
    list main mobile manager module panel page policy popular post posts preferences primary right row sdk secondary section settings site slot small sticky stories story text
    thread title top unit wide wp wrap wrapper zone""".split())
_COMPOUND = re.compile(r"(?:^|(?<=[^a-z]))(side|pop|sign|log|read|site|page|comment)-(bars?|ups?|up|in|more|header|list)(?![a-z])")
_SIZE = re.compile(r"[0-9]+(?:x[0-9]+)?")
_NOT_LETTERS = re.compile("[^a-z]+")
#: A form that holds half of a page's text in paragraphs of sentences, and so many characters of it, is the page's frame.
LEAST_FRAMED = 300
ARTICLE_NAMES = re.compile(r"(?:^|[^a-z])(?:article|article-?body|post-?(?:body|content)|entry-?content|main-?(?:content|text)|story-?body)(?:$|[^a-z])")

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def name_strength(token: str) -> int:
    """2 if a class token or id is a strong name of boilerplate, 1 if a weak one, else 0."""
    token = _COMPOUND.sub(lambda m: m[1] + m[2], _SIZE.sub("-", token))
    parts = [x for x in _NOT_LETTERS.split(token) if x]
    strong, weak = (any(x in names for x in parts) for names in (STRONG_NAMES, WEAK_NAMES))
    if not (strong or weak) or parts[0] in ("content", "main") or any(x not in STRONG_NAMES and x not in WEAK_NAMES and x not in PARTS for x in parts):
        return 0
    return 2 if strong else 1


class Element:
    """An open element, and what holds for all text within it; `form`, `name` and `marked` (as an article) are its own alone."""

    __slots__ = ("tag", "parent", "depth", "article", "boiler", "named", "unseen", "link", "form", "name", "marked", "paragraph")

    def __init__(self, tag: str, parent: Element | None, attributes: str):
        self.tag, self.parent = tag, parent
        if parent is None:
            self.depth, self.article, self.boiler, self.named, self.unseen, self.link = 0, False, False, False, False, False
        else:
            self.depth, self.article, self.boiler = parent.depth + 1, parent.article, parent.boiler
            self.named, self.unseen, self.link = parent.named, parent.unseen, parent.link
        self.form, self.name, self.marked = tag == "form", 0, tag in ("article", "main")
        # the open paragraph that a block would end
        self.paragraph = self if tag == "p" else None if parent is None or tag in PARAGRAPH_BARRIERS else parent.paragraph
        if self.marked:
            self.article = True
        elif tag in BOILERPLATE_ELEMENTS or tag == "header" and not self.article:
            self.boiler = True
        elif tag == "a":
            self.link = True
        if tag in UNSEEN:
            self.unseen = True
        if attributes and not attributes.isspace():
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        for name, value in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id"):
                for token in value.strip("\"'").lower().replace("_", "-").split():
                    strength = name_strength(token)
                    if strength and self.tag not in ("html", "body"):
                        self.name = max(self.name, strength)
                    elif ARTICLE_NAMES.search(token):
                        self.article = self.marked = True
            elif name == "role":
                value = value.strip("\"'").lower()
                self.boiler = self.boiler or value in BOILERPLATE_ROLES
                self.form = self.form or value == "form"
                if value in ("main", "article"):
                    self.article = self.marked = True
            elif name == "hidden" or name == "aria-hidden" and "true" in value.lower() or name == "style" and _HIDDEN_STYLE.search(value):
                self.unseen = True


class Block:
    """The text between two block-level tags."""

    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    here = Element("#page", None, "")
    owner = here
    opened: Counter[str] = Counter()
    cells = [Counter()]  # what is open within the innermost cell, the one around it, ...

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(owner, text, linked))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked, owner
        if not here.unseen:
            text = html.unescape(raw) if "&" in raw else raw
            if not parts:
                owner = here
                while owner.parent is not None and owner.tag not in BLOCK:
                    owner = owner.parent
            parts.append(text)
            if here.link:
                linked += len(text.strip())

    def leave(to: Element) -> None:
        """Closes all elements below `to`."""
        nonlocal here
        while here is not to:
            opened[here.tag] -= 1
            if here.tag in CELLS:
                cells.pop()
            cells[-1][here.tag] -= 1
            here = here.parent

    def close(tags: set[str], barriers: set[str] | frozenset[str], scope: Counter) -> None:
        """Closes the innermost of `tags` that is open within the barriers; `scope` counts what is open, so most calls walk nowhere."""
        if not any(scope[t] for t in tags):
            return
        at = here
        while at.parent is not None and at.tag not in barriers:
            if at.tag in tags:
                leave(at.parent)
                return
            at = at.parent

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        end, tag, attributes = m[1], m[2], m[3]
        if tag is None:
            end, tag, attributes = m[4], m[5], m[6]
        if tag is None or page[at - 1] != ">":
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        if end:
            if tag == "br":
                add(" ")
            else:
                close({tag}, set(), opened) if tag in BLOCK else close({tag}, CELLS, cells[-1])
            continue
        if tag in VOID:
            if tag == "br":
                add(" ")
            continue
        if tag in RAW:
            if attributes.endswith("/") and tag == "template":
                continue
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        if tag in BLOCK:
            if here.paragraph is not None:
                leave(here.paragraph.parent)
            if tag in ENDS:
                close(ENDS[tag], BARRIERS[tag], opened)
            if tag in HEADINGS and here.tag in HEADINGS:
                leave(here.parent)
        here = Element(tag, here, attributes)
        opened[tag] += 1
        cells[-1][tag] += 1
        if tag in CELLS:
            cells.append(Counter())
    flush()
    settle_names(out)
    return out


def settle_names(found: list[Block]) -> None:
    """Sets `named` and `boiler` of all elements around the blocks from their own names and forms.

    The article is the marked element, outside of boilerplate, with the most unlinked text of its own. An element
    holds it if that is at or below it, with half of the page's unlinked text or more.
    """
    around: dict[int, Element] = {}
    for b in found:
        e = b.element
        while e is not None and id(e) not in around:
            around[id(e)] = e
            e = e.parent
    order = sorted(around.values(), key=lambda e: e.depth)
    if not any(e.form or e.name for e in order):
        return
    marked: dict[int, Element | None] = {}  # the innermost article mark at or above
    for e in order:
        marked[id(e)] = e if e.marked else marked[id(e.parent)] if e.parent is not None else None
    text, framed, own = dict.fromkeys(around, 0), dict.fromkeys(around, 0), dict.fromkeys(around, 0)
    total, below = 0, set()
    for b in found:
        e, size = b.element, max(0, len(b.text) - b.linked)
        total += size
        text[id(e)] += size
        if e.tag == "p" and not e.boiler and b.text[-1] in SENTENCE_ENDS:
            framed[id(e)] += size
        if marked[id(e)] is not None and not e.boiler:
            own[id(marked[id(e)])] += size
            below.add(id(marked[id(e)]))
    for e in reversed(order):
        if e.parent is not None:
            text[id(e.parent)] += text[id(e)]
            framed[id(e.parent)] += framed[id(e)]
            if id(e) in below:
                below.add(id(e.parent))
    article = max(order, key=lambda e: own[id(e)])
    holds = set()
    if own[id(article)]:
        e = article
        while e is not None:
            if 2 * text[id(e)] >= total:
                holds.add(id(e))
            e = e.parent
    for e in order:
        if e.parent is not None:
            e.named, e.boiler = e.named or e.parent.named, e.boiler or e.parent.boiler
        if e.name == 2 and id(e) not in holds or e.name == 1 and not e.article and id(e) not in below:
            e.named = True
        if e.form and id(e) not in holds and (framed[id(e)] < LEAST_FRAMED or 2 * framed[id(e)] < total):
            e.boiler = True


def score(block: Block) -> float:
    """The classifier: the cost of calling the block boilerplate less that of calling it content."""
    e, w = block.element, WEIGHTS
    words = block.text.count(" ") + 1
    z = w["bias"] + w["log2_words"] * min(MOST_LOG2_WORDS, log2(words + 1))
    z += w["link_share"] * min(1.0, block.linked / len(block.text))
    z += w["in_article"] * e.article + w["paragraph"] * (e.tag == "p") + w["heading"] * (e.tag in HEADINGS)
    z += w["ends_sentence"] * (block.text[-1] in SENTENCE_ENDS)
    return z + w["boilerplate_element"] * e.boiler + w["boilerplate_name"] * e.named


def steps(a: Element, b: Element) -> int:
    """Edges of the document tree between two elements, MOST_STEPS at most."""
    n = 0
    while a is not b and n < MOST_STEPS:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for k, b in enumerate(found):
        if k:
            out.append((k - 1, k, SMOOTHNESS * 2 / max(2, steps(found[k - 1].element, b.element))))
        parent = id(b.element.parent)
        before = last.get(parent)
        if before is not None and before != k - 1:
            out.append((before, k, SMOOTHNESS))
        last[parent] = k
    return out


def minimum_cut(scores: list[float], joined: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut.

    A score is the capacity from the source (positive) or to the sink (negative); `joined` are edges both ways.

    The graph shrinks before any flow is sent, and the cut stays the same: a node whose terminal capacity is
    at least that of its edges is on that side, and one with two neighbours or fewer is replaced by the capacities that it
    lets through between them and to the terminals. Blocks in a row with edges between siblings never cross, so every page
    shrinks to nothing in a time in proportion to its blocks; a maximum flow settles what is left of other graphs.
    """
    z = list(scores)
    near: list[dict[int, float]] = [{} for _ in z]
    for a, b, c in joined:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * len(z)
    gone: list[tuple[int, list[tuple[int, float]]]] = []  # replaced nodes with the neighbours that they had
    queue, waiting = deque(range(len(z))), [True] * len(z)
    left = set(queue)

    def again(k: int) -> None:
        if not waiting[k]:
            waiting[k] = True
            queue.append(k)

    while queue:
        k = queue.popleft()
        waiting[k] = False
        if k not in left:
            continue
        if len(near[k]) > 2 and abs(z[k]) < sum(near[k].values()):
            continue
        left.discard(k)
        around = list(near[k].items())
        for b, _ in around:
            del near[b][k]
            again(b)
        if abs(z[k]) >= sum(c for _, c in around):
            label[k] = z[k] > 0
            for b, c in around:
                z[b] += c if label[k] else -c
            continue
        gone.append((k, around))
        (u, p), (w, q) = (around * 2)[:2] if len(around) > 1 else (around[0], (around[0][0], 0.0))
        # the least cost of the node for either side of its neighbours: (u, w) on the sink's side is 0
        cost = {(i, j): min(p * i + q * j, -z[k] + p * (1 - i) + q * (1 - j)) for i in (0, 1) for j in (0, 1)}
        through = (cost[0, 1] + cost[1, 0] - cost[0, 0] - cost[1, 1]) / 2
        z[u] -= cost[1, 0] - cost[0, 0] - through
        z[w] -= cost[0, 1] - cost[0, 0] - through
        if u != w and through > 0:
            near[u][w] = near[u].get(w, 0.0) + through
            near[w][u] = near[w].get(u, 0.0) + through
    if left:
        side = _source_side(sorted(left), z, near)
        for k in left:
            label[k] = k in side
    for k, around in reversed(gone):
        label[k] = sum(c for b, c in around if label[b]) + z[k] > sum(c for b, c in around if not label[b])
    return [bool(x) for x in label]


def _source_side(nodes: list[int], z: list[float], near: list[dict[int, float]]) -> set[int]:
    """Maximum flow by shortest augmenting paths; the nodes that the source still reaches."""
    left = {k: dict(near[k]) for k in nodes}
    supply, demand = {k: max(z[k], 0.0) for k in nodes}, {k: max(-z[k], 0.0) for k in nodes}
    tiny = 1e-9
    while True:
        back: dict[int, int | None] = {k: None for k in nodes if supply[k] > tiny}
        queue, goal = deque(back), None
        while queue and goal is None:
            k = queue.popleft()
            if demand[k] > tiny:
                goal = k
                break
            for b, c in left[k].items():
                if c > tiny and b not in back:
                    back[b] = k
                    queue.append(b)
        if goal is None:
            return set(back)
        path = [goal]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        flow = min(supply[path[-1]], demand[goal], *(left[a][b] for b, a in zip(path, path[1:])))
        supply[path[-1]] -= flow
        demand[goal] -= flow
        for b, a in zip(path, path[1:]):
            left[a][b] -= flow
            left[b][a] += flow


def main_text(page: str | None) -> str:
    """The main text of one page."""
    found = blocks(page or "")
    content = minimum_cut([score(b) for b in found], edges(found))
    return "\n".join(b.text for b, ok in zip(found, content, strict=True) if ok)


def extracted(page: Column) -> Column:
    """The main text of a column of pages."""
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return F.arrow_udf(extract, T.StringType())(page)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), extracted(F.col(page)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
