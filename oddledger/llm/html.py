"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into blocks at block-level tags.  A classifier gives each block a cost for
being called content and one for being called boilerplate; these are the capacities to the
two terminals.  Neighbouring blocks, and blocks under the same element, are tied by
smoothness edges.  The minimum cut labels all blocks of a page together.
"""

from __future__ import annotations

import math
import re
from collections import deque
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from oddledger.llm.arrow import append

# fixed values: HTML elements by role
SKIPPED = "script style noscript template svg math iframe object canvas audio video textarea select title"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp "
    "rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BOILERPLATE = frozenset("nav footer aside button dialog menu figcaption".split())
WRAPPERS = frozenset("form fieldset header".split())
TEXT_ROOTS = frozenset("article main".split())
# fixed values: words in class and id that tell the role of an element, whatever it holds
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors "
    "promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments "
    "commentlist disqus respond reply replies cookie cookies consent gdpr popup newsletter subscribe "
    "subscription hidden skip".split()
)
# fixed values: words that say so only of an element without most of the page's prose
DOUBTFUL_WORDS = frozenset(
    "banner side rail header masthead topbar foot bottom discussion privacy notice notices "
    "notification alert modal overlay signup login signin register share sharing social follow "
    "related recommended recommendations teaser teasers widget widgets tag tags pagination pager "
    "toolbar copyright legal disclaimer search form".split()
)
# fixed values: behind these a name speaks of something else, and so it does where it begins with those
BESIDE = frozenset("with has no without not is".split())
ABOUT = frozenset("tag type category cat format status topic author postid has with no is not".split())
GOOD_WORDS = frozenset("article content story post entry body text main prose".split())

_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<skip>{SKIPPED.replace(' ', '|')})\b[^>]*+>.*?(?:</(?P=skip)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<more>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/a-z][^>]*+>|<[!?][^>]*+(?:>|\Z)|<[/a-z][^>]*+\Z",
    re.IGNORECASE | re.DOTALL,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(
    r"""\shidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE
)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PROSE_WORDS = 10


@dataclass(frozen=True)
class Cut:
    """Weights of the block classifier (log odds of content) and of the smoothness edges."""

    bias: float = -0.3
    per_word: float = 0.08
    paragraph: float = 0.8
    most_words: float = 30.0
    sentence: float = 0.8
    links: float = -4.0
    root: float = 3.0
    good: float = 1.5
    bad: float = -8.0
    heading: float = 0.5
    item: float = -0.5
    rights: float = -2.0
    neighbour: float = 0.4
    sibling: float = 0.6
    contrast: float = 0.2


@dataclass
class Element:
    """An element; ``mark`` is its own: 1 doubtful, 2 boilerplate, 3 hidden.

    ``words`` counts the prose below it.  ``bad`` is the share of the full weight against its
    text and ``firm`` whether an article inside may not lift it.
    """

    name: str
    number: int
    up: Element | None = None
    root: bool = False
    good: bool = False
    link: bool = False
    mark: int = 0
    words: float = 0.0
    bad: float = 0.0
    firm: int = 0


@dataclass
class Block:
    text: str
    parent: int
    linked: int
    element: Element


def _evidence(names: str) -> set[str]:
    """Words of the class, id and role names that speak of the element itself."""
    out = set()
    for name in names.split():
        parts = [w.lower() for w in _PART.findall(name)]
        if len(parts) > 1 and parts[0] in ABOUT:
            continue
        beside = next((k for k, w in enumerate(parts) if w in BESIDE), len(parts))
        out.update(parts[:beside])
    return out


def _marks(name: str, more: str, up: Element, number: int) -> Element:
    e = Element(name, number, up, up.root, up.good, up.link or name == "a")
    if name in TEXT_ROOTS:
        e.root = True
    elif name in BOILERPLATE:
        e.mark = 2
    elif name in WRAPPERS and not (name == "header" and up.root):
        e.mark = 1
    if not more or name in ("html", "body"):
        return e
    if _HIDDEN.search(more):
        e.mark = 3
    if name not in INLINE:
        words = _evidence(" ".join(" ".join(found) for found in _NAMED.findall(more)))
        # an element of its own kind may carry words about what is around it
        if name not in TEXT_ROOTS and not words & {"article", "story"}:
            if words & BAD_WORDS:
                e.mark = max(e.mark, 2)
            elif words & DOUBTFUL_WORDS:
                e.mark = max(e.mark, 1)
        if words & GOOD_WORDS:
            e.good = True
    return e


def _weigh(elements: list[Element], found: list[Block]) -> None:
    """Fill in ``bad``: what is doubtful counts less the more of the prose an element holds,
    and an article or main element lifts marks from around it."""
    for block in found:
        words = block.text.count(" ") + 1
        if words >= PROSE_WORDS:
            block.element.words += words * (1 - min(1.0, block.linked / len(block.text)))
    for e in reversed(elements):
        if e.up is not None:
            e.up.words += e.words
    page = elements[0].words
    for e in elements[1:]:
        bad, firm = e.up.bad, e.up.firm
        if (e.name == "main" and firm < 3) or (e.name == "article" and firm < 2):
            bad, firm = 0.0, 0
        own = float(e.mark > 1)
        if e.mark == 1:
            share = e.words / page if page else 0.0
            own = min(1.0, max(0.0, (0.8 - share) / 0.3))
        e.bad, e.firm = max(bad, own), max(firm, e.mark if e.mark > 1 else 0)


def blocks(html: str) -> list[Block]:
    """Text blocks of a page in page order; character references are decoded, white space
    inside a block is one space."""
    stack = [Element("", 0)]
    elements = list(stack)
    out: list[Block] = []
    pieces: list[str] = []
    linked = count = 0

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                holder = next(e for e in reversed(stack) if e.name not in INLINE)
                above = next(
                    (e.number for e in reversed(stack) if e.name not in INLINE and e is not holder), 0
                )
                out.append(Block(text, above, linked, holder))
            pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if stack[-1].link:
            linked += len(text.strip())

    at = 0
    for tag in _TAG.finditer(html):
        if tag.start() > at:
            add(html[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                pieces.append("" if name == "wbr" else " ")
                continue
        else:
            close()
        if tag["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    del stack[depth:]
                    break
                if stack[depth].name not in INLINE and name in INLINE:
                    break
            continue
        if name not in INLINE:
            # a paragraph or list item ends where the next block begins
            for depth in range(len(stack) - 1, 0, -1):
                open_ = stack[depth].name
                if open_ == "p" or (open_ == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    del stack[depth:]
                    break
                if open_ not in INLINE:
                    break
        if name in VOID:
            continue
        count += 1
        stack.append(_marks(name, tag["more"] or "", stack[-1], count))
        elements.append(stack[-1])
    if at < len(html):
        add(html[at:])
    close()
    _weigh(elements, out)
    return out


def log_odds(block: Block, p: Cut) -> float:
    """How much likelier content is than boilerplate, from the block alone."""
    words, e = block.text.count(" ") + 1, block.element
    total = p.bias + p.per_word * min(words, p.most_words)
    total += p.paragraph * (e.name == "p")
    total += p.sentence * (block.text[-1] in ".!?:;…。\"'”»")
    total += p.links * min(1.0, block.linked / len(block.text))
    total += p.root * e.root + p.good * e.good + p.bad * e.bad
    total += p.heading * (len(e.name) == 2 and e.name[0] == "h" and e.root) + p.item * (e.name == "li")
    return total + p.rights * ("©" in block.text or "all rights reserved" in block.text.lower())


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of the smallest cut (Dinic's algorithm).

    Nodes that could stand on either side go to the sink side.
    """
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i in range(n):
        # what both terminals share flows straight through
        rest = source[i] - sink[i]
        link(s, i, rest, 0.0) if rest > 0 else link(i, t, -rest, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for k in out[a]:
                if room[k] > tiny and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    queue.append(to[k])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[k] for k in path)
                for k in path:
                    room[k] -= flow
                    room[k ^ 1] += flow
                cut = next(i for i, k in enumerate(path) if room[k] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nxt[a] < len(out[a]):
                k = out[a][nxt[a]]
                if room[k] > tiny and level[to[k]] == level[a] + 1:
                    path.append(k)
                    a = to[k]
                    break
                nxt[a] += 1
            else:
                if not path:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                nxt[a] += 1


def label(found: list[Block], p: Cut) -> list[bool]:
    """True for the content blocks of a page."""
    costs = []
    for block in found:
        z = log_odds(block, p)
        # -log of the probability of the other label
        costs.append((math.log1p(math.exp(min(z, 60.0))), math.log1p(math.exp(min(-z, 60.0)))))
    edges = []

    def tie(a: int, b: int, weight: float) -> None:
        # an element marked as boilerplate should not draw the text around it along
        same = (found[a].element.bad > 0.5) == (found[b].element.bad > 0.5)
        edges.append((a, b, weight if same else weight * p.contrast))

    last: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            tie(i - 1, i, p.neighbour)
        if block.parent in last:
            tie(last[block.parent], i, p.sibling)
        last[block.parent] = i
    return minimum_cut([a for a, _ in costs], [b for _, b in costs], edges)


def main_text(html: str | None, p: Cut | None = None) -> str:
    """The content blocks in page order, one a line."""
    if not html:
        return ""
    found = blocks(html)
    return "\n".join(b.text for b, keep in zip(found, label(found, p or Cut()), strict=True) if keep)


def extract(pages: DataFrame, p: Cut | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null and empty html, and pages without content, give an empty text.
    """
    p = p or Cut()

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = [main_text(h, p) for h in batch.column("text").to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    rows = pages.select("page_id", "url", F.col("html").alias("text"))
    return append(rows, compute, {"text": StringType(), "n_chars": LongType()}, omit=("text",))
