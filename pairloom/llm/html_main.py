"""HTML extraction: minimum-cut labelling of text blocks.

A page is cut into blocks of text at block-level tags. A linear classifier gives each
block a cost of being content less a cost of being boilerplate, from its own text
(words, links, end of a sentence, tag) and, moderately, from what encloses it (tags,
roles, what class and id names end in). These costs are the terminal capacities of a
graph. Smoothness edges tie neighbours in page order, the more the nearer they are in
the DOM, and blocks of one container with one block between them; an edge is weaker,
never gone, where what encloses the two speaks differently. The minimum cut, by
max-flow, labels the blocks: a short line goes with the article around it, an advert
between paragraphs does not. Blocks whose own costs outweigh all their edges are
labelled first, which is exact and leaves small graphs. Where the cut would leave nothing of a
page that has a block of prose outside all boilerplate, that block is a seed of content.

White space inside a block becomes one space, blocks are trimmed and joined in page
order by one space, character references are decoded. Pages are read in one pass,
linear in their length whatever tags and quotes they leave open.

Cases: null and empty pages give the empty text; pages without markup are one block,
judged like any other; unclosed and misnested tags are closed by what encloses them; a
tag that no '>' ends is text; rows that repeat give the same text; an empty table gives
no rows; extra columns are kept by `extract` unless named like one of its own, which it
replaces.
"""

from __future__ import annotations

import html
import math
import re
import sys
from collections import Counter, deque

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared import utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OWN = ("main_text", "n_blocks", "n_content")
#: The begin of a tag: its name, and its attributes up to the first quote.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\"']*+)([^>\"']*+)")
_PLAIN = re.compile(r"[^>\"']*+")
_SPACE = re.compile(r"\s+")
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++))""")
_BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)")
_HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
_NAME = re.compile(r"[a-z]+")
_RAW = frozenset("script style noscript template textarea title svg iframe object canvas select option datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mspace mpadded semantics annotation".split()
)
#: What ends an open tag of its own kind.
_ENDS_OWN = frozenset("p li dt dd tr td th option".split())
#: What an inline end tag does not reach beyond.
_BORDERS = frozenset("td th table".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td dd figcaption".split())
#: What an enclosing tag adds to the cost of content.
_TAGS = {"nav": 4.0, "footer": 4.0, "aside": 4.0, "form": 4.0, "menu": 4.0, "header": 4.0, "button": 4.0, "dialog": 4.0, "head": 8.0, "fieldset": 2.0, "address": 1.0}
_ROLES = {"navigation": 4.0, "banner": 4.0, "contentinfo": 4.0, "complementary": 4.0, "search": 4.0, "form": 4.0, "alert": 1.0, "dialog": 4.0, "menu": 4.0, "menubar": 4.0}
#: Words of class and id names, by how much they say.
_NAMES = {
    **dict.fromkeys(
        "ad ads advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright discussion disqus dock footer gdpr login masthead menu modal "
        "nav navbar navigation newsletter notice notices notification pagination paging popular popup privacy promo promoted promotion recommend recommended related replies respond search share sharing sidebar sidebars "
        "signup skip social sponsor sponsored subscribe subscription teaser trending widget widgets outbrain taboola".split(),
        4.0,
    ),
    **dict.fromkeys("alert aside disclaimer feedback form header legal overlay reply tags toc toolbar warning".split(), 1.0),
    **dict.fromkeys("article content main body entry post story text prose".split(), -1.0),
}
#: Parts of a name that say where or what kind of box, not what is in it; the part before them speaks.
_BOXES = frozenset(
    "area article articles bar block body bottom box btn bundle button buttons card cards cell col column container content desktop element first form grid group head heading icon icons inner item items last left "
    "link links list lists main mobile module news outer overlay page panel part post posts primary region right row secondary section secondary slot stories strip text title top unit view wrap wrapper zone".split()
)
#: The most that what encloses a block can say; hidden text is beyond it.
_MOST, _UNSEEN = 5.0, 12.0
#: A block of this cost or less makes sure that a page is not empty.
SEED = -1.0
#: Smoothness of neighbours under one parent; it halves with each level up to the common ancestor,
#: and falls with the difference of what encloses them, by e for each CONTRAST.
TIE, CONTRAST = 2.0, 3.0


class _Node:
    __slots__ = ("cost", "depth", "inside", "link", "tag", "up")

    def __init__(self, tag: str, up: _Node | None, cost: float, inside: bool, link: bool):
        self.tag, self.up, self.cost, self.inside, self.link = tag, up, cost, inside, link
        self.depth = up.depth + 1 if up else 0


def _said(parts: list[str]) -> float:
    """What a class or id name says: its last part does, so that share-price is a price; of related-posts, whose last part is a box, the one before."""
    for n in reversed(parts):
        if n not in _BOXES:
            return _NAMES.get(n, 0.0)
    return _NAMES.get(parts[-1], 0.0) if parts else 0.0


def _own_cost(tag: str, attributes: str, inside: bool) -> float:
    """What a tag adds to the cost of content."""
    cost = _TAGS.get(tag, 0.0)
    if tag == "header" and inside:
        cost = 0.0  # an article's own header holds its title
    if not attributes or attributes.isspace():
        return cost
    if "=" in attributes:
        for k, x, y, z in _ATTRIBUTE.findall(attributes):
            k, value = k.lower(), x or y or z
            if k in ("class", "id") and tag not in ("html", "body"):
                # a name such as has-sidebar tells of what else the page holds
                said = [_said(_NAME.findall(whole)) for whole in value.lower().split() if not whole.startswith(("has-", "with-", "no-"))]
                cost += max([0.0, *said]) + min([0.0, *said])
            elif k == "role":
                cost += _ROLES.get(value.lower(), 0.0)
            elif (k == "style" and _HIDDEN.search(value)) or (k == "aria-hidden" and value == "true"):
                cost += _UNSEEN
    if "hidden" in attributes and _BARE_HIDDEN.search(attributes):
        cost += _UNSEEN
    return cost


class _Scanner:
    """Tags of a page, in one pass."""

    def __init__(self, page: str):
        self.page, self.size, self.last = page, len(page), page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.broken = False  # a quote left open ran to the end: quotes mean nothing any more
        self.missing: set[str] = set()

    def tag(self, at: int) -> tuple[int, str, str, str] | None:
        """(end, "/" or "", name, attributes) of the tag that begins at a '<'; None if none does."""
        if at > self.last:
            return None
        m = _TAG.match(self.page, at)
        if m is None:
            return None
        end = m.end()
        while not self.broken and end < self.size and self.page[end] != ">":
            quote = self.page[end]
            end = self.page.find(quote, end + 1) + 1 if end < self.quotes[quote] else end + 1
            end = _PLAIN.match(self.page, end).end()
        if end >= self.size or self.page[end] != ">":
            self.broken = True
            end = self.page.find(">", m.end(2))
        return end + 1, m.group(1), m.group(2).lower(), "" if self.broken else self.page[m.end(2) : end]

    def after(self, tag: str, at: int) -> int | None:
        """Where the next end tag of a name ends."""
        if tag in self.missing:
            return None
        m = re.compile(rf"</{tag}\s*+>", re.I).search(self.page, at)
        if m is None:
            self.missing.add(tag)
            return None
        return m.end()


def blocks(page: str) -> list[tuple[str, int, _Node]]:
    """(text, characters inside links, enclosing node) of every block that has text, in page order."""
    root = here = _Node("", None, 0.0, False, False)
    out: list[tuple[str, int, _Node]] = []
    text: list[str] = []
    linked = at = 0
    block = root  # the innermost block-level node
    open_: Counter[str] = Counter()
    within: list[Counter[str]] = [Counter()]  # inline tags open since each table's or cell's begin
    scan, size = _Scanner(page), len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", "".join(text)).strip()
            if whole:
                out.append((whole, linked, block))
            text.clear()
        linked = 0

    def take(part: str) -> None:
        nonlocal linked
        if part:
            text.append(html.unescape(part) if "&" in part else part)
            if here.link:
                linked += len(text[-1].strip())

    def close(node: _Node) -> None:
        """Leave a node and all that is open in it."""
        nonlocal here, block
        while here.depth >= node.depth:
            open_[here.tag] -= 1
            if here.tag in _BORDERS:
                within.pop()
            elif here.tag in _INLINE:
                within[-1][here.tag] -= 1
            here = here.up
        while block.depth > here.depth:
            block = block.up

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            take(page[at:])
            break
        take(page[at:begin])
        if page.startswith("<!--", begin):
            at = page.find("-->", begin + 4) + 3
            if at < 3:
                break
            continue
        if page.startswith(("<!", "<?"), begin):
            at = page.find(">", begin) + 1
            if at < 1:
                break
            continue
        found = scan.tag(begin)
        if found is None:
            take("<")
            at = begin + 1
            continue
        at, ends, tag, attributes = found
        inline = tag in _INLINE
        if ends:  # an end tag closes the nearest node of its name; one without a partner is dropped
            if not inline:
                flush()
            if (within[-1] if inline else open_)[tag] > 0:  # an inline end tag stays within its cell
                node = here
                while node.tag != tag:
                    node = node.up
                close(node)
            continue
        empty = attributes.rstrip().endswith("/")
        if tag in _RAW:
            end = scan.after(tag, at) if not empty else None
            if end is not None:
                at = end
            elif tag in ("script", "style") and not empty:
                break
            continue
        if tag in ("br", "hr"):
            text.append(" ")
        if not inline:
            flush()
        if tag in _VOID or empty:
            continue
        if tag in _ENDS_OWN and open_[tag] > 0:  # these end an open one of their kind
            node = here
            while node is not root and node.tag != tag and (node.tag in _INLINE or node.tag == "p"):
                node = node.up
            if node is not root and node.tag == tag:
                close(node)
        cost = _own_cost(tag, attributes, here.inside)
        here = _Node(tag, here, here.cost + cost, here.inside or tag in ("article", "main"), here.link or tag == "a")
        open_[tag] += 1
        if tag in _BORDERS:
            within.append(Counter())
        elif inline:
            within[-1][tag] += 1
        if not inline:
            block = here
    flush()
    return out


def _enclosed(node: _Node, any_article: bool) -> float:
    """What encloses a block, as a cost of content."""
    cost = node.cost if node.cost >= _UNSEEN else min(max(node.cost, -1.5), _MOST)
    return cost - 1.0 if node.inside else cost + 1.0 if any_article else cost


def costs(text: str, linked: int, node: _Node, any_article: bool) -> float:
    """The block's cost of being content less its cost of being boilerplate: negative speaks for content."""
    words = text.count(" ") + 1
    cost = 0.2 - min(words, 30) / 12.0 + 2.5 * (linked / len(text) if linked > 0 else 0) + _enclosed(node, any_article)
    if words > 3 and text[-1] in ".!?”\"'":
        cost -= 0.5
    if node.tag in _PROSE:
        cost -= 0.4
    if not node.tag:
        cost -= 1.0  # text that no tag encloses
    if text[0] == "©":
        cost += 3.0
    return cost


def _apart(a: _Node, b: _Node) -> int:
    """Levels from the two nodes up to their nearest common ancestor."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        n += 1
    return n


def minimum_cut(unary: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (True: content) that minimise the sum of costs: unary[i] if i is content, edges between unlike labels.

    Ties fall to boilerplate.
    """
    n = len(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        if w > 0 and a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    u = list(unary)
    label: list[bool | None] = [None] * n
    # what no set of neighbours can turn is settled, and pulls its neighbours
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None:
            continue
        pull = sum(near[i].values())
        if u[i] < -pull or u[i] >= pull:
            label[i] = u[i] < -pull
            for j, w in near[i].items():
                del near[j][i]
                u[j] += -w if label[i] else w
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        content = _max_flow(rest, u, near)
        for i in rest:
            label[i] = i in content
    return [bool(x) for x in label]


def _max_flow(ids: list[int], u: list[float], near: list[dict[int, float]]) -> set[int]:
    """Dinic's algorithm; the ids on the source's side of the least such cut."""
    source, sink = -1, -2
    left: dict[int, dict[int, float]] = {i: dict(near[i]) for i in ids}
    left[source], left[sink] = {}, {}
    for i in ids:
        if u[i] < 0:
            left[source][i], left[i][source] = -u[i], 0.0
        elif u[i] > 0:
            left[i][sink], left[sink][i] = u[i], 0.0
    tiny = 1e-9
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, w in left[i].items():
                if w > tiny and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return {i for i in level if i >= 0}
        arcs = {i: iter(list(left[i])) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(left[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    left[a][b] -= flow
                    left[b][a] = left[b].get(a, 0.0) + flow
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if left[a][b] <= tiny)
                for a in path[cut + 1 :]:
                    if a in arcs and a != sink:
                        arcs[a] = iter(list(left[a]))
                del path[cut + 1 :]
                continue
            for j in arcs[i]:
                if left[i][j] > tiny and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
            else:
                path.pop()
                if path:
                    level[i] = -1


def graph(found: list[tuple[str, int, _Node]]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """The cost of each block and the edges between blocks."""
    any_article = any(node.inside for _, _, node in found)
    unary = [costs(t, linked, node, any_article) for t, linked, node in found]
    around = [_enclosed(node, any_article) for _, _, node in found]
    edges: dict[tuple[int, int], float] = {}
    for i in range(1, len(found)):
        b = found[i][2]
        near = _apart(found[i - 1][2], b)
        edges[i - 1, i] = TIE * 0.5 ** max(0, near - 2) * math.exp(-abs(around[i - 1] - around[i]) / CONTRAST)
        if i > 1 and found[i - 2][2].up is b.up:  # one container, one block between
            edges[i - 2, i] = 0.5 * TIE * math.exp(-abs(around[i - 2] - around[i]) / CONTRAST)
    return unary, edges


def main_text(page: str) -> tuple[str, int, int]:
    """The main text, the number of blocks, and how many of them are content."""
    found = blocks(page)
    unary, edges = graph(found)
    label = minimum_cut(unary, edges)
    if found and not any(label) and min(unary) <= SEED:
        # links around a lone paragraph may outweigh it: what speaks most clearly for content is content, and the cut finds the rest
        unary[unary.index(min(unary))] = -math.inf
        label = minimum_cut(unary, edges)
    kept = [t for (t, _, _), x in zip(found, label, strict=True) if x]
    return " ".join(kept), len(found), len(kept)


def extract(pages: DataFrame) -> DataFrame:
    """pages with main_text, n_blocks and n_content."""
    rows = pages.select(F.struct(*pages.columns).alias("row"), "html")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [main_text(p.decode("utf-8", "replace")) for p in utf8(b.column("html"))]
            cols = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("row"), *cols], ["row", *OWN])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, main_text string, n_blocks long, n_content long")
    return out.select(*[F.col("row")[c].alias(c) for c in pages.columns if c not in OWN], *OWN)


def html_query(pages: DataFrame) -> DataFrame:
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
