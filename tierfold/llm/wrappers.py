"""Main text of web pages by wrapper induction.

Pages of a host are parsed to ordered trees of block elements and text. Siblings that look alike and stand next to each
other become one list node; others stay nodes of their own, in order. The trees of a host are aligned one after another
by simple tree matching: nodes of equal label that the best matching pairs become one node of the wrapper, and the rest is put
in between. A text of a page belongs to the slot that the same matching pairs it with.

Over all pages of the host it is then counted how often each text stands in each slot, and how much of a slot is link
text. A text is constant if at least ``CONSTANT_SHARE`` of the host's distinct pages with that slot have it there, and
three or more; the more pages agree, the more it tells. What varies is content, but for slots that are mostly links.
Constant texts that make up nearly all of a host's text tell of copied pages rather than of a template, which counts
against dropping them. What an element, role or class says (menus, footers, notices, adverts, forms, comments; article,
main) is a prior that this evidence is added to; it decides alone where a host has a page or two.

A host's distinct trees are dealt to groups of about ``FAN``, each group's wrapper is aligned with others' in rounds, and
nodes on less than a ``RARE``-th of the pages leave the wrapper, so no task holds more than a bounded number of small trees, however
large the host. Texts are counted by partial aggregates. What was learnt meets the pages in a broadcast if it is small
(``BROADCAST`` bytes, measured), so that no page is shuffled; else the pages' texts travel packed to it, those of hosts with over a
thousandth of all pages dealt to salts.

Null html: empty text. Null url: host ''. Pages without blocks: empty text. Broken markup: read as far as it goes, as
browsers do; like them, elements nested over 512 deep become siblings. Very long pages: whole. Repeated rows: a row each; equal pages
count once as evidence. Ties in an alignment: the later node. Empty table: no rows. Further columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from math import log, log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tierfold.llm.common import BROADCAST, cut, map_rows, meet, schema_of, weight

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math".split())
SKIPPED = frozenset("head nav footer aside button select menu dialog object audio video canvas figure".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar widget footer header masthead banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended comment comments commentlist respond reply replies "
    "disqus pagination pager toolbar skip copyright tags tagcloud byline search form hidden".split()
)

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
LABEL_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: A text is constant if at least this share of the host's distinct pages with its slot have it there, and so many at least: two may be alike by chance.
CONSTANT_SHARE, CONSTANT_PAGES = 0.8, 3
LINK_SHARE = 0.6
#: What is known before any alignment, in nats: of text in an article or main element, and of mostly links.
INSIDE, LINKS = 4.0, 3.0
#: The most that agreeing pages tell, and what the share of constant text on a host tells against it at most and at least.
MOST, COPIES, TEMPLATE = 6.0, 6.5, 2.0
#: Trees that are aligned in one group, about; the share of pages that a wrapper's node is on at least is one in RARE.
FAN, RARE = 64, 20
#: A label that comes back in more runs of siblings than this makes them prose: one list of several kinds of item.
RUNS = 8
#: Elements nested deeper become siblings.
DEEPEST = 512

sys.setrecursionlimit(max(sys.getrecursionlimit(), 16 * DEEPEST))  # trees are walked by recursion


@dataclass
class Block:
    """Text that stands by itself. path: labels from the root; skipped: in a template element; inside: in an article or main element."""

    path: tuple[str, ...]
    text: str
    links: int
    skipped: bool
    inside: bool
    #: Elements around it, by number, that only a class word or their being a form calls template; ``blocks`` settles these.
    soft: tuple[int, ...] = ()
    #: Block elements around it, by number, one for each label of the path.
    nodes: tuple[int, ...] = ()


@dataclass
class _Open:
    tag: str
    path: tuple[str, ...]
    skipped: bool
    inside: bool
    link: bool
    own: tuple[int, ...] = ()
    soft: tuple[int, ...] = ()
    nodes: tuple[int, ...] = ()


def _label(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """A node's label (element and class words); whether it is hidden or its role says template; whether a class word does; whether a whole class name does."""
    words: set[str] = set()
    said = whole = False
    if attributes and not attributes.isspace():
        for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
            value = a or b or c
            name = name.lower()
            if hidden or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                said = True
            elif name == "role":
                said |= value.lower() in ROLES
            elif name in ("class", "id"):
                words.update(w.lower() for w in LABEL_WORDS.findall(value))
                whole |= not BOILERPLATE.isdisjoint(value.lower().split())
    hint = tag == "form" or bool(words & BOILERPLATE) and tag not in ("html", "body", "article", "main")
    return (f"{tag}.{'.'.join(sorted(words))}" if words else tag), said, hint, whole


def _settle(out: list[Block], whole: list[bool]) -> None:
    """Blocks in soft elements are skipped, unless such an element must hold the content.

    It must if no article or main stands outside of soft elements, but in it; if over half of the page's text, links
    apart, is in it, and its class only has a telling word in a longer name; or if without it nothing would be left.
    """
    own = [(b, len(b.text) - b.links) for b in out if not b.skipped]
    total = sum(n for _, n in own)
    freed: set[int] = set()
    size: dict[int, int] = {}
    for b, n in own:
        for k in b.soft:
            size[k] = size.get(k, 0) + n
    freed.update(k for k, n in size.items() if not whole[k] and 2 * n > total)
    while True:
        held: dict[int, int] = {}
        if any(b.inside for b, _ in own):
            # An article that nothing but the soft elements around it hides; one within another soft element, as a comment's, waits.
            main = [(b, n) for b, n in own if b.inside]
            if any(freed.issuperset(b.soft) for b, _ in main):
                break
        elif not own or any(freed.issuperset(b.soft) for b, _ in own):
            break
        else:
            main = own
        for b, n in main:
            k = next(k for k in b.soft if k not in freed)
            held[k] = held.get(k, 0) + n
        best = max(held, key=lambda k: (held[k], -k))
        if main is own and 2 * held[best] <= total:
            break
        freed.add(best)
    for b, _ in own:
        b.skipped = not freed.issuperset(b.soft)


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    stack = [_Open("", (), False, False, False)]
    text: list[str] = []
    links = n_nodes = 0
    whole: list[bool] = []
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal links
        if text:
            t = " ".join(entities.unescape("".join(text)).split())
            if t:
                top = stack[-1]
                out.append(Block(top.path, t, min(links, len(t)), top.skipped, top.inside, top.soft, top.nodes))
            text.clear()
        links = 0

    def pop_to(k: int) -> None:
        if any(x.tag in BLOCKS for x in stack[k:]):
            flush()
        del stack[k:]

    while at < n:
        m = TAG.search(html, at)
        end = m.start() if m else n
        if end > at:
            piece = html[at:end]
            text.append(piece)
            if stack[-1].link:
                links += len(piece)
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if tag not in BLOCKS and stack[k].tag in BLOCKS:
                    break
            continue
        attributes = m.group(3)
        if tag in RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = close.end() if close else n
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in BLOCKS or tag in CLOSES:
            if tag in BLOCKS:
                flush()
                if tag in HEADINGS or tag not in ("td", "th", "tr", "tbody", "li", "dd", "dt"):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in ("p", *(HEADINGS if tag in HEADINGS else ())):
                            del stack[k:]
                            break
                        if stack[k].tag in BLOCKS:
                            break
            closes, scope = CLOSES.get(tag), SCOPES.get(tag)
            if closes:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in scope:
                        break
                    if stack[k].tag in closes:
                        del stack[k:]
                        break
        top = stack[-1]
        label, said, hint, entire = _label(tag, attributes)
        own: tuple[int, ...] = ()
        if hint:
            own = (len(whole),)
            whole.append(entire)
        soft = (*top.soft, *own)
        inside = top.inside or (tag in ("article", "main") and not said)
        # The header of an article may hold its title; other headers are the page's.
        skipped = top.skipped or said or tag in SKIPPED or (tag == "header" and not top.inside)
        if tag in HEADINGS and top.inside and not said and not hint and top.tag == "header":
            skipped = any(x.skipped for x in stack if x.tag != "header")
            soft = tuple(k for x in stack if x.tag != "header" for k in x.own)
        elif tag == "header" and top.inside:
            skipped = True
        path, nodes = top.path, top.nodes
        if tag in BLOCKS:
            n_nodes += 1
            path, nodes = (*path, label), (*nodes, n_nodes)
            if len(path) > DEEPEST:
                path, nodes = (*path[: DEEPEST - 1], label), (*nodes[: DEEPEST - 1], n_nodes)
        stack.append(_Open(tag, path, skipped, inside, top.link or tag == "a", own, soft, nodes))
        if len(stack) > 4 * DEEPEST:
            stack.pop(-2)
    flush()
    _settle(out, whole)
    return out


class Node:
    """A node of a page's or wrapper's tree. many: a list of items of this kind; n: pages; at: blocks of a page, at its leaves."""

    __slots__ = ("at", "children", "label", "many", "n", "sign")

    def __init__(self, label: str, children: list[Node] | None = None, many: bool = False, n: int = 1, at: list[int] | None = None):
        self.label, self.children, self.many, self.n, self.at = label, children or [], many, n, at or []
        self.sign = 0

    def packed(self) -> list:
        return [self.label, int(self.many), self.n, [c.packed() for c in self.children]]

    @staticmethod
    def unpacked(x: list) -> Node:
        return Node(x[0], [Node.unpacked(c) for c in x[3]], bool(x[1]), x[2])

    def leaves(self) -> list[Node]:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.children:
                todo += reversed(node.children)
            elif node.label:
                out.append(node)
        return out


def tree_of(found: list[Block]) -> Node:
    """The ordered tree of a page's blocks; a text is a leaf, '#a' if most of it is link text."""
    root = Node("")
    stack: list[tuple[int, Node]] = []
    for k, b in enumerate(found):
        depth = 0
        while depth < len(stack) and depth < len(b.nodes) and stack[depth][0] == b.nodes[depth]:
            depth += 1
        del stack[depth:]
        for number, label in zip(b.nodes[depth:], b.path[depth:], strict=True):
            node = Node(label)
            (stack[-1][1] if stack else root).children.append(node)
            stack.append((number, node))
        (stack[-1][1] if stack else root).children.append(Node("#a" if 2 * b.links > len(b.text) else "#", at=[k]))
    return root


def _join(a: Node, b: Node) -> None:
    """Two items of one look become items of a list."""
    a.at += b.at
    for x, y in zip(a.children, b.children, strict=True):
        x.many |= y.many
        _join(x, y)


def _blend(a: Node, b: Node) -> None:
    """``b`` and all below it put into ``a`` by label alone."""
    a.at += b.at
    for y in b.children:
        x = next((x for x in a.children if x.label == y.label), None)
        if x is None:
            a.children.append(y)
        else:
            x.many = True
            _blend(x, y)


def fold(node: Node) -> Node:
    """Neighbours of one look as one list node, from the leaves up: texts and elements of text alone from two on, others from three."""
    groups: list[list[Node]] = []
    for c in map(fold, node.children):
        if groups and groups[-1][0].sign == c.sign:
            groups[-1].append(c)
        else:
            groups.append([c])
    runs: list[Node] = []
    for g in groups:
        if len(g) == 1 or len(g) == 2 and any(c.children for c in g[0].children):
            runs += g
            continue
        for other in g[1:]:
            _join(g[0], other)
        g[0].many = True
        runs.append(g[0])
    often = {label for label, n in Counter(r.label for r in runs).items() if n > RUNS}
    if often:
        on = [k for k, r in enumerate(runs) if r.label in often]
        prose = Node("*")
        _blend(prose, Node("*", runs[on[0] : on[-1] + 1]))
        runs[on[0] : on[-1] + 1] = [prose]
    node.children = runs
    node.sign = hash((node.label, *(r.sign for r in runs)))
    return node


def match(a: Node, b: Node, memo: dict[tuple[int, int], int]) -> int:
    """Simple tree matching: the most pairs of equal labels, order and ancestry kept. A list node of ``a`` may take several siblings of ``b``."""
    if a.label != b.label:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = _table(a, b, memo)[-1][-1] + 1
    return memo[key]


def _table(a: Node, b: Node, memo: dict[tuple[int, int], int]) -> list[list[int]]:
    """Best matchings of the first i children of ``a`` with the first j of ``b``."""
    rows = [[0] * (len(b.children) + 1)]
    for x in a.children:
        row, new = rows[-1], [0]
        for j, y in enumerate(b.children):
            best = row[j + 1] if row[j + 1] > new[j] else new[j]
            if x.label == y.label:
                s = match(x, y, memo)
                best = max(best, row[j] + s, new[j] + s if x.many else 0)
            new.append(best)
        rows.append(new)
    return rows


def aligned(a: Node, b: Node, memo: dict[tuple[int, int], int]) -> list[tuple[Node, Node]]:
    """The children of two matched nodes that the best matching pairs."""
    best = _table(a, b, memo)
    out = []
    i, j = len(a.children), len(b.children)
    while i and j:
        x, y = a.children[i - 1], b.children[j - 1]
        s = match(x, y, memo)
        if s and best[i][j] == best[i - 1][j - 1] + s:
            out.append((x, y))
            i, j = i - 1, j - 1
        elif s and x.many and best[i][j] == best[i][j - 1] + s:
            out.append((x, y))
            j -= 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def merge(wrapper: Node, page: Node) -> None:
    """``page`` aligned with ``wrapper``; what has no partner is put in after the partner of what stands before it."""
    memo: dict[tuple[int, int], int] = {}

    def into(w: Node, p: Node) -> None:
        w.many |= p.many
        partner = {id(y): x for x, y in aligned(w, p, memo)}
        met: set[int] = set()
        place = 0
        for y in p.children:
            x = partner.get(id(y))
            if x is None:
                w.children.insert(place, y)
                place += 1
                continue
            if id(x) not in met:
                x.n += y.n
                met.add(id(x))
            into(x, y)
            place = next(k for k, c in enumerate(w.children) if c is x) + 1

    wrapper.n += page.n
    into(wrapper, page)


def slots(wrapper: Node, page: Node) -> list[int]:
    """For each leaf of a page's tree, the number of the wrapper's leaf that it is aligned with, or -1."""
    number = {id(x): k for k, x in enumerate(wrapper.leaves())}
    memo: dict[tuple[int, int], int] = {}
    found: dict[int, int] = {}
    todo = [(wrapper, page)]
    while todo:
        for x, y in aligned(*todo.pop(), memo):
            found[id(y)] = number.get(id(x), -1)
            todo.append((x, y))
    return [found.get(id(y), -1) for y in page.leaves()]


def dumps(tree: Node) -> str:
    return json.dumps(tree.packed(), ensure_ascii=False, separators=(",", ":"))


def loads(text: str) -> Node:
    return Node.unpacked(json.loads(text))


def induced(trees: list[tuple[str, int | None]]) -> str:
    """The wrapper of some trees or wrappers (as text; pages that have a tree), those of most pages first."""
    wrapper = Node("", n=0)
    for text, n in sorted(trees, key=lambda x: (-(x[1] or 0), x[0])):
        tree = loads(text)
        if n is not None:
            todo = [tree]
            while todo:
                node = todo.pop()
                node.n = n
                todo += node.children
        merge(wrapper, tree)
    todo = [wrapper]
    while todo:
        node = todo.pop()
        node.children = [c for c in node.children if c.n * RARE >= wrapper.n]
        todo += node.children
    return dumps(wrapper)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


@dataclass
class Parsed:
    """A page: its tree as text, and of its blocks that may be content the leaf, the text, the length of links, and whether it is in an article."""

    shape: str
    blocks: list[tuple[int, str, int, bool]]

    @staticmethod
    def of(html: str) -> Parsed:
        found = blocks(html)
        tree = fold(tree_of(found))
        leaf = {k: i for i, x in enumerate(tree.leaves()) for k in x.at}
        on = [k for k, b in enumerate(found) if not b.skipped]
        if any(found[k].inside for k in on):
            on = [k for k in on if found[k].inside]
        return Parsed(dumps(tree), [(leaf[k], found[k].text, found[k].links, found[k].inside) for k in on])

    def pack(self) -> bytes:
        return zstandard.compress(json.dumps([self.shape, self.blocks]).encode("utf-8", "surrogatepass"), 3)

    @staticmethod
    def unpack(data: bytes) -> Parsed:
        shape, found = json.loads(zstandard.decompress(data))
        return Parsed(shape, [tuple(b) for b in found])


#: Of each block of a page that may be content.
ITEM = np.dtype([("leaf", "<u4"), ("text", "<i8"), ("chars", "<u4"), ("links", "<u4")])


def _evidence(rows: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"host": [], "page": [], "shape": [], "items": []}
    for host, html in zip(rows["host"], rows["html"], strict=True):
        p = Parsed.of(html)
        items = np.array([(leaf, _hash(text), len(text), links) for leaf, text, links, _ in p.blocks], ITEM)
        out["host"].append(host)
        out["page"].append(_hash(p.shape + "".join(text for _, text, _, _ in p.blocks)))
        out["shape"].append(p.shape)
        out["items"].append(items.tobytes())
    return out


class Wrapper:
    """A host's wrapper as text, and where the leaves of pages of a shape belong in it."""

    def __init__(self, text: str | None):
        self.tree = loads(text) if text else Node("")
        self.known: dict[str, list[int]] = {}

    def slots(self, shape: str) -> list[int]:
        if shape not in self.known:
            if len(self.known) >= 256:
                self.known.clear()
            self.known[shape] = slots(self.tree, loads(shape))
        return self.known[shape]


def of_late(make: Callable, most: int = 256) -> Callable:
    """What ``make`` gives for a key and further values, kept for some keys."""
    made: dict = {}

    def get(key, *rest):
        if key not in made:
            if len(made) >= most:
                made.clear()
            made[key] = make(*rest)
        return made[key]

    return get


class Extractor:
    """Content of a page, given what is known of its host: wrapper, slots that are mostly links, constant texts, and the share of the host's text that these make up."""

    def __init__(self, wrapper: str | None, links: list[int] | None, constants: list | None, share: float | None):
        self.wrapper = Wrapper(wrapper)
        self.links = set(links or [])
        self.pages = {(c["slot"], c["text"]): c["pages"] for c in constants or []}
        q = min(0.999, max(0.001, share or 0.0))
        self.copies = min(COPIES, max(-TEMPLATE, 2 * log(q / (1 - q))))

    def score(self, slot: int, text: str, inside: bool) -> float:
        out = INSIDE if inside else 0.0
        if slot in self.links:
            out -= LINKS
        n = self.pages.get((slot, _hash(text))) if self.pages else None
        if n is not None:
            out -= min(MOST, 2 * log2(n / 2)) - self.copies
        return out

    def __call__(self, page: Parsed) -> str:
        place = self.wrapper.slots(page.shape)
        return "\n".join(text for leaf, text, _, inside in page.blocks if self.score(place[leaf], text, inside) >= 0)


def wrappers_of(shapes: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, wrapper) of (host, shape, n) rows, in groups and rounds."""
    ddl = "host string, group long, wrapper string"
    arrow = to_arrow_schema(schema_of(ddl))

    def first(key: tuple, t: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([{"host": key[0].as_py(), "group": key[1].as_py(), "wrapper": induced(list(zip(t["shape"].to_pylist(), t["n"].to_pylist(), strict=True)))}], arrow)

    def later(key: tuple, t: pa.Table) -> pa.Table:
        found = t["wrapper"].to_pylist()
        return pa.Table.from_pylist([{"host": key[0].as_py(), "group": key[1].as_py(), "wrapper": found[0] if len(found) == 1 else induced([(x, None) for x in found])}], arrow)

    sizes = shapes.groupBy("host").agg(F.ceil(F.count("*") / fan).alias("groups"))
    dealt = shapes.join(sizes, "host").withColumn("group", F.pmod(F.xxhash64("shape"), F.col("groups")))
    out = cut(dealt.groupBy("host", "group").applyInArrow(first, ddl))
    while (out.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        out = cut(out.withColumn("group", F.floor(F.col("group") / fan)).groupBy("host", "group").applyInArrow(later, ddl))
    return out.select("host", "wrapper")


def induce(pages: DataFrame, bound: int = BROADCAST) -> DataFrame:
    """(host, wrapper, links, constants, share) from (host, html) rows."""
    # Equal pages of a host are one piece of evidence.
    seen = cut(map_rows(pages.select("host", "html"), "host string, page long, shape string, items binary", lambda: _evidence).dropDuplicates(["host", "page"]))
    wrapper = cut(wrappers_of(seen.groupBy("host", "shape").agg(F.count("*").alias("n"))))

    def make():
        get = of_late(Wrapper)

        def f(rows):
            out: dict[str, list] = {k: [] for k in ("host", "slot", "text", "pages", "first", "chars", "links")}
            for host, shape, items, told in zip(rows["host"], rows["shape"], rows["items"], rows["wrapper"], strict=True):
                place = get(host, told).slots(shape)
                sums: dict[tuple[int, int], list[int]] = {}
                for leaf, text, chars, links in np.frombuffer(items, ITEM).tolist():
                    slot = place[leaf]
                    x = sums.setdefault((slot, text if slot >= 0 else 0), [0, 0])
                    x[0] += chars
                    x[1] += links
                met: set[int] = set()
                for (slot, text), (chars, links) in sums.items():
                    for k, v in zip(out, (host, slot, text, 1, int(slot not in met), chars, links), strict=True):
                        out[k].append(v)
                    met.add(slot)
            return out

        return f

    each = map_rows(meet(seen.select("host", "shape", "items"), wrapper, ["host"], ["wrapper"], bound), "host string, slot int, text long, pages long, first long, chars long, links long", make)
    texts = cut(each.groupBy("host", "slot", "text").agg(*[F.sum(c).alias(c) for c in ("pages", "first", "chars", "links")]))
    by_slot = texts.groupBy("host", "slot").agg(F.sum("first").alias("of"), F.sum("chars").alias("slot_chars"), F.sum("links").alias("slot_links"))
    total = by_slot.groupBy("host").agg(
        F.sum("slot_chars").alias("total"), F.sort_array(F.collect_list(F.when((F.col("slot") >= 0) & (F.col("slot_links") > LINK_SHARE * F.col("slot_chars")), F.col("slot")))).alias("links")
    )
    constant = texts.where((F.col("slot") >= 0) & (F.col("pages") >= CONSTANT_PAGES)).join(by_slot, ["host", "slot"]).where(F.col("pages") >= CONSTANT_SHARE * F.col("of"))
    constants = constant.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "text", "pages"))).alias("constants"), F.sum("chars").alias("chars"))
    out = wrapper.join(total, "host", "left").join(constants, "host", "left")
    return out.select("host", "wrapper", "links", "constants", (F.col("chars") / F.col("total")).alias("share"))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bound: int = BROADCAST) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    host = F.coalesce(F.lower(F.regexp_extract(df[url_col], r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    pages = df.select(df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("url"), F.coalesce(df[html_col].cast("string"), F.lit("")).alias("html"), host.alias("host"))
    model = cut(induce(pages, bound))
    weigh = ["wrapper", "links", "constants"]
    small = weight(model, weigh) <= bound

    def make():
        get = of_late(Extractor)

        def f(rows):
            out = {"page_id": rows["page_id"], "url": rows["url"], "text": [], "n_chars": []}
            for host, page, *told in zip(rows["host"], rows["html" if small else "packed"], rows["wrapper"], rows["links"], rows["constants"], rows["share"], strict=True):
                text = get(host, *told)(Parsed.of(page) if small else Parsed.unpack(page))
                out["text"].append(text)
                out["n_chars"].append(len(text))
            return out

        return f

    if not small:
        pages = map_rows(pages, "page_id long, url string, host string, packed binary", lambda: lambda r: {"page_id": r["page_id"], "url": r["url"], "host": r["host"], "packed": [Parsed.of(x).pack() for x in r["html"]]})
    return map_rows(meet(pages, model, ["host"], weigh, bound), "page_id long, url string, text string, n_chars long", make)
