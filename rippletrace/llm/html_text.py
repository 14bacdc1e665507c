"""Main text of web pages by wrapper induction.

Every page of a host speaks for its wrapper. Each page is measured once: the keys
(tag and class names) of its elements in document order, a hash of each element's own text,
and the length of its text. The different structures of a host are merged into one wrapper
tree, shares of a fixed number first, then the shares: trees are aligned by simple tree
matching (keys agree, children are matched in order by dynamic programming) and elements
without a partner are put in at their place, so each layout is part of the wrapper. Each
page is then aligned with it, and (wrapper node, text) is counted over all different pages.
A text is template if it is on at least three different pages and on more than half
of those that have its node; any other is a slot. The content
slot is found by walking down from the body into the container that holds most
of the varying text of all pages outside navigation, advertising and the like. Last, the
text of each page is read from the node matched with the content slot, without template
texts and boilerplate parts; a paragraph, heading, list item or cell (prose) is template only if all
text of the container around it is. Where class names alone would leave a page without
text, they are not heeded. A page without a matching slot has its slot found on its own.
Hosts with many pages are dealt by host and a hash to fill many tasks; no result depends on it.

Text: character references are decoded, white space inside a block becomes one
space, blocks are joined by two line feeds in page order; nothing is cut.

Groups stream through a task in sorted order; a task holds one wrapper and one
page. Defined cases: null html or url are an empty page, a page
without host; malformed markup is closed as browsers do, stray ends are ignored;
repeated rows are read one by one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, cut, prepare

#: Different pages that a template text needs; shares in which the structures of a host are merged first.
LEAST, SHARES = 3, 64
#: Pages of a task's group at least; and the share of all pages over which a host is split (so at most 1 / share hosts are).
GROUP, HOT_SHARE = 64, 1 / 2000
#: Structures that an aligner remembers.
REMEMBERED = 20_000
#: A walk goes into a container that holds this share of the text.
HOLDS = 0.6
#: Children products up to which a match keeps its whole table; larger ones are halved, in linear memory, with the same weight.
TABLE = 4096

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
FOREIGN = frozenset("svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("html body div section main article table tbody tr td center form".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th figcaption".split())
#: Elements that are never article text.
DROPPED = frozenset("nav footer aside form button select option label input dialog menu head object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert gdpr "
    "sidebar aside comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe signup breadcrumb "
    "breadcrumbs menu nav navbar navigation footer masthead popup modal overlay widget toolbar pagination pager login search skip".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[a-z]+")
#: A name part after one of these says how the rest is laid out, not what the element is.
LAYOUT = frozenset("no non not without with has hide hidden is".split())


class Node:
    __slots__ = ("tag", "key", "children", "junk", "named", "loose")

    def __init__(self, tag: str, key: str, junk: bool, named: bool = False, loose: bool = False):
        self.tag, self.key, self.junk, self.named = tag, key, junk, named  # named: a class or id alone makes it boilerplate
        self.loose = loose  # named only by a part of a name, as in social-science
        self.children: list = []  # nodes and strings


def _named(value: str) -> int:
    """2: a class or id is one of `WORDS`; 1: a part of one is; 0: none."""
    found = 0
    for name in value.split():
        words = _WORD.findall(name)
        if len(words) == 1 and words[0] in WORDS:
            return 2
        if not WORDS.isdisjoint(words) and LAYOUT.isdisjoint(words):
            found = 1
    return found


@functools.lru_cache(maxsize=1 << 15)
def _kind(tag: str, attributes: str, inside_article: bool) -> tuple[str, bool, bool, bool]:
    """(key, junk, named, loose) of an element."""
    name, named, junk = "", 0, tag in DROPPED or tag in RAW or (tag == "header" and not inside_article)
    for k, v in _ATTRIBUTE.findall(attributes) if attributes else ():
        k, v = k.lower(), v.strip("\"'").lower()
        if k == "class":
            name = re.sub(r"\d+", "#", v)
        if k in ("class", "id"):
            if tag not in ("html", "body", "article", "main"):
                named = max(named, _named(v))
        elif k == "role":
            junk = junk or v in ROLES
        elif k == "hidden" or k == "aria-hidden" and v == "true":
            junk = True
    return f"{tag}.{name}", junk or named > 0, named > 0 and not junk, named == 1 and not junk


def parse(source: str) -> Node:
    """The element tree of a page; missing ends are implied. A part of a name does not make what holds most of the text boilerplate."""
    root = Node("html", "html.", False)
    stack, at, low = [root], 0, None
    is_open: dict[str, int] = {}  # open elements by tag
    any_loose = False
    marks = [0]  # places in the stack of blocks and of what an option ends at
    articles = foreign = 0

    def close_from(k: int) -> None:
        nonlocal articles, foreign
        for n in stack[k:]:
            is_open[n.tag] -= 1
            articles -= n.tag == "article"
            foreign -= n.tag in FOREIGN
        del stack[k:]
        while marks[-1] >= k:
            marks.pop()

    match = _TOKEN.search(source)
    while match:
        if match.start() > at:
            stack[-1].children.append(source[at : match.start()])
        at = match.end()
        close, tag, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if tag:
            tag = tag.lower()
            if close:
                if stack[-1].tag == tag and len(stack) > 1:
                    stack.pop()
                    is_open[tag] -= 1
                    articles -= tag == "article"
                    foreign -= tag in FOREIGN
                    if marks[-1] == len(stack):
                        marks.pop()
                elif is_open.get(tag):
                    close_from(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            elif tag == "br" or tag == "wbr":
                stack[-1].children.append(" " if tag == "br" else "")
            elif tag == "html":
                pass
            else:
                ends, scope = CLOSES.get(tag, ()), SCOPE.get(tag, ())
                if tag in BLOCK and tag != "body" and stack[marks[-1]].tag == "p":
                    close_from(marks[-1])
                if ends and any(map(is_open.get, ends)):
                    for k in reversed(marks[1:]):
                        if stack[k].tag in scope:
                            break
                        if stack[k].tag in ends:
                            close_from(k)
                            break
                if tag == "body":
                    close_from(1)
                node = Node(tag, *_kind(tag, attributes, articles > 0))
                any_loose = any_loose or node.loose
                stack[-1].children.append(node)
                empty = attributes.endswith("/") and (foreign > 0 or tag in FOREIGN)  # elsewhere a slash means nothing
                if tag in RAW and not empty:
                    low = low or source.lower()
                    if len(low) != len(source):  # a character changed length in lower case
                        low = re.sub("[A-Z]", lambda m: m[0].lower(), source)
                    end = low.find(f"</{tag}", at)
                    at = len(source) if end < 0 else end
                elif tag not in VOID and not empty:
                    if tag in BLOCK or tag in ("option", "select"):
                        marks.append(len(stack))
                    stack.append(node)
                    is_open[tag] = is_open.get(tag, 0) + 1
                    articles += tag == "article"
                    foreign += tag in FOREIGN
        match = _TOKEN.search(source, at)
    if at < len(source):
        stack[-1].children.append(source[at:])
    if any_loose:
        _keep_main(root)
    return root


def _keep_main(root: Node) -> None:
    """Clear the mark of nodes that a part of a name made boilerplate where they hold over half of the page's text."""
    loose = []
    stack = [root]
    while stack:
        n = stack.pop()
        if n.loose:
            loose.append(n)
            n.junk = False
        if not n.junk:
            stack.extend(_elements(n))
    if loose:
        size = _sizes(root, lambda node: False)
        for n in loose:
            n.junk = 2 * size[id(n)] <= size[id(root)]
            n.named = n.named and n.junk


def _elements(node: Node) -> list[Node]:
    return [c for c in node.children if not isinstance(c, str)]


def own_texts(root: Node) -> dict[int, int]:
    """For each node, a hash of its own text: its strings and inline parts, up to white space; 0 where there is none."""
    order, stack, out = [], [root], {}
    while stack:
        n = stack.pop()
        order.append(n)
        for c in n.children:
            if not isinstance(c, str):
                stack.append(c)
    for n in reversed(order):
        parts = []
        for c in n.children:
            if isinstance(c, str):
                if c and not c.isspace():
                    parts.append(" ".join(c.split()))
            elif not (c.junk or c.tag in BLOCK) and out[id(c)]:
                parts.append(f"\x00{out[id(c)]}")
        out[id(n)] = _hash("\x01".join(parts)) if parts else 0
    return out


class Aligner:
    """Maximum order-preserving matches of one tree with others (simple tree matching), at every width and depth.

    Equal structures get the same number, so a pair of structures is matched once. Equal
    ends of two lists of children are paired at once: no match can weigh more.
    """

    def __init__(self, root: Node):
        self.root = root
        self._begin()

    def _begin(self):
        self.numbers: dict[tuple, int] = {}
        self.shapes: list[tuple] = []  # number -> (key, numbers of the children, nodes)
        self.known: dict[tuple[int, int], tuple[int, list]] = {}  # weight and pairs of children
        self.own = self._number(self.root)

    def _number(self, root: Node) -> dict[int, int]:
        order, stack, out = [], [root], {}
        while stack:
            n = stack.pop()
            order.append((n, cs := _elements(n)))
            stack.extend(cs)
        for n, cs in reversed(order):
            children = tuple([out[id(c)] for c in cs])
            number = self.numbers.get((n.key, children))
            if number is None:
                number = self.numbers[n.key, children] = len(self.shapes)
                self.shapes.append((n.key, children, 1 + sum(self.shapes[c][2] for c in children)))
            out[id(n)] = number
        return out

    def _weight(self, x: int, y: int) -> int:
        if x == y:
            return self.shapes[x][2]
        return self.known[x, y][0] if self.shapes[x][0] == self.shapes[y][0] else 0

    def _row(self, xs, ys) -> np.ndarray:
        """Weights of the best matches of `xs` with each beginning of `ys`."""
        kinds, at = np.unique(np.array(ys), return_inverse=True)
        row, rows = np.zeros(len(ys) + 1, np.int64), {}
        for x in xs:
            if x not in rows:
                rows[x] = np.array([self._weight(x, y) for y in kinds.tolist()], np.int64)[at]
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + rows[x]))
        return row

    def _match(self, xs, ys) -> list[tuple[int, int]]:
        pairs, stack = [], [(0, len(xs), 0, len(ys))]
        while stack:
            i, k, j, l = stack.pop()
            while i < k and j < l and xs[i] == ys[j]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            while i < k and j < l and xs[k - 1] == ys[l - 1]:
                k, l = k - 1, l - 1
                pairs.append((k, l))
            if i == k or j == l:
                continue
            if (k - i) * (l - j) > TABLE and k - i > 1:
                middle = (i + k) // 2
                total = self._row(xs[i:middle], ys[j:l]) + self._row(xs[middle:k][::-1], ys[j:l][::-1])[::-1]
                cut_at = j + int(total.argmax())
                stack += [(i, middle, j, cut_at), (middle, k, cut_at, l)]
                continue
            table = [[0] * (l - j + 1) for _ in range(k - i + 1)]
            for p in range(k - i):
                row, above = table[p + 1], table[p]
                for q in range(l - j):
                    w = self._weight(xs[i + p], ys[j + q])
                    row[q + 1] = max(above[q + 1], row[q], above[q] + w if w else 0)
            p, q = k - i, l - j
            while p and q:
                if table[p][q] == table[p - 1][q]:
                    p -= 1
                elif table[p][q] == table[p][q - 1]:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    pairs.append((i + p, j + q))
        return pairs

    def _learn(self, x: int, y: int) -> None:
        """Fill `known` for two structures with the same key and all they need."""
        known, shapes, stack = self.known, self.shapes, [(x, y)]
        while stack:
            x, y = stack[-1]
            if (x, y) in known or x == y:
                stack.pop()
                continue
            xs, ys = shapes[x][1], shapes[y][1]
            i, k, l = 0, len(xs), len(ys)
            while i < k and i < l and xs[i] == ys[i]:
                i += 1
            while i < k and i < l and xs[k - 1] == ys[l - 1]:
                k, l = k - 1, l - 1
            by: dict[str, set] = {}
            for q in ys[i:l]:
                by.setdefault(shapes[q][0], set()).add(q)
            missing = [(p, q) for p in sorted(set(xs[i:k])) for q in sorted(by.get(shapes[p][0], ())) if p != q and (p, q) not in known]
            if missing:
                stack += missing
                continue
            pairs = self._match(xs, ys)
            known[x, y] = (1 + sum(self._weight(xs[p], ys[q]) for p, q in pairs), pairs)
            stack.pop()

    def pairs(self, other: Node) -> list[tuple[Node, Node]]:
        """Matched nodes of the tree and another, if the roots agree."""
        if self.root.key != other.key:
            return []
        if len(self.shapes) + len(self.known) > REMEMBERED:
            self._begin()
        theirs = self._number(other)
        self._learn(self.own[id(self.root)], theirs[id(other)])
        out, stack = [], [(self.root, other)]
        while stack:
            x, y = stack.pop()
            out.append((x, y))
            a, b = self.own[id(x)], theirs[id(y)]
            xs, ys = _elements(x), _elements(y)
            stack.extend(zip(xs, ys) if a == b else [(xs[p], ys[q]) for p, q in self.known[a, b][1]])
        return out


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of a maximum order-preserving match of two trees whose roots agree (simple tree matching)."""
    return Aligner(a).pairs(b)


def _sizes(root: Node, drop) -> dict[int, int]:
    """Text length under each node, without dropped nodes."""
    size: dict[int, int] = {}
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        if node.junk or drop(node):
            size[id(node)] = 0
        elif done:
            size[id(node)] = sum(len(c.strip()) if isinstance(c, str) else size[id(c)] for c in node.children)
        else:
            stack.append((node, True))
            stack.extend((c, False) for c in node.children if not isinstance(c, str))
    return size


def content_slot(root: Node, drop=lambda node: False) -> Node:
    """Down from the root into the container with most text; an article or main element ends the walk."""
    return _walk(root, _sizes(root, drop))


def _walk(root: Node, size: dict[int, int]) -> Node:
    node = root
    while node.tag not in ("article", "main"):
        options = [c for c in _elements(node) if c.tag in CONTAINER and size[id(c)] > 0]
        best = max(options, key=lambda c: size[id(c)], default=None)
        if best is None or size[id(best)] < HOLDS * size[id(node)]:
            break
        node = best
    return node


def _preorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(reversed(_elements(n)))
    return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - 2**63 if text else 0


def flat(root: Node) -> tuple[list[int], list[str]]:
    """Depths and keys of the elements, in document order."""
    depths, keys, stack = [], [], [(root, 0)]
    while stack:
        n, d = stack.pop()
        depths.append(d)
        keys.append(n.key)
        stack.extend((c, d + 1) for c in reversed(_elements(n)))
    return depths, keys


def tree(depths: list[int], keys: list[str]) -> Node:
    """The elements of `flat`, without texts."""
    path: list[Node] = []
    for d, key in zip(depths, keys):
        node = Node(key.partition(".")[0], key, False)
        del path[d:]
        if path:
            path[-1].children.append(node)
        path.append(node)
    return path[0]


def measure(root: Node) -> tuple[int, int, list[int], list[str], list[int], list[int]]:
    """(hash of the whole text, hash of the structure, depths, keys, own text hashes, own lengths without boilerplate parts)."""
    depths, keys = flat(root)
    texts, lengths, under, own = [], [], None, own_texts(root)
    for n, d in zip(_preorder(root), depths):
        if under is not None and d <= under:
            under = None
        if under is None and n.junk:
            under = d
        texts.append(own[id(n)])
        lengths.append(0 if under is not None else sum(len(c.strip()) for c in n.children if isinstance(c, str)))
    return _hash(_own_all(root)) or _hash(repr(texts)), _hash(repr((depths, keys))), depths, keys, texts, lengths


def merge(a: Node, b: Node) -> None:
    """Put what `b` has and `a` lacks into `a`, in order."""
    place = {id(y): x for x, y in align(a, b)}
    for y in _preorder(b):
        x = place.get(id(y))
        if x is not None:
            at, index = 0, {id(c): i for i, c in enumerate(x.children)}
            new: list[tuple[int, Node]] = []
            for c in y.children:
                if id(c) in place:
                    at = index[id(place[id(c)])] + 1
                else:
                    new.append((at, c))
            for i, c in reversed(new):
                x.children.insert(i, c)


def count(aligner: Aligner, pages) -> Counter:
    """(node, text) -> pages, and (node, text, 'length') -> length, over pages as (depths, keys, texts, lengths)."""
    number = {id(n): i for i, n in enumerate(_preorder(aligner.root))}
    found: Counter = Counter()
    shape, pairs = None, []
    for depths, keys, texts, lengths in pages:
        if (depths, keys) != shape:
            page, shape = tree(depths, keys), (depths, keys)
            at = {id(n): i for i, n in enumerate(_preorder(page))}
            pairs = [(number[id(a)], at[id(b)]) for a, b in aligner.pairs(page)]
        for a, b in pairs:
            found[a, texts[b]] += 1
            if lengths[b]:
                found[a, texts[b], "length"] += lengths[b]
    return found


class Wrapper:
    """A wrapper tree with its template texts (node -> hash) and the length of varying text of its nodes."""

    def __init__(self, root: Node, template: dict[int, int], varying: dict[int, int]):
        self.aligner = Aligner(root)
        nodes = _preorder(root)
        self.template = {id(nodes[i]): t for i, t in template.items()}
        size = {id(n): varying.get(i, 0) for i, n in enumerate(nodes)}
        for n in reversed(nodes):
            size[id(n)] += sum(size[id(c)] for c in n.children)
        self.slot = _walk(root, size)

    def read(self, page: Node) -> str:
        pairs = self.aligner.pairs(page)
        slot = next((b for a, b in pairs if a is self.slot), None)
        own = own_texts(page) if self.template else {}
        fixed = {id(b): b for a, b in pairs if id(a) in self.template and self.template[id(a)] == own[id(b)]}
        if any(n.tag in PROSE for n in fixed.values()):
            alive = _varying(page, fixed)
            fixed = {i: n for i, n in fixed.items() if n.tag not in PROSE or not alive.get(i, False)}
        text = self._blocks(page, slot, fixed)
        if not text and self.template and (named := [n for n in _preorder(page) if n.named]):
            for n in named:  # the names leave nothing, so what varies decides alone
                n.junk = False
            text = self._blocks(page, None, fixed)
        return text

    def _blocks(self, page: Node, slot: Node | None, fixed) -> str:
        if slot is None or self.slot.tag in ("html", "body"):
            slot = content_slot(page, lambda n: id(n) in fixed and not _inner_blocks(n))
        return read_blocks(slot, fixed)


def _own_all(root: Node) -> str:
    return read_blocks(root, frozenset())


def _varying(root: Node, fixed) -> dict[int, bool]:
    """For each fixed node, whether the container around it holds text that is not fixed."""
    around, holds, met = {id(root): None}, {id(root): False}, {}
    stack = [(root, id(root))]
    while stack:
        n, box = stack.pop()
        if n.junk:
            continue
        if id(n) in fixed:
            met[id(n)] = box
        elif any(isinstance(c, str) and not c.isspace() and c for c in n.children):
            at = box
            while at is not None and not holds[at]:
                holds[at] = True
                at = around[at]
        inside = box
        if n.tag in CONTAINER and id(n) != box:
            inside = id(n)
            around[inside], holds[inside] = box, False
        stack.extend((c, inside) for c in (_inner_blocks(n) if id(n) in fixed else _elements(n)))
    return {i: holds[box] for i, box in met.items()}


def _inner_blocks(node: Node) -> list[Node]:
    """The blocks in a node and its inline parts, in order."""
    out, stack = [], list(reversed(_elements(node)))
    while stack:
        n = stack.pop()
        if n.tag in BLOCK:
            out.append(n)
        else:
            stack.extend(reversed(_elements(n)))
    return out


def read_blocks(root: Node, fixed) -> str:
    """Blocks of text under a node, in page order, without the own texts of fixed nodes."""
    blocks, now = [], []

    def flush():
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    stack: list = [root]
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            now.append(html.unescape(n) if "&" in n else n)
        elif n is root or not n.junk:
            if n.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(_inner_blocks(n) if id(n) in fixed else n.children))
    flush()
    return "\n\n".join(blocks)


def _shape_pass(batches):
    """(host, html) -> one row of measures for each page with text."""
    for batch in batches:
        rows = [(h, *measure(parse(s))) for h, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if s]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["host", "whole", "shape", "depths", "keys", "texts", "lengths"])


def _merge_pass(batches):
    """Rows (host, share, shape, depths, keys), sorted -> (host, share, depths, keys), one for each share of a host."""
    place, now, last = None, None, None

    def row():
        depths, keys = flat(now)
        return pa.RecordBatch.from_arrays([pa.array([place[0]], pa.string()), pa.array([place[1]], pa.int64()), pa.array([depths], pa.list_(pa.int32())), pa.array([keys], pa.list_(pa.string()))], names=["host", "share", "depths", "keys"])

    for batch in batches:
        for host, share, shape, depths, keys in zip(*(c.to_pylist() for c in batch.columns)):
            if (host, share) != place:
                if now is not None:
                    yield row()
                place, now = (host, share), tree(depths, keys)
            elif shape != last:
                merge(now, tree(depths, keys))
            last = shape
    if now is not None:
        yield row()


def _count_pass(batches):
    """Rows (host, part, kind, whole, depths, keys, texts, lengths), sorted, the wrapper first -> (host, node, text, n, length); copies count once."""
    host, wrapper, last, found = None, None, None, Counter()

    def rows():
        pairs = [k for k in found if len(k) == 2]
        return pa.RecordBatch.from_arrays(
            [pa.array([host] * len(pairs), pa.string()), pa.array([k[0] for k in pairs], pa.int32()), pa.array([k[1] for k in pairs], pa.int64()), pa.array([found[k] for k in pairs], pa.int64()), pa.array([found[(*k, "length")] for k in pairs], pa.int64())],
            names=["host", "node", "text", "n", "length"],
        )

    for batch in batches:
        for h, _, kind, whole, depths, keys, texts, lengths in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                if h != host:
                    if found:
                        yield rows()
                        found.clear()
                    host, wrapper = h, Aligner(tree(depths, keys))
                last = None
            elif whole != last:
                found.update(count(wrapper, [(depths, keys, texts, lengths)]))
                last = whole
        if len(found) > 50_000:
            yield rows()
            found.clear()
    if found:
        yield rows()


def _read_pass(batches):
    """Rows (host, part, kind, order, id, url, html, depths, keys, nodes), sorted, the wrapper first -> (id, url, text)."""
    host, wrapper = None, None
    for batch in batches:
        types, out = (batch.schema.field("id").type, batch.schema.field("url").type), []
        for h, _, kind, _, i, u, s, depths, keys, nodes in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                if h != host:
                    nodes = nodes or []
                    template = {n["node"]: n["text"] for n in nodes if n["text"] is not None}
                    host, wrapper = h, Wrapper(tree(depths, keys), template, {n["node"]: n["varying"] for n in nodes})
            else:
                out.append((i, u, wrapper.read(parse(s)) if s else ""))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], types[0]), pa.array([r[1] for r in out], types[1]), pa.array([r[2] for r in out], pa.string())], names=["id", "url", "text"])


def learn(counts: dict) -> tuple[dict[int, int], dict[int, int]]:
    """(template, varying) of `count`; `main_text` does the same in tables."""
    by: dict[int, list] = {}
    for k, n in counts.items():
        if len(k) == 2:
            by.setdefault(k[0], []).append((n, k[1], counts.get((*k, "length"), 0)))
    template, varying = {}, {}
    for node, texts in by.items():
        n, text, length = max(texts)
        fixed = text != 0 and n >= LEAST and 2 * n > sum(t[0] for t in texts)
        varying[node] = sum(t[2] for t in texts) - (length if fixed else 0)
        if fixed:
            template[node] = text
    return template, varying


def extract(pages: list[str | None]) -> list[str]:
    """Main texts of pages of one host."""
    trees = [parse(p or "") for p in pages]
    rows = {m[0]: m[1:] for t, p in zip(trees, pages) if p for m in [measure(t)]}
    if not rows:
        return ["" for _ in pages]
    shapes = sorted({m[0]: m[1:3] for m in rows.values()}.items())
    whole = tree(*shapes[0][1])
    for _, shape in shapes[1:]:
        merge(whole, tree(*shape))
    wrapper = Wrapper(whole, *learn(count(Aligner(whole), [m[1:] for m in rows.values()])))
    return [wrapper.read(t) if p else "" for p, t in zip(pages, trees)]


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text), one row per page."""
    prepare(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    light = pages.groupBy(host.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    total = pages.count()
    most = max(GROUP, int(total * HOT_SHARE))
    hot = {r.h: -(-r.n // most) for r in light.where(F.col("n") > most).collect()}  # fewer than 1 / HOT_SHARE hosts
    parts = F.lit(1)
    if hot:
        share = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])
        parts = F.coalesce(F.try_element_at(share, F.col("host")), F.lit(1))

    shape = "host string, whole long, shape long, depths array<int>, keys array<string>"
    measured = cut(arrow_map(pages.select(host.alias("host"), F.col(html_col).alias("html")), _shape_pass, f"{shape}, texts array<bigint>, lengths array<int>"))
    shapes = measured.groupBy("host", "shape").agg(F.first("depths").alias("depths"), F.first("keys").alias("keys"))
    shapes = shapes.select("host", F.pmod("shape", F.lit(SHARES)).alias("share"), "shape", "depths", "keys").repartition("host", "share").sortWithinPartitions("host", "share", "shape")
    merged = "host string, share long, depths array<int>, keys array<string>"
    shares = arrow_map(shapes, _merge_pass, merged).select("host", F.lit(0).cast("long").alias("share"), F.col("share").alias("shape"), "depths", "keys")
    wrappers = cut(arrow_map(shares.repartition("host").sortWithinPartitions("host", "shape"), _merge_pass, merged).select("host", "depths", "keys"))
    dealt = wrappers.select("host", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))).alias("part"), F.lit(0).alias("kind"), "depths", "keys")

    rows = measured.select("host", F.pmod("whole", parts).cast("long").alias("part"), F.lit(1).alias("kind"), "whole", "depths", "keys", "texts", "lengths")
    rows = rows.unionByName(dealt, allowMissingColumns=True).repartition("host", "part").sortWithinPartitions("host", "part", "kind", "whole")
    counts = arrow_map(rows, _count_pass, "host string, node int, text long, n long, length long").groupBy("host", "node", "text").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
    top = counts.groupBy("host", "node").agg(F.sum("n").alias("seen"), F.sum("length").alias("all"), F.max(F.struct("n", "text", "length")).alias("top"))
    fixed = (F.col("top.text") != 0) & (F.col("top.n") >= LEAST) & (F.col("top.n") * 2 > F.col("seen"))
    node = F.struct("node", F.when(fixed, F.col("top.text")).alias("text"), (F.col("all") - F.when(fixed, F.col("top.length")).otherwise(0)).alias("varying"))
    learned = cut(top.groupBy("host").agg(F.collect_list(node).alias("nodes")))

    order = F.xxhash64(F.col(id_col).cast("string"), F.col(url_col))
    rows = pages.select(host.alias("host"), order.alias("o"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.select("host", F.pmod(F.shiftright("o", 3), parts).cast("long").alias("part"), F.lit(1).alias("kind"), "o", "id", "url", "html")
    rows = rows.unionByName(dealt.join(learned, "host", "left"), allowMissingColumns=True).repartition("host", "part").sortWithinPartitions("host", "part", "kind", "o", "id")
    types = dict(pages.dtypes)
    return arrow_map(rows, _read_pass, f"id {types[id_col]}, url {types[url_col]}, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def report(pages: DataFrame) -> DataFrame:
    """The contract's columns, one row per page."""
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
