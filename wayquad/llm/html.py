"""Main text of web pages by wrapper induction.

The pages of a host come from one template.  A page's DOM tree is reduced to a skeleton: elements that hold no
block are leaves, and neighbours of one shape become one slot.  Every page is aligned with the host's reference
page (of the usual length, the smallest id) by simple tree matching.  Aligned pages vote on each text of the
reference: is it in their slot, too.  Texts that are there in ``CONSTANT`` of at least ``VOTERS`` votes are the
template.  Pages add up, too, how much varying text each slot holds.  The wrapper of a host is what that gives:

- its region, the slot reached from the root by going down to the child that holds ``REGION`` of the varying text, as
  long as what lies beside it holds no heading, paragraph, list or table with varying text;
- its constant texts.

The main text of a page is the text of the nodes that are aligned with the region, without constant texts.  So
menus, adverts and notices beside the region go because the wrapper says so, whatever they are called.

Copies: a host with many copies of one article must not turn it into template.  So pages whose text is to ``NEAR``
the reference's do not vote; constant texts that are most of an article or main element do not count; and if
constant texts are most of the region, only those count that every vote has found.

Names serve as a tie-break only.  Elements that are no article text by their tag or role (menus, headers, footers,
sidebars, forms, scripts) are left out everywhere.  Class names (``NAMES``) are asked on container elements, never on
paragraphs and the like, where the wrapper does not decide: inside the region, and on pages that no wrapper
covers (the region is missing or holds less than ``MOST`` of the page's text).  On such pages the article elements, or
else the main elements, are the main text if they hold ``MOST`` of what is left.  An article inside an article is a
reader's comment unless such articles hold most of the outer one.

Votes are counted over all pages, in the tasks first, then by host and text; a hot host costs a few rows a
task.  Wrappers (about a kilobyte a host) are broadcast if they are small, checked by size, and joined by
host otherwise.

Defined results: null and empty html give the empty text; a null url counts as host ''; truncated pages and
tags that are never closed are read like a browser does; nesting of any depth and any number of siblings are
read, and matched exactly (many siblings in arrays, with the matching that a plain table gives); repeated rows
are extracted each.  Sizes of pages and tables choose how something is computed, never what comes out; ``VOTERS`` is
the least evidence for a template, counted for each text.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayquad.llm.common import pin, ready, shared_dir, slices, table

CONSTANT, VOTERS, REGION, MOST, NEAR = 0.8, 3, 0.9, 0.5, 0.9
#: Pairs of siblings from which on they are matched in arrays, and sizes and rows of them kept at once; none changes a result.
WIDE, CELLS, KEPT = 1 << 16, 1 << 21, 64
BROADCAST_BYTES = 8 << 20
#: Element names of the HTML standard by their role in parsing and layout (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body caption head html legend tbody td tfoot th thead tr dd dt li".split())
#: An opening tag closes these open elements, up to a border.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
BORDERS = frozenset("table td th caption article section div main aside nav header footer form body html button object".split())
CONTENT = frozenset({"article", "main"})
NOT_TEXT = frozenset(
    "script style noscript template head title meta link svg math iframe object embed canvas audio video button input select textarea nav header footer aside form dialog menu map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Elements that a region may be, and whose class names are asked.
CONTAINERS = frozenset("#root html body div section article main center table tbody tr td".split())
NAMED = (CONTAINERS - {"#root", "html", "body"}) | frozenset("ul ol dl span a details".split())
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol dl table figure hgroup address".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar footer header masthead cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription share sharing social related recommended "
    "comment comments reply replies respond disqus widget toolbar pagination pager login signup form search".split()
)
#: Parts of class names that say nothing.
NEUTRAL = frozenset("site main page top bottom left right global primary secondary box block wrapper wrap container area section inner outer list links link bar item items post entry reader user slot unit js".split())
TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|([^<]+)|(<)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")




class Node:
    __slots__ = ("children", "named", "tag", "unwanted")

    def __init__(self, tag: str, unwanted: bool = False, named: bool = False):
        self.tag, self.unwanted, self.named, self.children = tag, unwanted, named, []


def _judged(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is no article text by its tag, role or state, and whether its class names say so."""
    if tag in NOT_TEXT:
        return True, False
    named = False
    if not attributes or tag in ("html", "body"):
        return False, named
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape("".join(values)).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True, False
        if name == "role" and value.strip() in ROLES:
            return True, False
        if name in ("class", "id") and tag in NAMED:
            # All parts of a name must be listed or say nothing ("has-sidebar" is no sidebar).
            parts = [{p for p in re.split(r"[^a-z]+", x) if p} for x in value.split()]
            named = named or any(p & NAMES and p <= NAMES | NEUTRAL for p in parts)
    return False, named


def parse(html: str) -> Node:
    """The tree of a page; elements end where the standard lets them end."""
    root = Node("#root")
    stack = [root]
    at, size, articles = 0, len(html), 0
    while at < size:
        m = TOKEN.match(html, at)
        at = m.end()
        text = m[7] or m[8]
        if text:
            stack[-1].children.append(text)
            continue
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in BORDERS:
                    break
            continue
        if tag in ENDS_P:
            _close(stack, {"p"}, BORDERS)
        elif tag in CLOSES:
            _close(stack, *CLOSES[tag])
        node = Node(tag, *_judged(tag, attributes))
        articles += tag == "article"
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            if tag in ("title", "textarea"):
                node.children.append(html[at : end.start() if end else size])
            at = end.start() if end else size
            if end:
                at = html.find(">", at) + 1 or size
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
        elif tag not in VOID and tag in BLOCK:
            stack.append(node)
    if articles > 1:
        _comments(root)
    return root


def _close(stack: list[Node], names: set[str], borders: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in names:
            del stack[k:]
            return
        if stack[k].tag in borders:
            return


def plain(node: Node) -> int:
    """Characters of wanted text below a node that are not in links."""
    total, todo = 0, [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            total += len(x) - x.count(" ")
        elif x is node or not (x.unwanted or x.tag == "a"):
            todo.extend(x.children)
    return total


def _comments(root: Node) -> None:
    """Articles inside an article are readers' comments, unless they hold most of it."""
    outer: list[tuple[Node, list[Node]]] = []
    todo: list[tuple[Node, list[Node] | None]] = [(root, None)]
    while todo:
        x, inside = todo.pop()
        if x.tag == "article" and not x.unwanted:
            if inside is not None:
                inside.append(x)
                continue
            inside = []
            outer.append((x, inside))
        todo.extend((c, inside) for c in x.children if isinstance(c, Node) and not c.unwanted)
    for article, nested in outer:
        if nested and sum(map(plain, nested)) < MOST * plain(article):
            for x in nested:
                x.unwanted = True


def blocks(node: Node, dropped: frozenset[int] = frozenset(), names: bool = True) -> list[str]:
    """The texts of the blocks below ``node`` that are wanted, in page order.

    ``dropped``: ids of nodes left out (of containers their own strings only, as negative numbers); ``names``: class names count.
    """
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            if text := " ".join(unescape("".join(run)).split()):
                out.append(text)
            run.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif x is node or not (x.unwanted or (names and x.named) or id(x) in dropped):
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(c for c in reversed(x.children) if isinstance(c, Node) or -id(x) not in dropped)
    flush()
    return out


def contents(node: Node) -> tuple[list[Node], list[Node]]:
    """The outermost article elements, and the outermost main elements, that no unwanted element holds."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [(node, frozenset())]
    while todo:
        x, inside = todo.pop()
        if x.tag in CONTENT and x.tag not in inside:
            found[x.tag].append(x)
            inside |= {x.tag}
        todo.extend((c, inside) for c in reversed(x.children) if isinstance(c, Node) and not (c.unwanted or c.named))
    return found["article"], found["main"]


class Slot:
    """A skeleton node: its tag, its children, the nodes it stands for, and for each a digest of its text and its length.

    The text of a leaf is all of it, that of another node its own strings.  ``shape`` is equal for equal trees of
    tags, ``count`` the number of slots, ``number`` the place in page order.
    """

    __slots__ = ("children", "count", "label", "nodes", "number", "shape", "sizes", "texts")

    def __init__(self, label: str, text: int, size: int, children: list[Slot], nodes: list[Node]):
        self.label, self.texts, self.sizes, self.children, self.nodes, self.number = label, [text], [size], children, nodes, -1
        self.shape = hash((label, *(c.shape for c in children)))
        self.count = 1 + sum(c.count for c in children)


def _text_of(x: Node, whole: bool) -> tuple[int, int]:
    """A digest of the text of a leaf, or of the own strings of another node, and how long it is without links."""
    parts: list[str] = []
    size, todo = 0, list(reversed(x.children))
    linked: list[Node | str] = []
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            parts.append(c)
            size += len(c) - c.count(" ")
        elif whole and not c.unwanted:
            if c.tag == "a":
                linked.append(c)
                parts.append(" ".join(blocks(c)))
            else:
                todo.extend(reversed(c.children))
    return zlib.crc32(" ".join("".join(parts).split()).encode()), size


def skeleton(root: Node) -> Slot:
    """Post-order with a stack: slots of wanted elements with text; neighbours of one shape become one slot."""
    todo: list[tuple[Node, bool]] = [(root, False)]
    done: list[Slot | None] = []
    kids: dict[int, int] = {}
    while todo:
        x, closed = todo.pop()
        own = [c for c in x.children if isinstance(c, Node) and not c.unwanted and c.tag not in VOID]
        if not closed:
            if own:
                todo.append((x, True))
                todo.extend((c, False) for c in reversed(own))
                kids[id(x)] = len(own)
                continue
            text, size = _text_of(x, True)
            done.append(Slot(x.tag, text, size, [], [x]) if text or x is root else None)
            continue
        n = kids.pop(id(x))
        below = [s for s in done[len(done) - n :] if s is not None]
        del done[len(done) - n :]
        if x is not root and all(s.label not in BLOCK and not s.children for s in below):
            text, size = _text_of(x, True)
            done.append(Slot(x.tag, text, size, [], [x]) if text else None)
            continue
        slots: list[Slot] = []
        for s in below:
            if slots and slots[-1].shape == s.shape:
                _merge(slots[-1], s)
            else:
                slots.append(s)
        done.append(Slot(x.tag, *_text_of(x, False), slots, [x]))
    return numbered(done[0])


def _merge(into: Slot, other: Slot) -> None:
    todo = [(into, other)]
    while todo:
        a, b = todo.pop()
        a.nodes += b.nodes
        a.texts += b.texts
        a.sizes += b.sizes
        todo.extend(zip(a.children, b.children, strict=True))


def numbered(slot: Slot) -> Slot:
    for n, x in enumerate(walk(slot)):
        x.number = n
    return slot


def walk(slot: Slot) -> Iterator[Slot]:
    """Slots in page order."""
    todo = [slot]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(reversed(x.children))


def dump(slot: Slot) -> str:
    """Slots in page order, each with its number of children."""
    return json.dumps([[x.label, len(x.children), x.texts, x.sizes] for x in walk(slot)])


def load(data: str) -> Slot:
    done: list[Slot] = []
    for label, n, texts, sizes in reversed(json.loads(data)):
        children = [done.pop() for _ in range(n)]
        slot = Slot(label, 0, 0, children, [])
        slot.texts, slot.sizes = texts, sizes
        done.append(slot)
    return numbered(done[0])


#: A row of sizes, see Matching._rows.
Row = list[int] | np.ndarray


class Matching:
    """Simple tree matching of two skeletons: the largest order-preserving matching of slots with equal tags.

    The size of a pair follows from the two shapes, so it is counted once for each pair of shapes.  Of equally large matchings the same one
    is taken however many siblings there are.
    """

    def __init__(self, a: Slot, b: Slot):
        self.known: dict[tuple[int, int], int] = {}
        self.size = self._size(a, b)
        self.pairs: list[tuple[Slot, Slot]] = []
        todo = [(a, b)] if self.size else []
        while todo:
            x, y = todo.pop()
            self.pairs.append((x, y))
            todo.extend(zip(x.children, y.children, strict=True) if x.shape == y.shape else self._matched(x, y))

    def _pair(self, x: Slot, y: Slot) -> int:
        if x.label != y.label:
            return 0
        return x.count if x.shape == y.shape else self.known.get((x.shape, y.shape), -1)

    def _size(self, a: Slot, b: Slot) -> int:
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._pair(x, y) >= 0:
                todo.pop()
                continue
            first, second = _unlike(x, y)
            kinds = _kinds(second)
            if open_ := [(c, d) for c in _kinds(first) for d in kinds if self._pair(c, d) < 0]:
                todo.extend(open_)
                continue
            todo.pop()
            row, step = self._rows(first, second)
            for i in range(len(first)):
                row = step(row, i)
            self.known[x.shape, y.shape] = 1 + int(row[-1]) + sum(c.count for c in x.children[len(first) :])
        return self._pair(a, b)

    def _rows(self, first: list[Slot], second: list[Slot]) -> tuple[Row, Callable[[Row, int], Row]]:
        """Sizes of the first i siblings with 0, 1, ... of the second ones: the row of i = 0, and the step from row i to the next.

        A step goes as far as the row that it is given.  More than ``WIDE`` pairs of siblings are stepped in arrays, with the same sizes.
        """
        if len(first) * len(second) <= WIDE:

            def step(row: list[int], i: int) -> list[int]:
                out, c = [0], first[i]
                for j in range(1, len(row)):
                    out.append(max(out[-1], row[j], row[j - 1] + self._pair(c, second[j - 1])))
                return out

            return [0] * (len(second) + 1), step

        lines, heads = _kinds(first), _kinds(second)
        sizes = np.array([[self._pair(c, d) for d in heads] for c in lines], np.int32)
        line = {c.shape: n for n, c in enumerate(lines)}
        column = {d.shape: n for n, d in enumerate(heads)}
        columns = np.array([column[d.shape] for d in second])
        known: dict[int, np.ndarray] = {}

        def array_step(row: np.ndarray, i: int) -> np.ndarray:
            kind = line[first[i].shape]
            if kind not in known:
                if len(known) * len(columns) > CELLS:
                    known.clear()
                known[kind] = sizes[kind][columns]
            out = np.zeros_like(row)
            np.add(row[:-1], known[kind][: len(row) - 1], out=out[1:])
            np.maximum(row[1:], out[1:], out=out[1:])
            return np.maximum.accumulate(out, out=out)

        return np.zeros(len(second) + 1, np.int32), array_step

    def _matched(self, x: Slot, y: Slot) -> Iterator[tuple[Slot, Slot]]:
        """The matched children from the last to the first.  Of more than ``CELLS`` sizes only some rows are kept, and those between are made again."""
        first, second = _unlike(x, y)
        i, j = len(first), len(second)
        yield from zip(reversed(x.children[i:]), reversed(y.children[j:]), strict=True)
        row, step = self._rows(first, second)
        kept = [(0, row)]
        while i and j:
            low, row = kept[-1]
            row = row[: j + 1]
            if (i - low) * (j + 1) > CELLS and i - low > 1:
                every = max(CELLS // (j + 1), -(-(i - low) // KEPT))
                for k in range(low, low + (i - low - 1) // every * every):
                    row = step(row, k)
                    if (k + 1 - low) % every == 0:
                        kept.append((k + 1, row))
                continue
            kept.pop()
            rows = [row]
            for k in range(low, i):
                rows.append(step(rows[-1], k))
            while i > low and j:
                size, here, above = self._pair(first[i - 1], second[j - 1]), rows[i - low][j], rows[i - low - 1]
                if size and here == above[j - 1] + size:
                    yield first[i - 1], second[j - 1]
                    i, j = i - 1, j - 1
                elif here == above[j]:
                    i -= 1
                else:
                    j -= 1


def _unlike(x: Slot, y: Slot) -> tuple[list[Slot], list[Slot]]:
    """The children of both without the last ones that are of one shape pair by pair; no matching is larger than one with these pairs."""
    m, n = len(x.children), len(y.children)
    while m and n and x.children[m - 1].shape == y.children[n - 1].shape:
        m, n = m - 1, n - 1
    return x.children[:m], y.children[:n]


def _kinds(slots: list[Slot]) -> list[Slot]:
    """Of the slots of each shape the last one."""
    return list({c.shape: c for c in slots}.values())


def align(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """The size of the largest order-preserving matching, and its pairs."""
    found = Matching(a, b)
    return found.size, found.pairs


def near(pairs: list[tuple[Slot, Slot]], page: Slot) -> bool:
    """Whether a page's text is for the most part the reference's, slot by slot."""
    total = sum(sum(x.sizes) for x in walk(page))
    same = 0
    for own, ref in pairs:
        there = set(ref.texts)
        same += sum(size for text, size in zip(own.texts, own.sizes, strict=True) if text in there)
    return same >= NEAR * total


class Wrapper:
    """A host's reference skeleton, its constant texts (slot number << 32 + place) and its region.

    ``always``: the constant texts that every vote has found; ``volume``: how much text the pages hold in each slot
    itself, children not included.
    """

    def __init__(self, reference: Slot, constant: frozenset[int] = frozenset(), volume: dict[int, int] | None = None, always: frozenset[int] = frozenset()):
        self.reference, self.volume = reference, volume or {}
        self.constant = {number: set() for number in range(reference.count)}
        for x in walk(reference):
            self.constant[x.number] = {t for k, t in enumerate(x.texts) if (x.number << 32) + k in constant}
        self.region = self._region()
        for x in walk(reference):
            if x.label in CONTENT and self._mostly_constant(x):
                for y in walk(x):
                    self.constant[y.number] = set()
        if self._mostly_constant(self.region):
            for x in walk(self.region):
                self.constant[x.number] &= {t for k, t in enumerate(x.texts) if (x.number << 32) + k in always}

    def _mostly_constant(self, slot: Slot) -> bool:
        held = sum(sum(x.sizes) for x in walk(slot))
        fixed = sum(size for x in walk(slot) for t, size in zip(x.texts, x.sizes, strict=True) if t in self.constant[x.number])
        return 2 * fixed > held

    def _region(self) -> Slot:
        order = list(walk(self.reference))
        below = [self._varying(x) for x in order]
        for x in reversed(order):
            below[x.number] += sum(below[c.number] for c in x.children)
        at = self.reference
        while at.children:
            best = max(at.children, key=lambda c: below[c.number])
            beside = any(c.label in TEXTUAL and below[c.number] for c in at.children if c is not best)
            if best.label not in CONTAINERS or beside or len(best.texts) > 1 or not below[best.number] or below[best.number] < REGION * below[at.number]:
                break
            at = best
        return at

    def _varying(self, x: Slot) -> int:
        return self.volume.get(x.number, 0)


def main_text(html: str, wrapper: Wrapper | None = None) -> str:
    return extracted(html, wrapper)[0]


def extracted(html: str, wrapper: Wrapper | None = None) -> tuple[str, bool]:
    """The main text of a page, and whether the wrapper decided."""
    root = parse(html)
    gone: set[int] = set()
    region: list[Node] = []
    if wrapper is not None:
        for own, ref in align(skeleton(root), wrapper.reference)[1]:
            fixed = wrapper.constant[ref.number]
            gone.update(id(x) if not own.children else -id(x) for x, t in zip(own.nodes, own.texts, strict=True) if t in fixed)
            if ref is wrapper.region:
                region = own.nodes
    kept = frozenset(gone)
    if region:
        found = [t for node in region for t in blocks(node, kept)]
        if found and sum(map(len, found)) >= MOST * sum(map(len, blocks(root, kept, names=region[0].tag == "#root"))):
            return "\n".join(found), True
    left = blocks(root, kept)
    for nodes in contents(root):
        found = [t for node in nodes for t in blocks(node, kept)]
        if found and sum(map(len, found)) >= MOST * sum(map(len, left)):
            return "\n".join(found), False
    return "\n".join(left or blocks(root) or blocks(root, names=False)), False


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def references(pages: DataFrame) -> DataFrame:
    """host and html of its reference page: of the pages whose length is in the middle quarter-octave, the one with the smallest id."""
    octave = F.floor(4 * F.log2(1 + F.length(F.coalesce("html", F.lit(""))))).cast("int")
    counts = pages.groupBy("host", octave.alias("octave")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("host")
    counts = counts.withColumn("until", F.sum("n").over(own.orderBy("octave"))).withColumn("all", F.sum("n").over(own))
    middle = pin(counts.where("2 * until >= all").groupBy("host").agg(F.min("octave").alias("octave")))
    usual = pages.withColumn("octave", octave).join(F.broadcast(middle) if _small(middle.agg(F.sum(F.length("host") + 32))) else middle, ["host", "octave"])
    return usual.groupBy("host").agg(F.min_by(F.coalesce("html", F.lit("")), F.struct("page_id", "html")).alias("html"))


def _small(size: DataFrame) -> bool:
    return (size.first()[0] or 0) <= BROADCAST_BYTES


def wrappers(pages: DataFrame) -> DataFrame:
    """host, skeleton of its reference page, constant texts, and the text that pages hold in each slot."""

    def skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([dump(skeleton(parse(h or ""))) for h in _column(batch, "html")], pa.string())], names=["host", "skeleton"])

    chosen = pin(references(pages).mapInArrow(skeletons, "host string, skeleton string"))
    names = ["votes", "same", "varying", "held"]

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Slot] = {}
        for batch in slices(batches, "html"):
            counted = {c: Counter() for c in names}
            for host, html, reference in zip(_column(batch, "host"), _column(batch, "html"), _column(batch, "skeleton"), strict=True):
                if host not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[host] = load(reference)
                page = skeleton(parse(html or ""))
                pairs = align(page, known[host])[1]
                votes = not near(pairs, page)
                for own, ref in pairs:
                    here, there = set(own.texts), set(ref.texts)
                    at = ref.number << 32
                    counted["held"][host, at] += sum(own.sizes)
                    if votes:
                        counted["varying"][host, at] += sum(size for t, size in zip(own.texts, own.sizes, strict=True) if t not in there)
                        for k, t in enumerate(ref.texts):
                            counted["votes"][host, at + k] += 1
                            counted["same"][host, at + k] += t in here
            keys = list({**counted["held"], **counted["votes"]})
            arrays = [pa.array([h for h, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int64()), *(pa.array([counted[c][k] for k in keys], pa.int64()) for c in names)]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "node", *names])

    counts = _with_wrappers(pages, chosen).mapInArrow(votes, "host string, node long, " + ", ".join(f"{c} long" for c in names))
    summed = counts.groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in names))
    fixed = (F.col("votes") >= VOTERS) & (F.col("same") >= CONSTANT * F.col("votes"))
    lists = {"constant": F.when(fixed, F.col("node")), "always": F.when(fixed & (F.col("same") == F.col("votes")), F.col("node"))}
    slot = F.when(F.col("held") + F.col("varying") > 0, F.struct(F.shiftright("node", 32).alias("number"), "held", "varying", "votes"))
    found = summed.groupBy("host").agg(*(F.array_sort(F.collect_list(x)).alias(c) for c, x in lists.items()), F.array_sort(F.collect_list(slot)).alias("volume"))
    return pin(chosen.join(found, "host", "left"))


def wrapper_of(reference: str, constant: list[int] | None, always: list[int] | None, volume: list[dict] | None) -> Wrapper:
    """Volumes are of varying text if enough pages voted, else of all text."""
    slots = volume or []
    voted = max((s["votes"] for s in slots), default=0) >= VOTERS
    return Wrapper(load(reference), frozenset(constant or ()), {s["number"]: s["varying" if voted else "held"] for s in slots}, frozenset(always or ()))


def _with_wrappers(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Join by host; the wrappers are broadcast if they are small."""
    return pages.join(F.broadcast(found) if _small(found.agg(F.sum(4 * F.length("skeleton") + F.length("host") + 64))) else found, "host")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text of every row of ``pages`` (page_id, url, html) and whether the host's wrapper decided it."""
    ready(pages.sparkSession)
    shared_dir(pages.sparkSession)
    host = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = pages.select("page_id", "url", "html", host.alias("host"))
    joined = _with_wrappers(own, wrappers(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in slices(batches, "html"):
            out = []
            for host, html, *about in zip(*(_column(batch, c) for c in ("host", "html", "skeleton", "constant", "always", "volume")), strict=True):
                if host not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[host] = wrapper_of(*about)
                out.append(extracted(html or "", known[host]))
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([t for t, _ in out], pa.string()), pa.array([d for _, d in out], pa.bool_())], names=["page_id", "url", "text", "by_wrapper"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return joined.mapInArrow(run, f"{kinds}, text string, by_wrapper boolean")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "by_wrapper")


__all__ = ["extract", "main_text", "op7"]
