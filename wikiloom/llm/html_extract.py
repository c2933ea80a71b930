"""Main text of pages by wrapper induction.

The pages of a host are aligned by simple tree matching: of two nodes with the same tag and
class the children are matched in order so that most nodes match. What results is the
wrapper of the host: nodes whose text is the same on all pages are template, nodes whose text
varies are slots. Siblings of one kind are folded into one repeated node first, so wrappers stay
small. Wrappers are folded in each task, then in salted groups of a host, then per host,
so no task sees all pages of one. A page is then aligned to its host's wrapper and its
content slots are read.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wikiloom.llm.common import arrow_map, fields, url_host
from wikiloom.session import staged

#: Hosts whose wrappers a task holds before it hands them on.
HELD = 1000
SALTS = 32

# What the HTML standard and common class names say about the parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head iframe object svg canvas audio video math select textarea button datalist".split())
APART = frozenset("nav header footer aside form dialog menu".split())
MAIN = frozenset("article main".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt pre blockquote figcaption b i em strong span a".split())
NONE: frozenset = frozenset()
APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer header menu modal nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar "
    "skip social sponsor sponsored subscribe toolbar widget".split()
)
# Names that also stand for parts of an article: such an element of it is left out only if it is the same on all pages of the
# host that have it, or if most of its text is links.
WEAK_NAMES = frozenset("header menu related".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
_CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_SCOPE = frozenset("html body table td th article section div ul ol dl main nav aside header footer form blockquote".split())


class Node:
    """An element: tag, class, whether it is apart from the main text, and its content in order.

    ``weak`` says that it is apart by a name or tag that parts of an article may have too.
    """

    __slots__ = ("tag", "kind", "apart", "weak", "content")

    def __init__(self, tag: str, attributes: list[tuple[str, str | None]] = ()):
        given = dict(reversed(attributes)) if attributes else {}
        name = (given.get("class") or "").split()
        self.tag = tag
        self.kind = f"{tag}.{name[0]}" if name else tag
        self.apart = tag in APART or tag in HIDDEN
        self.weak = tag == "header"
        if attributes and not self.apart and tag not in ("html", "body", "article", "main"):
            words = re.split(r"[\s_-]+", f"{given.get('class') or ''} {given.get('id') or ''}".lower())
            names = APART_NAMES.intersection(words)
            by_state = given.get("role") in APART_ROLES or "hidden" in given or given.get("aria-hidden") == "true"
            self.apart = bool(names) or by_state
            self.weak = bool(names) and names <= WEAK_NAMES and not by_state
        self.content: list = []

    def children(self) -> list[Node]:
        return [c for c in self.content if type(c) is Node]


class _Builder(HTMLParser):
    """The tree of a page, with the end tags that the standard implies."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#")
        self.open = [self.root]
        self.deepest = 1

    def _close(self, tags, barrier) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in barrier:
                return

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _CLOSED_BY:
            self._close(_CLOSED_BY[tag], ("ul", "ol", "dl", "table", "select") if tag not in ("tr", "td", "th") else ("table",))
        if tag in _CLOSES_P:
            self._close(("p",), _SCOPE)
        node = Node(tag, attrs)
        self.open[-1].content.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.deepest = max(self.deepest, len(self.open))

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "math"):
            self.open.pop()

    def handle_endtag(self, tag) -> None:
        if tag not in VOID:
            self._close((tag,), ())

    def handle_data(self, data) -> None:
        self.open[-1].content.append(data)


def parse(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    _allow_depth(builder.deepest)
    return builder.root


def _allow_depth(levels: int) -> None:
    """Let trees of so many levels be walked: a call for each level, none of which passes through C."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * levels + 1000))


# -- wrappers ---------------------------------------------------------------------
#
# A wrapper's node is a list: kind, pages it is on, text hash ('' none, '*' varying), length of
# its text over all pages, children.

KIND, PAGES, TEXT, SIZE, KIDS = range(5)


def _written(wrapper: list) -> str:
    """A wrapper as JSON: its nodes in order, each with its level, so depth needs no nesting."""
    rows, todo = [], [(0, wrapper)]
    while todo:
        level, node = todo.pop()
        rows.append([level, *node[:KIDS]])
        todo += [(level + 1, kid) for kid in reversed(node[KIDS])]
    return json.dumps(rows)


def _read(text: str) -> list:
    path: list[list] = []
    rows = json.loads(text)
    for level, *node in rows:
        node.append([])
        del path[level:]
        if path:
            path[-1][KIDS].append(node)
        path.append(node)
    _allow_depth(max(row[0] for row in rows) + 1)
    return path[0]


def skeleton(node: Node) -> list:
    """A page's tree as a wrapper of one page, as deep as it was parsed."""
    text = " ".join(" ".join(c for c in node.content if type(c) is str).split())
    hashed = xxhash.xxh64_hexdigest(text) if text else ""
    kids: list[list] = []
    for child in node.content:
        if type(child) is Node and child.tag not in HIDDEN:
            own = skeleton(child)
            if kids and kids[-1][KIND] == own[KIND]:
                kids[-1] = merge(kids[-1], own, 0)
            else:
                kids.append(own)
    return [node.kind, 1, hashed, len(text), kids]


def _weight(a: list, b: list) -> int:
    """Size of the largest match of two trees, 0 if their roots differ."""
    if a[KIND] != b[KIND]:
        return 0
    return 1 + (_table(a[KIDS], b[KIDS])[0][-1][-1] if a[KIDS] and b[KIDS] else 0)


def _table(left: list, right: list) -> tuple[list[list[int]], list[list[int]]]:
    weights = [[_weight(a, b) for b in right] for a in left]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, row in enumerate(weights):
        for j, w in enumerate(row):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w if w else 0)
    return best, weights


def aligned(left: list, right: list) -> list[tuple[int, int]]:
    """Pairs of places of matched siblings, in order."""
    if [n[KIND] for n in left] == [n[KIND] for n in right]:
        return [(i, i) for i in range(len(left))]
    # Kinds of one side only match nothing, so they need no place in the table.
    both = {n[KIND] for n in left} & {n[KIND] for n in right}
    of_left = [i for i, n in enumerate(left) if n[KIND] in both]
    of_right = [j for j, n in enumerate(right) if n[KIND] in both]
    best, weights = _table([left[i] for i in of_left], [right[j] for j in of_right])
    i, j, pairs = len(of_left), len(of_right), []
    while i and j:
        w = weights[i - 1][j - 1]
        if w and best[i][j] == best[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            pairs.append((of_left[i], of_right[j]))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def merge(a: list, b: list, more: int = 1) -> list:
    """The wrapper of both; with ``more`` 0 of two siblings on one page, which vary only if pages differ in them."""
    pages = a[PAGES] + b[PAGES] if more else max(a[PAGES], b[PAGES])
    text = a[TEXT] if a[TEXT] == b[TEXT] else "*"
    if text == "*" and not more and "*" not in (a[TEXT], b[TEXT]):
        text = xxhash.xxh64_hexdigest(a[TEXT] + b[TEXT]) if a[TEXT] and b[TEXT] else a[TEXT] or b[TEXT]
    kids: list[list] = []
    i = j = 0
    for x, y in [*aligned(a[KIDS], b[KIDS]), (len(a[KIDS]), len(b[KIDS]))]:
        kids += a[KIDS][i:x] + b[KIDS][j:y]
        if x < len(a[KIDS]):
            kids.append(merge(a[KIDS][x], b[KIDS][y], more))
        i, j = x + 1, y + 1
    return [a[KIND], pages, text, a[SIZE] + b[SIZE], kids]


def pruned(node: list, pages: int) -> list:
    """A wrapper of all ``pages`` of a host without nodes of less than half of them, which are no template.

    What varies in them counts as text of the node above.
    """
    kids, text, size = [], node[TEXT], node[SIZE]
    for kid in node[KIDS]:
        if kid[PAGES] * 2 >= pages:
            kids.append(pruned(kid, pages))
        elif lost := _varying(kid):
            size = lost + (size if text == "*" else 0)
            text = "*"
    return [node[KIND], node[PAGES], text, size, kids]


def induce(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, wrapper`` from all pages; the wrapper as JSON."""
    rows = pages.select(url_host(F.col(url)).alias("host"), F.col(html).alias("html")).filter("html <> ''")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            found = [list(held), [_written(w) for w in held.values()]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in found], names=["host", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = skeleton(parse(page))
                held[host] = merge(held[host], own) if host in held else own
                if len(held) >= HELD:
                    yield out()
        yield out()

    def united(group: pd.DataFrame) -> list:
        whole = None
        for text in sorted(group["wrapper"]):
            part = _read(text)
            whole = part if whole is None else merge(whole, part)
        return whole

    def unite(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [_written(united(group))]})

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        whole = united(group)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [_written(pruned(whole, whole[PAGES]))]})

    parts = arrow_map(rows, fold, "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = parts.groupBy("host", "salt").applyInPandas(unite, "host string, wrapper string")
    return some.groupBy("host").applyInPandas(finish, "host string, wrapper string")


# -- reading a page ------------------------------------------------------------------


def _varying_sizes(node: list) -> dict[int, int]:
    """Length of varying text below each of a wrapper's nodes, by the identity of the node."""
    order, todo = [], [node]
    while todo:
        order.append(todo.pop())
        todo += order[-1][KIDS]
    sizes: dict[int, int] = {}
    for own in reversed(order):
        total = own[SIZE] if own[TEXT] == "*" else 0
        for kid in own[KIDS]:
            total += sizes[id(kid)]
        sizes[id(own)] = total
    return sizes


def _varying(node: list) -> int:
    """Length of varying text below a wrapper's node."""
    return _varying_sizes(node)[id(node)]


def _blank_nodes(root: Node) -> set[int]:
    """Identities of the elements without any text that shows."""
    order, todo = [], [root]
    while todo:
        order.append(todo.pop())
        todo += order[-1].children()
    found: set[int] = set()
    for node in reversed(order):
        if node.tag in HIDDEN:
            found.add(id(node))
            continue
        for item in node.content:
            if item.strip() if type(item) is str else id(item) not in found:
                break
        else:
            found.add(id(node))
    return found


def _is_text(node: Node) -> bool:
    """Whether a header has a heading, or another element less than half of its text in links."""
    linked, plain, headed = 0, 0, node.tag in HEADINGS
    todo = [(node, node.tag == "a")]
    while todo:
        own, in_link = todo.pop()
        for item in own.content:
            if type(item) is str:
                size = len("".join(item.split()))
                linked, plain = linked + size * in_link, plain + size * (not in_link)
            elif item.tag not in HIDDEN and (not item.apart or item.weak):
                headed = headed or item.tag in HEADINGS
                todo.append((item, in_link or item.tag == "a"))
    return plain > linked or (headed and "header" in node.kind)


def _main_nodes(node: Node, found: list[Node]) -> list[Node]:
    for child in node.children():
        if child.tag in MAIN:
            found.append(child)
        elif not child.apart:
            _main_nodes(child, found)
    return found


class Wrapper:
    """A host's wrapper, as it is used for its pages."""

    def __init__(self, text: str | None):
        self.root = _read(text) if text else None
        self.sizes = _varying_sizes(self.root) if text else {}

    def _pairs(self, node: Node, slot: list | None) -> list[tuple[Node, list | None]]:
        """Children of a page's node with the wrapper's nodes they match."""
        children = [c for c in node.children() if c.tag not in HIDDEN]
        if slot is None:
            return [(c, None) for c in children]
        runs: list[list] = []
        members: list[list[Node]] = []
        for child in children:
            if runs and runs[-1][KIND] == child.kind:
                members[-1].append(child)
            else:
                runs.append([child.kind, 1, "", 0, []])
                members.append([child])
        match = {i: slot[KIDS][j] for i, j in aligned(runs, slot[KIDS])}
        return [(c, match.get(i)) for i, run in enumerate(members) for c in run]

    def _known(self, slot: list | None) -> bool:
        """Whether a slot is on so many of the host's pages that what is the same there is template."""
        return self.varies and slot is not None and slot[PAGES] >= 3 and slot[PAGES] * 2 >= self.root[PAGES]

    def _is_template(self, node: Node, slot: list | None, spared: frozenset = PROSE) -> bool:
        """Whether a node and all below it is the same on the host's pages that have it."""
        return node.tag not in spared and self._known(slot) and not self.sizes[id(slot)]

    def region(self, root: Node) -> list[tuple[Node, list | None, frozenset]]:
        """What holds the main text: marked as such, or the lowest node with all that is not template or apart.

        With each the tags of children that are never taken for template.
        """
        marked = _main_nodes(root, [])
        if marked:
            wanted = {id(n) for n in marked}
            slots = {}

            def find(node: Node, slot: list | None) -> None:
                for child, own in self._pairs(node, slot):
                    if id(child) in wanted:
                        slots[id(child)] = own
                    elif not child.apart:
                        find(child, own)

            find(root, self.root)
            return [(n, slots.get(id(n)), PROSE) for n in marked]
        node, slot = root, self.root
        while slot is not None:
            if any(type(c) is str and c.strip() for c in node.content) and (slot[TEXT] == "*" or not self._known(slot)):
                break
            inner = [(c, s) for c, s in self._pairs(node, slot) if not c.apart and not self._is_template(c, s, NONE) and id(c) not in self.blank]
            if len(inner) != 1 or inner[0][0].tag in PROSE:
                break
            node, slot = inner[0]
        # Among varying text of its own a constant word is part of a sentence.
        return [(node, slot, NONE if slot is not None and slot[TEXT] != "*" else INLINE)]

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        root = parse(page)
        self.varies = self.root is not None and self.sizes[id(self.root)] > 0
        blocks: list[str] = []
        parts: list[str] = []

        def end() -> None:
            block = " ".join("".join(parts).split())
            if block:
                blocks.append(block)
            parts.clear()

        def is_apart(item: Node, slot: list | None) -> bool:
            """Whether an element inside the main text is no part of it."""
            if item.tag in HIDDEN or not item.apart:
                return item.tag in HIDDEN
            if not marked or not item.weak:
                return True
            return self._is_template(item, slot, NONE) or not _is_text(item)

        def read(node: Node, slot: list | None, spared: frozenset = PROSE) -> None:
            slots = {id(c): s for c, s in self._pairs(node, slot)} if slot is not None else {}
            for item in node.content:
                if type(item) is str:
                    parts.append(item)
                elif item.tag in ("br", "hr"):
                    parts.append(" ")
                elif is_apart(item, slots.get(id(item))):
                    if item.tag not in INLINE:
                        end()
                elif not self._is_template(item, slots.get(id(item)), spared):
                    inline = item.tag in INLINE
                    if not inline:
                        end()
                    read(item, slots.get(id(item)))
                    if not inline:
                        end()

        self.blank = _blank_nodes(root)
        regions = self.region(root)
        marked = any(node.tag in MAIN for node, _, _ in regions)
        for node, slot, spared in regions:
            read(node, slot, spared)
            end()
        return "\n\n".join(blocks)


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of each, and ``n_chars``.

    Elements that the standard or their class sets apart from the main text are left out, and so is
    what the host's wrapper knows as template. Inside an article, names that parts of it may have too (``WEAK_NAMES``, and ``header``)
    set an element apart only if the wrapper knows it as the same on all pages, or if it is mostly links without a
    heading. Pages may be nested to any depth. Where the page marks its article, the text is read
    there, and paragraphs are never taken for template; elsewhere in the lowest node that holds all that
    is neither template nor apart, without its constant children. Blocks have their white space made single and are joined by an empty
    line. NULL or empty html gives ''; a NULL url is a host of its own. Equal pages prove no
    template. No row is lost; columns of the new names are replaced.
    """
    wrappers = staged(induce(pages, url, html), "wrappers")
    kept = pages.drop("text", "n_chars")
    placed = kept.withColumn("__host", url_host(F.col(url))).join(wrappers.select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper")), "__host", "left")
    placed = placed.select(*kept.columns, "__wrapper")
    place = kept.columns.index(html)
    schema = fields(kept.schema, "text string, n_chars long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str | None, Wrapper] = {}
            texts = []
            for page, text in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if text not in known:
                    known[text] = Wrapper(text)
                texts.append(known[text].text(page))
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrow_map(placed, read, schema)
