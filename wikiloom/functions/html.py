"""Links of HTML pages.

Links chosen by their own tag or class are cut out by expressions. Links chosen by an
enclosing element, and link texts, need the open elements, which are followed page by
page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Elements without content, so without an end tag (HTML standard).
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)

# Attributes as the HTML standard cuts them: a quote opens a value only right after ``=``. A
# value whose quote is never closed makes no tag.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>|(?![\s\S])))"""
_NAME = r"[^\s/>][^\s/>=]*+"
_ATTRIBUTES = rf"(?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE}|(?!\s*+=)))*+"

# What a page consists of besides text: comments, elements whose content is no markup, tags.
_COMMENT = r"<!--.*?-->"
_RAW = rf"<(script|style|textarea|title)(?=[\s/>]){_ATTRIBUTES}>.*?</\1(?=[\s/>])"
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)(?:;|(?![=A-Za-z0-9]))")


def _up_to(name: str) -> str:
    """Pattern of a tag's attributes up to the first of this name."""
    end = r"(?:[\s=/]|$)"
    others = rf"(?:[\s/]*+(?!{name}{end}){_NAME}(?:\s*+=\s*+{_VALUE})?+)*+"
    return rf"(?is)^{others}[\s/]*+{name}(?={end})"


def _attribute(attributes: Column, name: str) -> Column:
    """Raw value of one attribute of a tag, '' if it is missing."""
    found = F.regexp_extract(attributes, _up_to(name) + rf"\s*+=\s*+({_VALUE})", 1)
    return F.regexp_replace(found, r"""(?s)^(["'])(.*)\1$""", "$2")


def tags(page: Column, tag: str = "[a-z][a-z0-9]*") -> Column:
    """Attribute texts of all start tags of a page, in order; '' for everything else."""
    wanted = rf"<{tag}(?=[\s/>])({_ATTRIBUTES})>"
    others = rf"</?[a-z][^\s/>]*+{_ATTRIBUTES}>"
    return F.regexp_extract_all(page, F.lit(rf"(?is){_COMMENT}|{_RAW}|{wanted}|{others}"), F.lit(2))


def _decoded(value: str) -> str:
    """An attribute value with its character references decoded."""
    if "&" not in value:
        return value
    return _REFERENCE.sub(lambda m: html.unescape(m[0]), value)


@F.pandas_udf(T.StringType())
def decoded(values: pd.Series) -> pd.Series:
    return values.map(_decoded)


def has_class(attributes: Column, name: str) -> Column:
    """Whether a tag has a class; classes are compared in any case."""
    return F.array_contains(F.split(F.lower(_attribute(attributes, "class")), r"\s+"), name.lower())


def has_attribute(attributes: Column, name: str) -> Column:
    return attributes.rlike(_up_to(name))


def mentions(page: Column, text: str) -> Column:
    """Whether a page can hold an element named by ``text``: a cheap filter before parsing."""
    return F.contains(F.lower(page), F.lit(text.lower()))


def link_target(attributes: Column) -> Column:
    return decoded(_attribute(attributes, "href"))


# One step through a page: what is skipped as a whole, or one start or end tag.
_STEP = re.compile(rf"{_COMMENT}|{_RAW}\s*>|<(/?)([a-z][^\s/>]*+)({_ATTRIBUTES})>", re.IGNORECASE | re.DOTALL)
_NAMED_VALUE = re.compile(rf"""({_NAME})(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
_OF_INTEREST = re.compile("href|class", re.IGNORECASE)

# Which elements end without an end tag (HTML standard): a start tag ends the outermost of the
# named open elements that lies inside any element of the second set.
_SCOPE = frozenset("applet caption html marquee object table td template th".split())
_SPECIAL = _SCOPE | frozenset(
    "address area article aside base basefont bgsound blockquote body br button center col colgroup dd details dir div "
    "dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr iframe "
    "img input keygen li link listing main menu meta nav noembed noframes noscript ol p param plaintext pre script "
    "search section select source style summary tbody textarea tfoot thead title tr track ul wbr xmp".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_P = _HEADINGS | frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_ITEM = _SPECIAL - {"address", "div", "p"}
_TABLE = frozenset(["table", "template"])
_CELLS = frozenset(["td", "th"])
_ROWS = _CELLS | {"tr", "caption", "colgroup"}
_GROUPS = _ROWS | {"tbody", "thead", "tfoot"}
_IMPLIED = {
    "li": (frozenset(["li"]), _ITEM),
    "dt": (frozenset(["dt", "dd"]), _ITEM),
    "dd": (frozenset(["dt", "dd"]), _ITEM),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (_CELLS, _TABLE),
    "th": (_CELLS, _TABLE),
    "tr": (_ROWS, _TABLE),
    "tbody": (_GROUPS, _TABLE),
    "thead": (_GROUPS, _TABLE),
    "tfoot": (_GROUPS, _TABLE),
}


def _end_scope(tag: str) -> frozenset[str]:
    """Elements across which an end tag has no effect."""
    if tag in _TABLE or tag in _GROUPS:
        return _TABLE
    if tag == "li":
        return _SCOPE | {"ul", "ol"}
    if tag == "p":
        return _SCOPE | {"button"}
    return _SCOPE if tag in _SPECIAL or tag in _FORMATTING else _SPECIAL


@dataclass
class _Element:
    tag: str
    href: str | None
    marked: frozenset[str]
    within: list[int]
    text: list[str] = field(default_factory=list)


def _values(attributes: str) -> dict[str, str]:
    """Attributes of a tag; the first of equal names counts."""
    found = {}
    for match in _NAMED_VALUE.finditer(attributes):
        value = match[2] or match[3] or match[4] or ""
        found.setdefault(match[1].lower(), _decoded(value))
    return found


def _parse(page: str, *markers: str) -> list[_Element]:
    """Links and elements of the classes ``markers`` of a page, with their texts and enclosing marks."""
    wanted_classes = {m.lower(): m for m in markers}
    found: list[_Element] = []
    opened: list[tuple[str, _Element | None, int]] = []
    collecting: list[_Element] = []
    marks, place = 0, 0

    def close(depth: int) -> None:
        for _, element, _ in opened[depth:]:
            if element is not None:
                collecting.remove(element)
        del opened[depth:]

    def innermost(wanted: frozenset[str], stops: frozenset[str]) -> int | None:
        for depth in range(len(opened) - 1, -1, -1):
            if opened[depth][0] in wanted:
                return depth
            if opened[depth][0] in stops:
                break
        return None

    def end(tag: str) -> None:
        """An end tag closes the innermost such element and what is open in it."""
        if tag in ("body", "html"):
            return  # what follows belongs to the body all the same
        depth = innermost(_HEADINGS if tag in _HEADINGS else frozenset([tag]), _end_scope(tag))
        if depth is None:
            return
        if tag in _FORMATTING and any(o[0] in _SPECIAL for o in opened[depth + 1 :]):
            # The blocks inside stay open.
            if opened[depth][1] is not None:
                collecting.remove(opened[depth][1])
            del opened[depth]
        else:
            close(depth)

    def imply_ends(tag: str) -> None:
        wanted, stops = _IMPLIED.get(tag, (frozenset(), frozenset()))
        outermost = None
        for depth in range(len(opened) - 1 if wanted else -1, -1, -1):
            # An item ends at its own kind, so that comes before the stops.
            if opened[depth][0] in wanted:
                outermost = depth
            elif opened[depth][0] in stops:
                break
        if outermost is not None:
            close(outermost)
        if tag in _ENDS_P and (depth := innermost(frozenset(["p"]), _SCOPE | {"button"})) is not None:
            close(depth)
        if tag in _HEADINGS and opened and opened[-1][0] in _HEADINGS:
            close(len(opened) - 1)

    for step in _STEP.finditer(page):
        for element in collecting:
            element.text.append(page[place : step.start()])
        place = step.end()
        tag = step[3]
        if tag is None:
            continue
        tag = tag.lower()
        if step[2] or tag == "a":  # a link also ends the link before
            end(tag)
        if step[2]:
            continue
        imply_ends(tag)
        values = _values(step[4]) if _OF_INTEREST.search(step[4]) else {}
        marked = frozenset(wanted_classes[c] for c in values.get("class", "").lower().split() if c in wanted_classes)
        mark = marks if marked else -1
        marks += bool(marked)
        element = None
        if marked or tag == "a" or "href" in values:
            within = [m for _, _, m in opened if m >= 0] + [mark] * bool(marked)
            element = _Element(tag, values.get("href"), marked, within)
            found.append(element)
        if tag not in VOID:
            opened.append((tag, element, mark))
            if element is not None:
                collecting.append(element)
    for element in collecting:
        element.text.append(page[place:])
    return found


def _text(element: _Element) -> str:
    return " ".join(html.unescape("".join(element.text)).split())


def _page_rows(
    pages: DataFrame, needles: Sequence[str], columns: list[str], rows_of: Callable[[str], list[tuple]]
) -> DataFrame:
    """``rows_of`` each page that holds one of ``needles``, numbered by ``pos``.

    The other columns of the pages are kept.
    """
    kept = [f for f in pages.schema.fields if f.name != "html"]
    keys = [f.name for f in kept]
    schema = T.StructType(
        [
            *kept,
            T.StructField("pos", T.IntegerType()),
            *[T.StructField(c, T.StringType()) for c in columns],
        ]
    )

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            per_page = [rows_of(page) for page in batch["html"]]
            repeated = batch.index.repeat([len(rows) for rows in per_page])
            found = pd.DataFrame(
                [(pos, *row) for rows in per_page for pos, row in enumerate(rows)],
                columns=["pos", *columns],
            )
            yield pd.concat([batch.loc[repeated, keys].reset_index(drop=True), found], axis=1)

    return (
        pages.filter(reduce(or_, [mentions(F.col("html"), n) for n in needles]))
        .select(*keys, "html")
        .mapInPandas(extract, schema)
    )


def anchors_within(pages: DataFrame, marker: str) -> DataFrame:
    """``pos, href`` of anchors inside elements of a class, per page.

    An anchor inside several such elements comes once for each of them.
    """

    def rows_of(page: str) -> list[tuple]:
        found = [
            (mark, number, element.href or "")
            for number, element in enumerate(_parse(page, marker))
            if element.tag == "a"
            for mark in element.within
        ]
        return [(href,) for _, _, href in sorted(found)]

    return _page_rows(pages, [marker], ["href"], rows_of)


def links_with_text(pages: DataFrame, prefix: str = "") -> DataFrame:
    """``pos, href, text`` per page of elements whose href starts with ``prefix``."""

    def rows_of(page: str) -> list[tuple]:
        return [
            (e.href, _text(e))
            for e in _parse(page)
            if e.href is not None and e.href.startswith(prefix)
        ]

    return _page_rows(pages, ["href"], ["href", "text"], rows_of)


def marked_texts(pages: DataFrame, marker: str, tag: str | None = None) -> DataFrame:
    """``pos, text`` per page of elements of a class, if wanted of one tag only."""

    def rows_of(page: str) -> list[tuple]:
        return [
            (_text(e),) for e in _parse(page, marker) if e.marked and (tag is None or e.tag == tag)
        ]

    return _page_rows(pages, [marker], ["text"], rows_of)


def marked_elements(pages: DataFrame, *classes: str) -> DataFrame:
    """``pos, mark, href, text`` per page of the elements of any of the classes, from one walk.

    An element of several of the classes comes once for each; ``href`` is '' where there is none.
    """

    def rows_of(page: str) -> list[tuple]:
        return [(mark, e.href or "", _text(e)) for e in _parse(page, *classes) for mark in classes if mark in e.marked]

    return _page_rows(pages, classes, ["mark", "href", "text"], rows_of)
