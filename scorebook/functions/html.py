"""HTML text expressions and the small parser for pages regexes cannot read.

Everything downstream works on *flat fragments*: the text of one element whose
tags close explicitly, whose attributes are quoted and which holds only common
entities. Regular pages are cut into fragments by regexes inside the JVM; the
others pass through the HTML parser, which writes the same kind of fragment.
"""

from __future__ import annotations

import html as html_lib
from collections import Counter
from collections.abc import Callable
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.functions.clean import strip_space
from scorebook.session import ship_package

_TAG = r"(?s)<[^>]*>"


def _element(tag: str) -> str:
    """From a start tag to its first end tag; runs without ``<`` are taken whole, which is the same as ``.*?`` and quicker."""
    return rf"(?is)<{tag}\b[^>]*>[^<]*+(?:<(?!/{tag}\s*>)[^<]*+)*+</{tag}\s*>"


_ROW, _CELL, _ANCHOR = map(_element, ("tr", "td", "a"))


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A plain projection is merged into later ones and an expensive expression
    then runs once per use; a one-element explode keeps it a step of its own.
    """
    for name, expr in columns.items():
        df = df.select("*", F.explode(F.array(expr)).alias(name))
    return df


def decode_entities(col: Column) -> Column:
    """The entities flat fragments may hold; ``&amp;`` last so nothing decodes twice."""
    for name, char in (("&nbsp;", "\N{NO-BREAK SPACE}"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                       ("&#39;", "'"), ("&amp;", "&")):
        col = F.replace(col, F.lit(name), F.lit(char))
    return col


def text_of(fragment: Column) -> Column:
    text = F.regexp_replace(fragment, _TAG, "")
    return F.when(F.contains(fragment, F.lit("&")), decode_entities(text)).otherwise(text)


def attribute(fragment: Column, name: str) -> Column:
    """Quoted attribute of the opening tag a fragment starts with, else null."""
    pattern = rf"""(?is)^<[^>]*?\s{name}\s*=\s*(["'])(.*?)\1"""
    return decode_entities(F.nullif(F.regexp_extract(fragment, pattern, 2), F.lit("")))


def anchors(fragment: Column) -> Column:
    """Anchors of a fragment in document order, as fragments."""
    return F.regexp_extract_all(fragment, F.lit(_ANCHOR), F.lit(0))


def first_anchor(fragment: Column, href_contains: str) -> Column:
    """First anchor whose address contains a text (any case), as a fragment."""
    return F.get(F.filter(anchors(fragment), lambda a: F.contains(
        F.lower(attribute(a, "href")), F.lit(href_contains.lower()))), F.lit(0))


def cells(row: Column) -> Column:
    """Cells of a row fragment, as fragments."""
    return F.regexp_extract_all(row, F.lit(_CELL), F.lit(0))


def cell_texts(row: Column) -> Column:
    """Trimmed texts of the cells of a row fragment."""
    return F.transform(cells(row), lambda c: strip_space(text_of(c)))


_NOISE = r"(?is)<(?:!--.*?-->|(script|style)\b[^>]*>.*?</\1\s*>)"
# What fragments must not hold: uncommon entities, attributes without quotes or with an angle bracket.
_ODD = (r"""(?is)(?=[&<=])(?:&(?!(?:nbsp|lt|gt|quot|amp|#39);)#?\w|<\w[^<>]*\s(?:href|class|id)\s*=\s*[^\s"'>]"""
        r"""|=\s*"[^"<>]*[<>][^"<>]*"|=\s*'[^'<>]*[<>][^'<>]*')""")


def cleaned(page: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(page, _NOISE, "")


def is_regular(page: Column, tags: tuple[str, ...], fragments: Column) -> Column:
    """True when regexes read the fragments of a cleaned page exactly: the tags
    close explicitly, tables do not nest, no comment or script is left open, and the
    fragments themselves hold only quoted attributes and common entities."""
    # Both ends of all tags in two passes; every tag has to occur as often in one list as in the other.
    either = "|".join(sorted(tags, key=len, reverse=True))
    starts, ends = (F.regexp_extract_all(page, F.lit(form), F.lit(1)) for form in (rf"(?i)<({either})\b", rf"(?i)</({either})\s*>"))
    lowered = lambda names: F.sort_array(F.split(F.lower(F.array_join(names, ",")), ","))
    paired = (F.sort_array(starts) == F.sort_array(ends)) | (lowered(starts) == lowered(ends))
    odd = page.rlike(r"(?is)<(?:table\b[^<]*+(?:<(?!/table|table\b)[^<]*+)*+<table\b|!--|script|style|textarea)")
    # What is odd in a fragment is odd on the page too, so most pages need no look at each fragment.
    return ~odd & paired & (~page.rlike(_ODD) | ~F.exists(fragments, lambda f: f.rlike(_ODD)))


def is_flat(page: Column) -> Column:
    """True when regexes read the rows of a cleaned page exactly."""
    return is_regular(page, ("tr", "td"), F.regexp_extract_all(page, F.lit(_ROW), F.lit(0)))


class _RowReader(HTMLParser):
    """Rows of one page in document order, nested tables included.

    As in a document tree, an outer row contains the text and the cells of the
    tables inside it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.stack: list[tuple[str, dict]] = []
        self.quiet = 0

    def _open(self, kind: str) -> list[dict]:
        return [node for tag, node in self.stack if tag == kind]

    def _close(self, tag: str, stop: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if self.stack[i][0] == stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.quiet += 1
        if tag not in ("table", "tr", "td", "a"):
            return
        if tag != "table":
            # End tags may be missing: a new row, cell or link ends the one before.
            self._close(tag, {"tr": "table", "td": "tr", "a": "td"}[tag])
        given = dict(attrs)
        node = {"tag": tag, "parts": [], "cells": [], "attrs": given}
        if tag == "tr":
            tables = self._open("table")
            node["table"] = tables[-1]["attrs"].get("id") if tables else None
            self.rows.append(node)
        elif tag == "td":
            for row in self._open("tr"):
                row["cells"].append(node)
        elif tag == "a":
            for cell in self._open("td"):
                cell["parts"].append(node)
        self.stack.append((tag, node))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.quiet = max(0, self.quiet - 1)
        elif tag == "table":
            self._close("table", "")
        elif tag in ("tr", "td", "a"):
            self._close(tag, "table")

    def handle_data(self, data):
        if self.quiet:
            return
        inside = False
        for tag, node in reversed(self.stack):
            # An anchor inside a cell writes its own text there.
            inside = inside or tag == "a"
            if tag == "a" or (tag == "td" and not inside):
                node["parts"].append(data)


def _attrs(node: dict) -> str:
    return "".join(f' {k}="{html_lib.escape(v)}"' for k, v in node["attrs"].items() if v and k in ("class", "href", "id"))


def _write(node: dict) -> str:
    inner = "".join(html_lib.escape(p).replace("&#x27;", "&#39;") if isinstance(p, str) else _write(p) for p in node["parts"])
    return f"<{node['tag']}{_attrs(node)}>{inner}</{node['tag']}>"


def _flatten(page: str | None, table_id: str | None) -> list[str] | None:
    if page is None:
        return None
    reader = _RowReader()
    reader.feed(page)
    reader.close()
    return [f"<tr{_attrs(row)}>{''.join(map(_write, row['cells']))}</tr>" for row in reader.rows
            if table_id is None or row["table"] == table_id]


def with_rows(pages: DataFrame, mode: str = "auto", table_id: str | None = None, out: str = "_rows") -> DataFrame:
    """Replace ``html`` by the page's row fragments in document order.

    ``flat`` uses regexes only and ``parser`` the HTML parser only; ``auto``
    sends a page's text to the parser only when regexes could misread it, so a
    regular page costs one null crossing to Python. ``table_id`` limits the rows
    to one table.
    """
    page = F.col("html")
    if mode != "flat":
        ship_package(pages.sparkSession)
    parse = F.pandas_udf(lambda texts: texts.map(lambda t: _flatten(t, table_id)), T.ArrayType(T.StringType()))
    clean = page if mode == "parser" else F.col("_clean")
    if mode != "parser":
        pages = fixed(pages, _clean=cleaned(page))
    source = clean if table_id is None else F.regexp_extract(
        clean, rf"""(?is)<table\b[^>]*?\sid\s*=\s*["']{table_id}["'][^>]*>.*?</table\s*>""", 0)
    regex = F.regexp_extract_all(source, F.lit(_ROW), F.lit(0))
    if mode == "flat":
        rows = regex
    elif mode == "parser":
        rows = parse(page)
    else:
        pages = fixed(pages, _flat=is_flat(clean))
        rows = F.when(F.col("_flat"), regex).otherwise(parse(F.when(~F.col("_flat"), page)))
    return fixed(pages, **{out: rows}).drop("html", "_flat", "_clean")


class _Node:
    def __init__(self, tag: str, attrs: dict) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def below(self, *tags: str):
        """Descendants with one of the tags, in document order, however deep they are."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, _Node):
                if child.tag in tags:
                    yield child
                stack.append(iter(child.children))

    def flat(self) -> str:
        """The inner text with links, other tags left out."""
        out, stack = [], [(iter(self.children), "")]
        while stack:
            children, end = stack[-1]
            child = next(children, None)
            if child is None:
                out.append(end)
                stack.pop()
            elif isinstance(child, _Node):
                link = child.tag == "a"
                if link:
                    out.append(f"<a{_attrs({'attrs': child.attrs})}>")
                stack.append((iter(child.children), "</a>" if link else ""))
            else:
                out.append(html_lib.escape(child).replace("&#x27;", "&#39;"))
        return "".join(out)

    def written(self, tag: str | None = None) -> str:
        inner = "".join(c.written() for c in self.below("td")) if self.tag == "tr" else self.flat()
        return f"<{tag or self.tag}{_attrs({'attrs': self.attrs})}>{inner}</{tag or self.tag}>"


class _TreeReader(HTMLParser):
    """A document as a tree; missing end tags of rows, cells, paragraphs, items and links are supplied."""

    VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
    BLOCK = frozenset({"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "form", "hr", "tr", "td", "article", "section", "nav"})
    # A start tag ends these open elements, unless one of the stops stands between.
    ENDS = {"tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
            "li": (("li",), ("ul", "ol", "table")), "a": (("a",), ("td", "table"))}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.stack = [self.root]
        self.open = Counter()
        self.quiet = 0

    def _end(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        if not any(self.open[tag] for tag in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self.open.subtract(node.tag for node in self.stack[i:])
                del self.stack[i:]
                return
            if self.stack[i].tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.quiet += 1
        if tag in self.BLOCK:
            self._end(("p",), ("td", "th", "table"))
        if tag in self.ENDS:
            self._end(*self.ENDS[tag])
        node = _Node(tag, dict(attrs))
        self.stack[-1].children.append(node)
        if tag not in self.VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.quiet = max(0, self.quiet - 1)
        self._end((tag,), () if tag == "table" else ("table",) if tag in ("tr", "td", "th") else ("td", "th", "table"))

    def handle_data(self, data):
        if not self.quiet:
            self.stack[-1].children.append(data)


def with_fragments(pages: DataFrame, found: Callable[[Column], Column], tags: tuple[str, ...],
                   parsed: Callable[[_Node], list[str]], out: str) -> DataFrame:
    """Replace ``html`` by an array of fragments: ``found`` takes them from a cleaned page by regexes, and ``parsed`` from the
    tree of a page that regexes could misread. ``tags`` must close explicitly for the first way. A page that the parser cannot
    read has no array: ``split_readable(result, F.col(out).isNotNull() | ...)`` lists it, and other pages go on."""
    ship_package(pages.sparkSession)

    def read(page: str | None) -> list[str] | None:
        if page is None:
            return None
        reader = _TreeReader()
        try:
            reader.feed(page)
            reader.close()
            return parsed(reader.root)
        except (AssertionError, ValueError):  # what the parser raises on declarations it cannot read
            return None

    parse = F.pandas_udf(lambda texts: texts.map(read), T.ArrayType(T.StringType()))
    pages = fixed(pages, _clean=cleaned(F.col("html")))
    pages = fixed(pages, _found=found(F.col("_clean")))
    pages = fixed(pages, _flat=is_regular(F.col("_clean"), tags, F.col("_found")))
    rows = F.when(F.col("_flat"), F.col("_found")).otherwise(parse(F.when(~F.col("_flat"), F.col("html"))))
    return fixed(pages, **{out: rows}).drop("html", "_flat", "_clean", "_found")
