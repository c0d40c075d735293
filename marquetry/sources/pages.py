"""Tables out of pages and feeds: HTML tables, specification blocks, release lists, RSS.

Parsing is per document, so it runs as a map over Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

_CUT = re.compile(r"(.+?)\s*\((\d+):(\d{2})\)\s*$")


class _Grid(HTMLParser):
    """Rows of cells of all tables of a page, header cells marked."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[bool, str]]] = []
        self._cell: list[str] | None = None
        self._head = False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self._end()
            self._cell, self._head = [], tag == "th"

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._end()

    def handle_data(self, data: str) -> None:
        if self._cell is not None:
            self._cell.append(data)

    def _end(self) -> None:
        if self._cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((self._head, " ".join("".join(self._cell).split())))
            self._cell = None


def table_rows(page: str | None, columns: tuple[str, ...]) -> list[tuple[str | None, ...]]:
    """Values of ``columns`` per body row: by header name where a header row came, else by position."""
    grid = _Grid()
    grid.feed(page or "")
    grid.close()
    place: dict[str, int] | None = None
    out = []
    for row in grid.rows:
        if row and all(head for head, _ in row):
            place = {text.lower(): i for i, (_, text) in enumerate(row)}
        elif row:
            cells = [text for _, text in row]
            at = [(place.get(c) if place is not None else i) for i, c in enumerate(columns)]
            out.append(tuple(cells[i] if i is not None and i < len(cells) else None for i in at))
    return out


class _Blocks(HTMLParser):
    """(section, line) of a page: a heading opens a section, breaks and block tags end a line."""

    def __init__(self, headings: tuple[str, ...]) -> None:
        super().__init__(convert_charrefs=True)
        self.headings, self.section, self.text, self.lines = headings, "", [], []
        self._in = False

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text = []
        if line and self._in:
            self.section = line
        elif line:
            self.lines.append((self.section, line))

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in self.headings:
            self.flush()
            self._in = True
        elif tag in ("br", "p", "div", "li", "ul", "tr"):
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.headings:
            self.flush()
            self._in = False
        elif tag in ("p", "div", "li", "ul", "tr"):
            self.flush()

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def blocks(page: str | None, headings: tuple[str, ...] = ("h1", "h2", "h3", "h4")) -> list[tuple[str, str]]:
    parser = _Blocks(headings)
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.lines


def spec_rows(page: str | None) -> list[tuple[str, str, str]]:
    """(section, name, value) of the 'name: value' lines under each heading."""
    return [(s, name.strip(), value.strip()) for s, line in blocks(page) for name, colon, value in [line.partition(":")] if colon and name.strip()]


def release_rows(page: str | None) -> list[tuple[int, str, str, int]]:
    """(number, release, cut, seconds): each heading is a release, each 'cut (mm:ss)' line one of its cuts."""
    order: dict[str, int] = {}
    out = []
    for release, line in blocks(page):
        if m := _CUT.match(line):
            out.append((order.setdefault(release, len(order)), release, m.group(1), int(m.group(2)) * 60 + int(m.group(3))))
    return out


def feed_people(feed: str | None) -> list[tuple[int, str, str, str]]:
    """(number, name, role, group) of the people a feed names; number -1 for those of the whole feed.

    People are the ``person`` elements (a host where no role is given) and, of a feed without any for itself,
    its author. A feed that breaks off gives what came before.
    """
    parser = ElementTree.XMLPullParser(["start", "end"])
    out: list[tuple[int, str, str, str]] = []
    author, inside, number = "", False, 0
    try:
        parser.feed(feed or "")
        parser.close()
    except ElementTree.ParseError:
        pass
    try:
        for event, element in parser.read_events():
            tag = element.tag.rpartition("}")[2]
            if tag == "item":
                inside = event == "start"
                number += event == "end"
            elif event == "end" and tag == "person" and (element.text or "").strip():
                out.append((number if inside else -1, element.text.strip(), (element.get("role") or "host").lower(), element.get("group") or ""))
            elif event == "end" and tag == "author" and not inside:
                author = author or (element.text or "").strip()
    except ElementTree.ParseError:
        pass
    if author and not any(n < 0 for n, *_ in out):
        out.insert(0, (-1, author, "host", ""))
    return out


def feed_rows(feed: str | None, most: int | None = None) -> list[tuple[int, str, str, str]]:
    """(number, title, published, duration) of a feed's episodes, also of one that breaks off; ``most`` of them, or all."""
    parser = ElementTree.XMLPullParser(["end"])
    out: list[tuple[int, str, str, str]] = []
    try:
        parser.feed(feed or "")
        parser.close()
    except ElementTree.ParseError:
        pass
    try:
        for _, element in parser.read_events():
            if element.tag == "item" and (most is None or len(out) < most):
                value = {child.tag.rpartition("}")[2]: (child.text or "").strip() for child in element}
                out.append((len(out), value.get("title", ""), value.get("pubDate", ""), value.get("duration", "")))
    except ElementTree.ParseError:
        pass
    return out


def parse(df: DataFrame, key: str, page: str, rows: Callable[[str | None], list[tuple]], columns: str) -> DataFrame:
    """One row per parsed row of each page: the key and ``columns`` (a DDL string).

    A null, empty or unreadable page gives no rows; other columns are never read.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, *r) for k, text in zip(batch[key], batch[page]) for r in rows(text)]
            yield pd.DataFrame(out, columns=[key, *names])

    return df.select(key, page).mapInPandas(run, f"{key} {kind}, {columns}")
