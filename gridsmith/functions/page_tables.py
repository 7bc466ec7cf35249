"""M6: rows of peak hours from the one table of a page that is about a year.

Tags nest, so pages are parsed, but only those that have a table and in batches of columns. The table
is the one that follows the first h3 whose text names the year, as a later sibling: a table, or the
first one in a div of class table-wrapper. Otherwise it is the page's first. Rows count if they stand in its
tbody and have five cells or more: level, spring, summer, autumn, winter."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Fixed value: how a heading says from when its table holds.
VALID_FROM = "gültig ab 01.01.{year}"
#: A span larger than this is taken as this.
MOST_SPAN = 100


class Node:
    __slots__ = ("attrs", "inside", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None) -> None:
        self.tag, self.attrs, self.inside, self.parent = tag, attrs, [], parent

    def all(self, *tags: str) -> Iterator[Node]:
        """Elements of these tags below, in order."""
        left = list(reversed(self.inside))
        while left:
            x = left.pop()
            if isinstance(x, Node):
                if x.tag in tags:
                    yield x
                left.extend(reversed(x.inside))

    def texts(self) -> Iterator[str]:
        """Texts below in order, a line break as its own."""
        left = list(reversed(self.inside))
        while left:
            x = left.pop()
            if isinstance(x, str):
                yield x.strip()
            elif x.tag == "br":
                yield "\n"
            else:
                left.extend(reversed(x.inside))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.handle_startendtag(tag, attrs)
        if tag not in VOID:
            self.open.append(self.open[-1].inside[-1])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].inside.append(Node(tag, dict(attrs), self.open[-1]))

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.open[-1].inside.append(data)


def parsed(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _about(root: Node, year: int) -> Node | None:
    """The table that follows the first heading of the year, if there is one."""
    heading = next((h for h in root.all("h3") if VALID_FROM.format(year=year) in _raw(h)), None)
    if heading is None:
        return None
    beside = heading.parent.inside
    for x in beside[next(k for k, n in enumerate(beside) if n is heading) + 1 :]:
        if isinstance(x, Node) and x.tag == "table":
            return x
        if isinstance(x, Node) and x.tag == "div" and "table-wrapper" in (x.attrs.get("class") or "").split():
            return next(x.all("table"), None)
    return None


def _raw(node: Node) -> str:
    out, left = [], list(reversed(node.inside))
    while left:
        x = left.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            left.extend(reversed(x.inside))
    return "".join(out)


def _span(cell: Node, name: str) -> int:
    said = cell.attrs.get(name) or "1"
    return max(1, min(int(said), MOST_SPAN)) if said.isascii() and said.isdigit() else 1


def grid(body: Node) -> list[list[Node]]:
    """Rows with each spanning cell in every place that it spans."""
    held: dict[int, tuple[int, Node]] = {}
    out = []
    for row in body.all("tr"):
        cells: list[Node] = []
        own = list(row.all("td"))
        while own or any(n > 0 and k >= len(cells) for k, (n, _) in held.items()):
            k = len(cells)
            n, above = held.get(k, (0, None))
            if n > 0 and above is not None:
                held[k] = (n - 1, above)
                cells.append(above)
            elif own:
                cell = own.pop(0)
                for place in range(k, k + _span(cell, "colspan")):
                    cells.append(cell)
                    held[place] = (_span(cell, "rowspan") - 1, cell)
            else:
                break
        out.append(cells)
    return out


def _line(cell: Node) -> str:
    return " ".join(" ".join(x for x in cell.texts() if x).split())


def _lines(cell: Node) -> str | None:
    lines = [x.strip() for x in "".join(cell.texts()).split("\n")]
    return "\n".join(x for x in lines if x) or None


def records(html: str, year: int, spans: bool = False) -> list[tuple[str, str | None, str | None, str | None, str | None]]:
    """(level, spring, summer, autumn, winter) of each row."""
    root = parsed(html)
    table = _about(root, year) or next(root.all("table"), None)
    body = table and next(table.all("tbody"), None)
    if not body:
        return []
    rows = grid(body) if spans else [list(row.all("td")) for row in body.all("tr")]
    return [(_line(r[0]), *map(_lines, r[1:5])) for r in rows if len(r) >= 5 and _line(r[0])]


def hours(pages: DataFrame, key: str, html: Column, year: Column, spans: bool = False) -> DataFrame:
    """(key, year, level, spring, summer, autumn, winter). Without spans, cells that span count once, where they stand."""
    names = ["voltage_level", "fruehling", "sommer", "herbst", "winter"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, y, *r) for k, y, h in zip(batch[key], batch["year"], batch["html"], strict=True) for r in records(h, y, spans)]
            yield pd.DataFrame(found, columns=[key, "year", *names]).astype({key: batch[key].dtype, "year": "int32"})

    kind = pages.schema[key].dataType.simpleString()
    own = pages.select(key, year.cast("int").alias("year"), html.alias("html")).filter(F.contains(F.lower("html"), F.lit("<table")) & F.contains(F.lower("html"), F.lit("<tbody")) & F.col("year").isNotNull())
    return own.mapInPandas(read, f"{key} {kind}, year int, " + ", ".join(f"{n} string" for n in names))
