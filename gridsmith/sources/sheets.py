"""The first rows of the first sheets of XLSX workbooks, read from the parts of the archive.

A cell is what its kind says: shared, inline or formula text, TRUE and FALSE, an error's name, a date
where its style is one, or a number. Text of a row is its cells with one blank between, from column A to
the sheet's width; blank, zero and false cells are empty. Rows that are empty are left out, and
a workbook that can't be read, or is an old binary one, has no rows."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHEETS, ROWS = 2, 50
#: Parts of a workbook larger than this, unpacked, are refused.
MOST = 200 << 20
#: Fixed values of the format: numbers of the date formats that workbooks needn't declare.
DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47, *range(27, 37), *range(50, 59)}
DAY_ONE = datetime(1899, 12, 30)


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _text(e: ElementTree.Element) -> str:
    """Text of an item without that of its phonetic runs."""
    return "".join(t.text or "" for child in e for t in ([child] if _tag(child) == "t" else child if _tag(child) == "r" else []) if _tag(t) == "t")


class Workbook:
    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.strings = [_text(e) for e in self.part("xl/sharedStrings.xml", [])]
        self.dates = self._date_styles()
        props = next((e for e in self.part("xl/workbook.xml", []) if _tag(e) == "workbookPr"), None)
        self.first_day = datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else DAY_ONE

    def open(self, name: str) -> io.BufferedIOBase:
        if self.zip.getinfo(name).file_size > MOST:
            raise ValueError(f"{name} is too large")
        return self.zip.open(name)

    def part(self, name: str, otherwise: object) -> object:
        if name not in self.zip.namelist():
            return otherwise
        with self.open(name) as f:
            return ElementTree.parse(f).getroot()

    def _date_styles(self) -> list[bool]:
        """For each cell style whether it shows a date."""
        root = self.part("xl/styles.xml", [])
        own = {int(f.get("numFmtId")) for e in root if _tag(e) == "numFmts" for f in e if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or ""), re.I)}
        return [int(x.get("numFmtId") or 0) in DATES | own for e in root if _tag(e) == "cellXfs" for x in e]

    def sheets(self) -> list[str]:
        """Names of the sheets' parts, in the workbook's order."""
        links = {r.get("Id"): r.get("Target") for r in self.part("xl/_rels/workbook.xml.rels", [])}
        out = []
        for e in self.part("xl/workbook.xml", []):
            for s in e if _tag(e) == "sheets" else ():
                target = links.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""), "")
                name = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
                if "worksheets/" in name:  # not a chart
                    out.append(name)
        return out

    def value(self, c: ElementTree.Element) -> str:
        kind, held = c.get("t", "n"), {_tag(x): x for x in c}
        if kind == "inlineStr":
            return _text(held["is"]) if "is" in held else ""
        raw = (held["v"].text or "") if "v" in held else ""
        if not raw:
            return ""
        if kind == "s":
            return self.strings[int(raw)]
        if kind in ("str", "e", "d"):
            return raw
        if kind == "b":
            return "True" if raw == "1" else ""
        number = float(raw) if re.search("[.eE]", raw) else int(raw)
        style = int(c.get("s") or 0)
        if style < len(self.dates) and self.dates[style]:
            at = self.first_day + timedelta(milliseconds=round(number * 86_400_000))
            return str(at.time()) if 0 <= number < 1 else str(at)
        return str(number) if number else ""

    def rows(self, name: str, most: int) -> Iterator[tuple[int, list[str]]]:
        """(row from 0, cells) of the first rows. Reading stops there, however long the sheet is."""
        width, at = 0, 0
        with self.open(name) as f:
            for event, e in ElementTree.iterparse(f, ("start", "end")):
                tag = _tag(e)
                if event == "start":
                    if tag == "dimension":
                        width = max((_column(r) + 1 for r in (e.get("ref") or "").split(":")[1:]), default=0)
                    continue
                if tag != "row":
                    continue
                at = int(e.get("r") or at + 1)
                if at > most:
                    return
                cells: list[str] = []
                for c in e:
                    place = _column(c.get("r") or "") if c.get("r") else len(cells)
                    cells += [""] * (place + 1 - len(cells))
                    cells[place] = self.value(c)
                e.clear()
                yield at - 1, cells + [""] * (width - len(cells))


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Za-z]*", ref)[0].upper():
        n = 26 * n + ord(ch) - 64
    return n - 1


def workbook_rows(content: bytes | None, sheets: int = SHEETS, rows: int = ROWS) -> list[tuple[int, int, list[str]]]:
    """(sheet, row, cells), both from 0; none of what can't be read."""
    try:
        book = Workbook(content or b"")
        return [(k, r, cells) for k, name in enumerate(book.sheets()[:sheets]) for r, cells in book.rows(name, rows)]
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, OverflowError, NotImplementedError, RuntimeError, EOFError):
        return []


def cells(books: DataFrame, sheets: int = SHEETS, rows: int = ROWS) -> DataFrame:
    """(path, sheet, row, cells) of (path, content) rows. A workbook is read at once; of its sheets only the first rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                if got := workbook_rows(content.as_py(), sheets, rows):
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(got), pa.string()), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.list_(pa.string()))], names=["path", "sheet", "row", "cells"])

    return books.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(read, "path string, sheet int, row int, cells array<string>")


def text(books: DataFrame, sheets: int = SHEETS, rows: int = ROWS) -> DataFrame:
    """(path, text) of the workbooks that hold some text."""
    line = F.array_join("cells", " ")
    own = cells(books, sheets, rows).select("path", "sheet", "row", line.alias("line")).filter(F.trim(F.regexp_replace("line", r"\s", "")) != "")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("sheet", "row", "line"))), lambda r: r["line"])
    return own.groupBy("path").agg(F.array_join(lines, "\n").alias("text"))


def packed(sheets: list[list[list[str | float | None]]]) -> bytes:
    """A workbook of texts (shared) and numbers, a list of rows for each sheet."""
    from xml.sax.saxutils import escape

    shared: dict[str, int] = {}

    def cell(ref: str, v: str | float | None) -> str:
        if v is None:
            return ""
        if isinstance(v, str):
            return f'<c r="{ref}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>'
        return f'<c r="{ref}"><v>{v!r}</v></c>'

    def letters(n: int) -> str:
        return (letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for k, rows in enumerate(sheets, 1):
            data = "".join(f'<row r="{r}">' + "".join(cell(f"{letters(i)}{r}", v) for i, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {space}><sheetData>{data}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="{links}"><sheets>' + "".join(f'<sheet name="s{k}" sheetId="{k}" r:id="r{k}"/>' for k in range(1, len(sheets) + 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
    return held.getvalue()
