"""HTML, sitemaps and robots rules as column expressions; parsers where tags nest."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.catalogs import EMBEDDED_POINTS, EMBEDDED_WORDS, EMBEDDED_YEARS, PROTECTION_MARKERS, SYSTEMS

_DROP = "script|style|nav|footer|header"


def text_of(html: Column) -> Column:
    """M1: the text between tags, without scripts, styles, navigation, header and footer."""
    s = F.regexp_replace(html, rf"(?is)<({_DROP})\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?s)<[^>]+>", " "), r"\s+", " "))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def links(html: Column) -> Column:
    """M5: array of (href, text)."""
    rx = r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    hrefs, texts = F.regexp_extract_all(html, F.lit(rx), F.lit(1)), F.regexp_extract_all(html, F.lit(rx), F.lit(2))
    return F.zip_with(hrefs, texts, lambda h, t: F.struct(h.alias("href"), F.trim(F.regexp_replace(t, r"(?s)<[^>]+>", "")).alias("text")))


def resolve(base: Column, href: Column) -> Column:
    """An address relative to another: absolute ones, those of the root and of the folder."""
    root = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), r"(://[^/]+)?(/[^/]*)?$", "$1")
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, F.lit("/"), href))


def counters(html: Column, words: list[str]) -> Column:
    """Numbers of links, tables and keyword hits."""
    low = F.lower(html)
    hits = F.lit(0)
    for w in words:
        hits = hits + F.regexp_count(low, F.lit(w))
    return F.struct(F.regexp_count(low, F.lit(r"<a\s")).alias("links"), F.regexp_count(low, F.lit("<table")).alias("tables"), hits.alias("hits"))


def sitemap_urls(xml: Column) -> Column:
    """M8: addresses of a sitemap or an index, whatever the namespace, first seen first."""
    return F.array_distinct(F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<(?:\w+:)?loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:\w+:)?loc>"), F.lit(1)), lambda x: F.trim(x)))


def robots(body: Column) -> Column:
    """M9: struct of sitemaps and of the paths that all agents are denied."""
    lines = F.transform(F.split(body, "\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    value = lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))
    maps = F.transform(F.filter(lines, lambda x: F.lower(x).startswith("sitemap:")), value)
    first = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        low = F.lower(x)
        agent, deny = low.startswith("user-agent:"), low.startswith("disallow:")
        return F.struct(F.when(agent, value(x) == "*").otherwise(acc["on"]).alias("on"), F.when(deny & acc["on"] & (value(x) != ""), F.concat(acc["out"], F.array(value(x)))).otherwise(acc["out"]).alias("out"))

    return F.struct(maps.alias("sitemaps"), F.aggregate(lines, first, step, lambda a: a["out"]).alias("disallow"))


def protection(body: Column) -> Column:
    """What keeps crawlers out of a page: cloudflare, javascript_required or javascript_challenge; null if nothing."""
    low = F.lower(body)
    marked = F.exists(F.array(*[F.lit(x) for x in PROTECTION_MARKERS]), lambda m: F.contains(low, m))
    cloud = low.contains("cloudflare") | low.contains("cf_chl")
    return F.when(marked & cloud, "cloudflare").when(marked, "javascript_required").when(low.contains('meta http-equiv="refresh"') & low.contains("challenge"), "javascript_challenge")


def protected(body: Column) -> Column:
    return F.coalesce(protection(body).isNotNull(), F.lit(False))


def _tags(html: Column, name: str) -> Column:
    """Opening tags of a name, comments left out."""
    return F.regexp_extract_all(F.regexp_replace(html, "(?s)<!--.*?-->", ""), F.lit(rf"(?is)<{name}(?=[\s/>])[^>]*>"), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value; empty if there is none."""
    rx = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, rx, i) for i in (1, 2, 3)])


def tech_stack(html: Column, server: Column) -> Column:
    """Struct of cms, server (the header's) and generator (of the first meta tag that names one)."""
    made = F.nullif(_attribute(F.try_element_at(F.filter(_tags(html, "meta"), lambda m: _attribute(m, "name") == "generator"), F.lit(1)), "content"), F.lit(""))
    by_name = F.coalesce(*[F.when(F.contains(F.lower(made), F.lit(part)), F.lit(cms)) for part, cms in SYSTEMS.items()])
    has = lambda tag, attribute, part: F.exists(_tags(html, tag), lambda x: F.contains(_attribute(x, attribute), F.lit(part)))
    by_path = F.when(has("link", "href", "typo3") | has("script", "src", "typo3"), "TYPO3").when(has("link", "href", "wp-content") | has("script", "src", "wp-includes"), "WordPress")
    return F.struct(F.coalesce(by_name, by_path).alias("cms"), server.alias("server"), made.alias("generator"))


def robots_verdict(status: Column, body: Column) -> Column:
    """What a status and body mean."""
    return F.when(status == 200, F.when(protected(body), "protected").otherwise("ok")).when(status.isin(401, 403, 429), "protected").when(status == 404, "open").when(status >= 500, "error").otherwise("unknown")


#: Pages whose results a worker holds at a time.
AT_ONCE = 64


def _few(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Batches in parts of AT_ONCE pages: what is made of a page is many times its size."""
    for batch in batches:
        for i in range(0, len(batch), AT_ONCE):
            yield batch.iloc[i : i + AT_ONCE]


#: Type objects, since workers that import this module have no session to parse names with.
_TABLES = T.ArrayType(T.StructType([T.StructField("header", T.StringType()), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))]))


class _Tables(HTMLParser):
    """Rows of cells of every table, with the last heading's text before it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.heading, self.reading, self.cell, self.row, self.depth = "", False, None, None, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("h1", "h2", "h3", "h4"):
            self.reading, self.heading = True, ""
        elif tag == "table":
            self.depth += 1
            self.out.append({"header": self.heading.strip(), "rows": []})
        elif tag == "tr" and self.depth:
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = ""

    def handle_endtag(self, tag: str) -> None:
        if tag in ("h1", "h2", "h3", "h4"):
            self.reading = False
        elif tag in ("td", "th") and self.cell is not None and self.row is not None:
            self.row.append(" ".join(self.cell.split()))
            self.cell = None
        elif tag == "tr" and self.row is not None and self.out:
            self.out[-1]["rows"].append(self.row)
            self.row = None
        elif tag == "table" and self.depth:
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if self.reading:
            self.heading += data
        if self.cell is not None:
            self.cell += data


@F.pandas_udf(_TABLES)
def tables(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """M3, M6: every table with the heading before it."""
    for batch in _few(html):
        out = []
        for h in batch:
            p = _Tables()
            p.feed(h or "")
            out.append(p.out)
        yield pd.Series(out)


_PLACED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("tables", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "outer_start", "outer_end")]))),
        T.StructField("headings", T.ArrayType(T.StringType())),
    ]
)


class _Places(HTMLParser):
    """The text of a page, and where in it tables and the elements around them stand."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    SILENT = {"script", "style", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.n = 0
        self.open: list[tuple[str, int, list[list[int]]]] = []
        self.tables: list[list[int]] = []
        self.headings: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in self.VOID:
            self.open.append((tag, self.n, []))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self.open):
            while self._end() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.open or self.open[-1][0] not in self.SILENT:
            self.text.append(data)
            self.n += len(data)

    def _end(self) -> str:
        tag, start, inner = self.open.pop()
        for place in inner:
            place[2:] = [start, self.n]
        if tag == "table":
            place = [start, self.n, 0, -1]
            self.tables.append(place)
            if self.open:
                self.open[-1][2].append(place)
        elif tag in ("h2", "h3", "h4"):
            self.headings.append("".join(self.text)[start:])
        return tag

    def placed(self, html: str) -> tuple[str, list[tuple[int, ...]], list[str]]:
        self.feed(html)
        self.close()
        while self.open:
            self._end()
        ends = ((a, b, c, self.n if d < 0 else d) for a, b, c, d in self.tables)
        return "".join(self.text), sorted(ends), self.headings


@F.pandas_udf(_PLACED)
def placed(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A page's text, the places of its tables in it, and its lesser headings."""
    for batch in _few(html):
        yield pd.DataFrame([_Places().placed(h or "") for h in batch], columns=["text", "tables", "headings"])


def _plausible(years: Column) -> Column:
    return F.filter(F.transform(years, lambda y: y.try_cast("int")), lambda y: y.between(2020, 2030))


def embedded(page: Column, kind: str, year: int | None = None) -> Column:
    """M7: what a page that `placed` has read holds of a kind: struct of words, tables, has_data
    (a table with two words of the kind), years (2020 to 2030, about tables and in headings),
    confidence (0 to 1) and points for the page's rank. Pages without tables have no confidence."""
    words, points = EMBEDDED_WORDS[kind], EMBEDDED_POINTS[kind]
    low = F.lower(page["text"])
    held = lambda text, name: F.filter(F.array(*[F.lit(w) for w in words[name]]), lambda w: F.contains(text, w))
    cut = lambda a, b: F.substring(page["text"], a + 1, b - a)
    found = held(low, "page")
    has = F.exists(page["tables"], lambda t: F.size(held(F.lower(cut(t["start"], t["end"])), "table")) >= 2)
    about = F.flatten(F.transform(page["tables"], lambda t: F.regexp_extract_all(cut(t["outer_start"], t["outer_end"]), F.lit("([0-9]{4})"), F.lit(1))))
    told = F.flatten(F.transform(page["headings"], lambda h: F.array(*[F.regexp_extract(h, f"(?iu){p}", 1) for p in EMBEDDED_YEARS[kind]])))
    some = F.size(page["tables"]) > 0
    years = F.when(some, F.array_sort(F.array_distinct(_plausible(F.concat(about, told))))).otherwise(F.array().cast("array<int>"))
    wanted = F.array_contains(years, F.lit(year)) if year else F.lit(False)
    sure = F.when(has, 0.4).otherwise(0.0) + F.least(F.size(found) * 0.1, F.lit(0.3)) + F.when(wanted, 0.3).when(F.size(years) > 0, 0.1).otherwise(0.0)
    rank = F.when(has, points["table"]).otherwise(0) + F.size(found) * points["word"] + F.when(wanted, points["year"]).otherwise(0)
    return F.struct(found.alias("words"), F.size(page["tables"]).alias("tables"), has.alias("has_data"), years.alias("years"), F.when(some, F.round(sure, 9)).otherwise(0.0).alias("confidence"), rank.cast("double").alias("points"))


#: Elements that aren't stored; those without an end.
UNWANTED = {"script", "style", "nav", "footer", "header", "iframe", "form", "noscript", "svg", "button", "input", "object", "embed", "link", "meta"}
UNWANTED_VOID = {"input", "embed", "link", "meta"}


class _Cleaner(HTMLParser):
    """Tags and text without the unwanted, attributes but safe links dropped."""

    UNWANTED, VOID = UNWANTED, UNWANTED_VOID

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.off = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.UNWANTED:
            self.off += tag not in self.VOID
        elif not self.off:
            href = dict(attrs).get("href")
            self.out.append(f'<{tag} href="{href}">' if tag == "a" and href and not href.lower().strip().startswith(("javascript:", "data:")) else f"<{tag}>")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.UNWANTED:
            self.off = max(0, self.off - (tag not in self.VOID))
        elif not self.off:
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.off:
            self.out.append(data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")


@F.pandas_udf(T.StringType())
def cleaned(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """M2, M4: HTML fit for storage."""
    for batch in _few(html):
        out = []
        for h in batch:
            p = _Cleaner()
            p.feed(h or "")
            out.append("".join(p.out))
        yield pd.Series(out, dtype=object)


def without_styles(html: Column) -> Column:
    """M4: struct of html without style elements, style attributes and style sheets, and how many of each went."""
    rx_tag, rx_link = r"(?is)<style(?=[\s>]).*?</style\s*>", r"(?is)<link(?=[\s/>])(?=[^>]*\srel\s*=\s*[\"']?[^\"'>]*\bstylesheet\b)[^>]*>"
    rx_attribute = r"(?is)(<[a-z][^<>]*?)\sstyle\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    bare = F.regexp_replace(html, rx_tag, "")
    plain = F.regexp_replace(bare, rx_link, "")
    return F.struct(F.regexp_replace(plain, rx_attribute, "$1").alias("html"), F.regexp_count(html, F.lit(rx_tag)).alias("tags"), F.regexp_count(bare, F.lit(rx_attribute)).alias("attributes"), F.regexp_count(bare, F.lit(rx_link)).alias("sheets"))


def decoded(data: Column) -> Column:
    """Bytes as text by their mark, the page's own word, or UTF-8, else Latin-1."""
    head = F.lower(F.decode(F.substring(data, 1, 1024), "ISO-8859-1"))
    said = F.regexp_extract(head, r"charset\s*=\s*[\"']?([a-z0-9-]+)", 1)
    utf8 = F.try_validate_utf8(data.cast("string"))
    latin = F.decode(data, "ISO-8859-1")
    mark = F.hex(F.substring(data, 1, 3))
    return F.when(mark == "EFBBBF", F.decode(F.substring(data, 4, 2147483647), "UTF-8")).when(F.startswith(mark, F.lit("FFFE")), F.decode(F.substring(data, 3, 2147483647), "UTF-16LE")).when(said.isin("iso-8859-1", "latin1", "windows-1252"), latin).otherwise(F.coalesce(utf8, latin))
