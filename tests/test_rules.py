"""Rules of safety, formats, bounds, archives and jobs on hand-written rows."""

import html as stdlib_html
import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from gridsmith.catalogs import DANGEROUS
from gridsmith.functions import html, text, times, validation
from gridsmith.operators import discovery, extraction
from gridsmith.sources import files

HARM = re.compile("|".join(DANGEROUS), re.IGNORECASE)
TEXTS = [
    "plain", "", "<SCRIPT>", "a\x00b", "java\x01script:x", "VBScript: x", "<a onmouseover=1>", "on = 1", "ontology = x", "conversion=1", "one=1", "data:text/html,x", "DATA:application/pdf", "data:image/png", "width: expression (1)", "url('javascript:1')", "url(x)",
    "&#x41;", "&amp;", "a < b & 'c' \"d\"", "tab\tline\n", "bell\x07", "x" * 40, "x" * 41, "größe onä=1", None,
]


def test_sanitized(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: (r.s.value, r.s.error) for r in df.select("i", text.sanitized(F.col("t"), 40).alias("s")).collect()}
    for i, t in enumerate(TEXTS):
        plain = t and "".join(ch for ch in t if ch >= " " or ch in "\n\t")
        want = (None, None) if t is None else (None, "too long") if len(t) > 40 else (None, "dangerous content") if HARM.search(plain) else (stdlib_html.escape(plain), None)
        assert got[i] == want, t


def test_sanitized_rows(spark):
    rows = [(1, "ok", "07:00-8:00", "<script>"), (2, "<script>", "", None), (3, None, "-", None), (4, "x", "7:00", None), (5, "onclick=", "07:00-08:00x", None)]
    df = spark.createDataFrame(rows, "k int, name string, w string, other string")
    got = {r.k: (r.name, r.w, r.other, r.errors) for r in text.sanitized_rows(df, ["name"], ["w"]).collect()}
    assert got == {1: ("ok", "07:00-8:00", "<script>", []), 2: (None, "", None, ["name: dangerous content"]), 3: (None, "-", None, []), 4: ("x", None, None, ["w: no time window"]), 5: (None, None, None, ["name: dangerous content", "w: no time window"])}


@pytest.mark.parametrize("body,kind", [("Just a Moment ... CLOUDFLARE", "cloudflare"), ("window.cf_chl_opt", "cloudflare"), ("__cf_bm", "javascript_required"), ("DDoS protection by x", "javascript_required"), ("ddos protection", None), ('<META HTTP-EQUIV="refresh" content="/challenge">', "javascript_challenge"), ('<meta http-equiv="refresh">', None), ("cloudflare", None), ("", None), (None, None)])
def test_protection(spark, body, kind):
    assert spark.createDataFrame([(body,)], "b string").select(html.protection(F.col("b"))).first()[0] == kind


def test_tech_stack(spark):
    rows = ['<meta name="generator" content="TYPO3 4">', '<meta name="generator"><meta name="generator" content="Drupal">', '<link data-href="/typo3/x" href="/a">', "<script src=/wp-includes/a.js>", '<script src="/wp-content/a.js">', "<meta content='Wix' name='generator'>", '<metadata name="generator" content="TYPO3">', "", None]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(rows)], "i int, h string")
    got = [(r.t.cms, r.t.generator, r.t.server) for r in df.select("i", html.tech_stack(F.col("h"), F.lit("s")).alias("t")).orderBy("i").collect()]
    assert got == [("TYPO3", "TYPO3 4", "s"), (None, None, "s"), (None, None, "s"), ("WordPress", None, "s"), (None, None, "s"), ("Wix", "Wix", "s"), (None, None, "s"), (None, None, "s"), (None, None, "s")]


@pytest.mark.parametrize(
    "content,kind,url,want",
    [
        (b"%PDF-1", "text/html", "a.zip", "pdf"), (b"\xd0\xcf\x11\xe0x", "", "", "xls"), (b"PK\x03\x04" + b"x" * 9000 + b"workbook.xml", "", "a.zip", "xlsx"), (b"PK\x03\x04" + b"x" * 10_000 + b"word/", "", "a.zip", "zip"), (b"PK\x03\x04word/", "", "a.zip", "docx"), (b"PK\x03\x04", "", "A.ZIP?x", "zip"), (b"PK\x03\x04", "", "a", "xlsx"),
        (b"x", "application/PDF", "a.xls", "pdf"), (b"x", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "", "xlsx"), (b"x", "application/zip", "", "zip"), (b"x", "application/xhtml+xml", "a.pdf", "html"), (b"x", "", "/d/a.DOCX?v=1", "docx"), (b"x", None, None, "html"), (b"", "", "a.htm", "html"), (None, "", "a.pdf", "pdf"),
    ],
)
def test_formats(spark, content, kind, url, want):
    df = spark.createDataFrame([(content and bytearray(content), kind, url)], "c binary, k string, u string")
    assert df.select(files.file_format(F.col("c"), F.col("k"), F.col("u"))).first()[0] == want


def test_kept_downloads(spark):
    rows = [("j", k, f"u{k}", bytearray(b"x" * n), "text/html") for k, n in enumerate([5, 5, 50, 7, 9, 4, 3, 2])] + [("other", 0, "v", bytearray(b"xxxxx"), ""), ("other", 1, "w", None, "")]
    df = spark.createDataFrame(rows, "job string, k int, url string, content binary, content_type string")
    got = files.kept_downloads(df, "job", F.col("k"), most=10, total=20, count=7).collect()
    # the second repeats the first, the third is too large, 5 + 7 + 9 reach the total, the eighth isn't looked at
    assert sorted((r.job, r.url, r.size) for r in got) == [("j", "u0", 5), ("j", "u3", 7), ("j", "u4", 9), ("other", "v", 5)]


def packed(entries):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return held.getvalue()


def test_expanded_archives(spark):
    good = packed([("a b.pdf", b"%PDF"), ("deep/x.HTM", "<p onclick='x'>größe</p><script>1</script>".encode()), ("c.exe", b"x"), ("empty.csv", b""), ("d/", b"")])
    rows = [("j", "s", 0, "p0", "zip", "u0", good), ("j", "s", 1, "p1", "zip", "u1", b"no zip"), ("j", "s", 2, "p2", "pdf", "u2", b"%PDF"), ("j", "s", 3, "p3", "zip", "u3", packed([("x.txt", b"x")])), ("j", "s", 4, "p4", "zip", "u4", packed([("e.csv", b"1;2")]))]
    rows += [("k", "t", 0, "q0", "zip", "v0", packed([("x.txt", b"x")])), ("k", "t", 1, "q1", "zip", "v1", None)]
    df = spark.createDataFrame([(*r[:-1], r[-1] and bytearray(r[-1])) for r in rows], "job string, slug string, k int, path string, format string, url string, content binary")
    got = {(r.job, r.path, r.format, r.url, r.member) for r in files.expanded(df, "job", "slug").collect()}
    assert got == {
        ("j", "s_zip_00_a_b.pdf", "pdf", "u0", "a b.pdf"), ("j", "s_zip_01_x.HTM", "html", "u0", "deep/x.HTM"), ("j", "s_zip_02_e.csv", "html", "u4", "e.csv"), ("j", "p1", "zip", "u1", None), ("j", "p2", "pdf", "u2", None), ("k", "q0", "zip", "v0", None), ("k", "q1", "zip", "v1", None),
    }
    page = next(r for r in files.expanded(df, "job", "slug").collect() if r.format == "html" and r.member == "deep/x.HTM")
    assert bytes(page.content).decode() == "<p>größe</p>"


def test_bounds(spark):
    price = "request int, k int, year int, voltage_level string, leistung double, arbeit double, leistung_unter_2500h double, arbeit_unter_2500h double, verification_status string"
    rows = [(1, 1, 2025, "MS", 1.0, None, 0.0, 1e6, None), (1, 2, 1999, "XX", -1.0, 1e7, None, float("nan"), "done"), (1, 3, 2100, "HöS/HS", None, None, None, None, "flagged"), (2, 4, None, None, None, None, None, None, "verified"), (3, 5, 2000, "NS", None, None, None, None, None)]
    got = {r.k: r.errors for r in validation.checked(spark.createDataFrame(rows, price), validation.price_errors(), "request").collect()}
    assert got == {1: ["request"], 2: ["year", "voltage_level", "verification_status", "leistung", "arbeit", "arbeit_unter_2500h"], 3: ["request"], 4: ["year", "voltage_level"], 5: []}
    many = spark.range(501).selectExpr("7 as request", "cast(id as int) as k", "2025 as year", "'MS' as voltage_level", "cast(null as double) as leistung", "cast(null as double) as arbeit", "cast(null as double) as leistung_unter_2500h", "cast(null as double) as arbeit_unter_2500h", "cast(null as string) as verification_status")
    assert {tuple(r.errors) for r in validation.checked(many, validation.price_errors(), "request").collect()} == {("records",)}
    w = "array<struct<start:string,end:string>>"
    hours = [(1, [("07:00:00", "08:00:00")], None, [], None), (2, [("25:00:00", "08:00:00")], [("7:00:00", "08:00:00")], None, [("07:00:00", "08:00:00")] * 11), (3, [(None, "08:00:00")], None, None, None)]
    df = spark.createDataFrame(hours, f"k int, winter {w}, fruehling {w}, sommer {w}, herbst {w}").selectExpr("*", "2025 as year", "'MS' as voltage_level", "cast(null as string) as verification_status")
    assert {r.k: r.e for r in df.select("k", validation.window_errors().alias("e")).collect()} == {1: [], 2: ["winter", "fruehling", "herbst"], 3: ["winter"]}


def test_extract_jobs(spark):
    f = "struct<path:string,format:string,source_url:string>"
    rows = [(1, "op", 2025, 5, {"slug": "s", "strategy": "crawl"}, {"hlzf": ("p", "pdf", "u"), "hlzf:2024": ("q", "pdf", "v")}), (2, "op", 2025, 5, None, {"netzentgelte": ("r", "html", None)}), (3, "op", 2025, 5, {}, {}), (4, "op", 2025, 5, {}, None)]
    got = discovery.extract_jobs(spark.createDataFrame(rows, f"job int, operator string, year int, priority int, context map<string,string>, files map<string,{f}>")).collect()
    assert {(r.parent, r.kind, r.context["downloaded_file"], r.context["strategy"], r.context.get("slug")) for r in got} == {(1, "hlzf", "p", "classified", "s"), (2, "netzentgelte", "r", "classified", None)}


def test_known_documents(spark):
    rows = [(1, " Netze BW ", "netzentgelte", 2025), (2, "netze bw", "netzentgelte", 2023), (3, "netze", "netzentgelte", 2025), (4, None, None, None)]
    got = {r.k: r.address for r in discovery.known_documents(spark.createDataFrame(rows, "k int, n string, t string, y int"), "n", "t", "y").collect()}
    assert got[1].endswith("netzentgelte-strom-2025.pdf") and [got[k] for k in (2, 3, 4)] == [None] * 3


def test_clock_pairs(spark):
    r = random.Random(2)
    rows = ["", "07:30-15:30", "7:30 – 15:30 16:00 18:00", "07:30 Uhr - 08:00", "07:30 Uhr 08:00 09:00", "(07:30-08:00),09:00—10:00", "123:45-1:00", None] + ["".join(r.choice(["07:00", "8:30", " ", "-", "x", "–", "\n", ","]) for _ in range(12)) for _ in range(60)]
    got = [x.p for x in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", times.clock_pairs(F.col("t")).alias("p")).orderBy("i").collect()]
    for t, p in zip(rows, got, strict=True):
        if t is None:
            assert p is None
        elif not re.search(r"[-–—‐]\s*[-–—‐]|\d\d:|:\d+:|\d{3}|\d\d:\d\d\d", t.replace("07:00", "").replace("8:30", "")):
            held, want = None, []
            for tok in re.findall(r"\d{1,2}:\d{2}|[^\s\-–—‐]", t):
                if ":" not in tok or len(tok) < 4:
                    held = None
                elif held:
                    want.append((held, tok))
                    held = None
                else:
                    held = tok
            assert [(x.start, x.end) for x in p] == want, t


def test_tariff_sections(spark):
    texts = [
        "Netzentgelte bis zu 2.500 Stunden pro Jahr\nMittelspannung (MSP) 10,5 EUR/kW 1,1 Ct/kWh\nNiederspannung 7 € / kW\nüber 2500 Stunden\nMittelspannung 20,5EUR/kW\nHochspannung 9 EUR/kWh 3,3 ct / kWh",
        "Über 2.500 Stunden:\nMittelspannung 1 EUR/kW\nbis 2500 Stunden\nMittelspannung 2 EUR/kW\n",
        "bis zu 2.500 Kunden\nMittelspannung 1 EUR/kW",
        "bis\tzu 2.500\tStunden\nMittelspannung 1 EUR/kW\nMittelspannung 3 EUR/kW",
        "", None,
    ]
    got = extraction.tariff_sections(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string"), "k", "t").collect()
    rows = {(r.k, r.level): (r.leistung_unter_2500h, r.arbeit_unter_2500h, r.leistung, r.arbeit) for r in got}
    assert rows == {(0, "MS"): (10.5, 1.1, 20.5, None), (0, "NS"): (7.0, None, None, None), (0, "HS"): (None, None, None, 3.3), (1, "MS"): (2.0, None, 1.0, None), (3, "MS"): (3.0, None, None, None)}


def test_price_warnings_and_sane_files(spark):
    rows = [("0,005", "500"), ("20", "500,01"), (" - ", "x"), (None, "Entfällt"), ("1.000,5", "-1"), ("k.A.", "0")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    got = [r.w for r in df.select("i", validation.price_warnings(F.col("a"), F.col("b")).alias("w")).orderBy("i").collect()]
    assert got == [["arbeit: unusual"], ["leistung: unusual"], ["leistung: not a number"], [], ["arbeit: not a number", "leistung: unusual"], ["arbeit: not a number"]]
    records = [("a", "netzentgelte", "1", None), ("b", "netzentgelte", "1", None), ("b", "netzentgelte", "-", " keine "), ("c", "netzentgelte", "1", None), ("c", "netzentgelte", None, "2"), ("d", "hlzf", None, None), ("d", "hlzf", None, None), ("e", "hlzf", None, None)]
    df = spark.createDataFrame([(*r, None, None) for r in records], "f string, kind string, leistung string, arbeit string, leistung_unter_2500h double, arbeit_unter_2500h double")
    assert {r.f: r.verdict for r in validation.sane_files(df, "f", "kind").collect()} == {"a": "too few records", "b": "too few prices", "c": "ok", "d": "ok", "e": "too few records"}


def test_canonical_names(spark):
    rows = [("s", "hlzf:2024", 2022, 2025, "/d/a.b.PDF", "pdf"), ("s", "netzentgelte", None, 2025, "/d.x/file", "xlsx"), ("s", "hlzf", 2023, 2025, ".pdf", "html"), ("s", "hlzf:x", None, 2025, "a.xls", "xls")]
    df = spark.createDataFrame(rows, "s string, k string, d int, y int, p string, f string")
    assert [r[0] for r in df.select(files.canonical_name(*(F.col(x) for x in "skdypf"))).collect()] == ["s-hlzf-2024.PDF", "s-netzentgelte-2025.xlsx", "s-hlzf-2023.html", "s-hlzf-2025.xls"]


def test_without_styles(spark):
    page = '<STYLE>a</STYLE><p Style="x > y" id=1>style="kept"</p><i style=\'z\' style=w><link href=a rel=stylesheet/><link rel="icon"><style-x>b</style-x><a data-style="k">'
    r = spark.createDataFrame([(page,)], "h string").select(html.without_styles(F.col("h")).alias("s")).first().s
    assert (r.tags, r.sheets) == (1, 1) and 'style="kept"' in r.html and "<style-x>" in r.html and 'data-style="k"' in r.html and "x > y" not in r.html and "stylesheet" not in r.html


def test_details_of_companies(spark):
    from gridsmith.sources import listing

    json = "application/json"
    rows = [
        (1, json, '{"Result":"OK","Records":[{"BdewCode":"1","MarketFunctionName":"Lieferant"},{"BdewCode":"2","MarketFunctionName":"Verteilnetzbetreiber"},{"BdewCode":"3","MarketFunctionName":"Netzbetreiber","ContactName":"c"},{"BdewCode":"4","MarketFunctionName":"Netzbetreiber"}]}'),
        (2, "application/JSON; x", '{"Result":"OK","Records":[{"BdewCode":"5"},{"BdewCode":"6","MarketFunctionName":"Lieferant"}]}'),
        (3, "text/html", '{"Result":"OK","Records":[{"BdewCode":"7"}]}'), (4, json, '{"Result":"ERROR","Records":[{"BdewCode":"8"}]}'), (5, json, '{"Result":"OK","Records":[]}'), (6, json, "no JSON"), (7, json, '{"Result":"OK","Records":[{"BdewCode":"","MarketFunctionName":"Netzbetreiber"},{"BdewCode":"9"}]}'), (8, None, None),
    ]
    df = spark.createDataFrame([(i, i, "n", k, b) for i, k, b in rows], "id long, company_uid long, company_name string, content_type string, body string")
    assert {(r.id, r.bdew_code, r.market_function, r.contact_name) for r in listing.details(df).collect()} == {(1, "3", "Netzbetreiber", "c"), (2, "5", None, None)}
