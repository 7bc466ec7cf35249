"""Vectors for the expression library."""

import pytest
from pyspark.sql import functions as F

from gridsmith.functions import html, levels, numbers, text, times, urls


def values(spark, f, rows, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_german_number(spark):
    rows = ["1.234,56", "1234,56", "1234.56", "-", None, "1.234", "1,234.56", "k.A.", "abc", "", "1,234,567.5"]
    assert values(spark, numbers.german_number, rows) == [1234.56, 1234.56, 1234.56, None, None, 1.234, 1.23456, None, None, None, 1234567.5]


def test_years(spark):
    assert values(spark, numbers.parse_year, ["Stand 2024.", "1899", "1950", "ab", None, "2100", "2101"]) == [2024, None, 1950, None, None, 2100, None]
    assert values(spark, times.six_digit_year, ["260101", "010126", "991399", "12", None]) == [2026, 2026, None, None, None]


def test_time_window(spark):
    rows = ["7:30 - 15:30", "7:30 Uhr bis 15:30 Uhr", "k.A.", None, "07.30-15.30", "16:30 – 19:45\nentfällt\n8:00-9:00", "egal", "entfällt"]
    assert values(spark, times.time_window, rows) == ["07:30-15:30", "07:30-15:30", "-", None, "07:30-15:30", "16:30-19:45\n08:00-09:00", "egal", "-"]


def test_time_ranges(spark):
    got = values(spark, times.time_ranges, ["7:30-15:30, 18:00 20:00", "-", None, "8:00:15 — 9:00"])
    assert [[tuple(r) for r in x] if x else x for x in got] == [[("07:30:00", "15:30:00"), ("18:00:00", "20:00:00")], None, None, [("08:00:15", "09:00:00")]]


@pytest.mark.parametrize(
    ("label", "level"),
    [("110 kV / 20 kV", "HS/MS"), ("20 kV / 400 V", "MS/NS"), ("20/0,4kV", "MS/NS"), ("400 V", "NS"), ("Hochspannungsnetz", "HS"), ("Umspannung Hoch - / Mittelspannung", "HS/MS"), ("Verbrauchseinrichtung", None), ("Entnahme MS", "MS"), ("HöS/HS", "HöS/HS"), ("Mittelspannung (MSP)", "MS"), ("", None), (None, None)],
)
def test_levels(spark, label, level):
    assert values(spark, levels.normalize, [label]) == [level]


def test_expected_levels(spark):
    rows = [{"ns": 1000}, {"ns": 5000, "ms": 200}, {"hs": 100, "hoe": 10}, {"ns": 0, "ms": None}, None]
    assert values(spark, levels.expected, rows, "map<string,int>") == [["NS"], ["MS", "MS/NS", "NS"], ["HöS", "HöS/HS", "HS", "HS/MS"], [], []]


def test_completeness(spark):
    none = F.array().cast("array<string>")
    some = F.array(F.lit("MS"))
    rows = [{"ns": 5, "ms": 2}, None, {"ns": 0}]
    assert [r.score for r in values(spark, lambda x: levels.completeness(x, some, none), rows, "map<string,int>")] == [33, 100, 100]
    assert [r.score for r in values(spark, lambda x: levels.completeness(x, none, none), rows, "map<string,int>")] == [0, 0, 0]


def test_address_key(spark):
    import hashlib

    want = hashlib.sha256(b"musterstr|5|12345").hexdigest()
    assert set(values(spark, lambda x: text.address_key(x, F.lit("12345")), ["Musterstraße 5", "Musterstr. 5", "MUSTERSTRASSE  5"])) == {want}


def test_names(spark):
    assert values(spark, text.slug, ["Stadtwerke Köln GmbH", "--ß--", None]) == ["stadtwerke-koeln-gmbh", "ss", None]
    assert values(spark, text.company_name, ["Netze AG & Co. KG 2023", "EWE"]) == ["netze", "ewe"]
    assert values(spark, lambda x: text.clean_string(x, 10), ["  a  b ", "", "0123456789ab"]) == ["a b", None, "0123456..."]
    assert values(spark, text.file_type, ["Preisblatt_Strom_2024.pdf", "hlzf-2024.pdf", "x.pdf"]) == ["netzentgelte", "hlzf", None]
    assert values(spark, text.file_year, ["20201026_X_2021.pdf", "260101_P.pdf", "x"]) == [2021, 2026, None]
    assert values(spark, text.client_ip, ["a, b, c", "a"]) == ["c", "a"]


def test_urls(spark):
    rows = ["HTTP://WWW.Example.com:80//a//b?utm_source=x&b=2&a=1&ref=q#top", "https://x.de", "kein", None]
    assert values(spark, urls.normalize, rows) == ["http://www.example.com/a/b?a=1&b=2", "https://x.de/", "kein", None]
    assert values(spark, urls.domain, rows[:3]) == ["example.com", "x.de", None]
    assert values(spark, urls.safe, ["https://x.de/a", "ftp://x.de", "https://u:p@x.de/", "https://x.de:22/"]) == [True, False, False, False]
    got = values(spark, urls.path_patterns, ["https://dno.de/downloads/2023/strom/preisblatt.pdf"])[0]
    assert {"/downloads/{year}/strom/", "/downloads/", "/downloads/{year}/", "/strom/"} <= set(got)
    assert values(spark, lambda x: urls.year_bonus(x, 2024, 2025), ["https://x.de/2024/a", "https://x.de/2010/a", "https://x.de/a", "https://x.de/2016/"]) == [50, -30, 0, 3]


def test_html(spark):
    page = "<h2>Preise 2024</h2><nav>x</nav><table><tr><th>A</th><td>1 <b>2</b></td></tr></table><script>no</script><a href='b.html'>Link</a>"
    assert values(spark, html.text_of, [page, None]) == ["Preise 2024 A 1 2 Link", None]
    t = values(spark, html.tables, [page])[0]
    assert t[0].header == "Preise 2024" and t[0].rows == [["A", "1 2"]]
    assert values(spark, html.cleaned, ['<div class="a"><script>x</script><a href="javascript:x">t</a></div>']) == ["<div><a>t</a></div>"]
    assert [(x.href, x.text) for x in values(spark, html.links, [page])[0]] == [("b.html", "Link")]
    base = F.lit("https://x.de/d/e.html?q")
    assert values(spark, lambda x: html.resolve(base, x), ["b.html", "/c", "//y.de/z", "https://z.de/"]) == ["https://x.de/d/b.html", "https://x.de/c", "https://y.de/z", "https://z.de/"]
    r = values(spark, html.robots, ["User-agent: a\nDisallow: /x\n\nUser-agent: *\nDisallow: /y\nSitemap: https://x.de/s.xml"])[0]
    assert (r.sitemaps, r.disallow) == (["https://x.de/s.xml"], ["/y"])


def test_trigrams(spark):
    from gridsmith.operators.search import similarity, trigrams

    got = values(spark, lambda x: similarity(trigrams(x), trigrams(F.lit("two words"))), ["word", "", "two words"])
    assert [round(x, 4) for x in got] == [0.3636, 0.0, 1.0]


def test_verification_of_kinds(spark):
    """By hand: words for and against, caps without a required word and without data."""
    from gridsmith.functions import verification

    rows = [
        ("Preisblatt: Leistungspreis 12,34 €/kW, Arbeitspreis 5,67 ct/kWh", "netzentgelte", True),
        ("Leistungspreis 12,34 €/kW, Arbeitspreis 5,67 ct/kWh", "netzentgelte", False),
        ("Netzentgelte und Preise der Netznutzung", "netzentgelte", True),
        ("Hochlastzeitfenster: Winter 08:00 - 20:00 Uhr", "hlzf", True),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, kind string, want boolean")
    both = df.select("i", "kind", *(verification.verified(F.col("text"), kinds=[k])[0].alias(k) for k in ("netzentgelte", "hlzf")), verification.detected(F.col("text")).alias("told"))
    got = {r.i: r for r in both.collect()}
    assert [got[i][k].is_verified or False for i, (_, k, _) in enumerate(rows)] == [w for *_, w in rows]
    # more words than three in ten, four of six patterns
    assert got[0].netzentgelte.confidence == 0.833333333 and got[1].netzentgelte.confidence == 0.3
    assert (got[2].netzentgelte.confidence, got[2].netzentgelte.has_data) == (0.416666667, False)
    assert (got[0].told, got[3].told) == ("netzentgelte", "hlzf")
    assert got[3].netzentgelte.confidence == 0.0
