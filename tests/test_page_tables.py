"""The table of a page that is about a year, and its rows."""

import pytest
from pyspark.sql import functions as F

from gridsmith.functions import page_tables as pt


def table(*rows, body=True):
    inner = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return f"<table>{'<tbody>' if body else ''}{inner}{'</tbody>' if body else ''}</table>"


def five(name):
    return (name, "1", "2", "3", "4")


H = "<h3>Stand 1.1.2024, gültig ab 01.01.2025</h3>"


@pytest.mark.parametrize(
    "html,first",
    [
        (table(five("x")) + H + table(five("y")), ["y"]),
        (table(five("x")) + H + "<p>a</p><p>b</p>" + table(five("y")), ["y"]),
        (table(five("x")) + H + '<div class="a table-wrapper"><div>' + table(five("y")) + "</div></div>", ["y"]),
        (table(five("x")) + H + "<div>" + table(five("y")) + "</div>" + table(five("z")), ["z"]),  # an other div is passed over
        (table(five("x")) + H + '<div class="table-wrapper">none</div>' + table(five("z")), ["x"]),
        (table(five("x")) + "<div>" + H + "</div>" + table(five("y")), ["x"]),  # no sibling
        (table(five("x")) + H.replace("2025", "2026") + table(five("y")), ["x"]),
        (table(five("x")) + H + table(five("y")) + H + table(five("z")), ["y"]),
        (table(five("x")) + "<section>" + H + "</section>" + H + table(five("y")), ["x"]),  # only the first heading counts
        (H + table(five("y"), body=False) + table(five("z")), []),
        (table(("a", "b", "c", "d"), five(""), five("k"), (*five("l"), "more")), ["k", "l"]),
        ("<p>nothing</p>", []),
        ("<table><tbody><tr><td>open<td>", []),
        ("</div></table><table><tbody>" + table(five("in"))[14:], ["in"]),
        ("", []),
    ],
)
def test_which_table(html, first):
    assert [r[0] for r in pt.records(html, 2025)] == first


def test_cells():
    row = ("<b>Hoch</b>\n  spannung&nbsp;<i>HS</i>", "<p> 8:00 </p>-<br>9:00<br/><br>", " ", "<span>a</span> <span>b</span>", "&ndash;")
    assert pt.records(table(row), 2025) == [("Hoch spannung HS", "8:00-\n9:00", None, "ab", "–")]


def test_spans():
    html = '<table><tbody><tr><td rowspan="2">HS</td><td>1</td><td colspan="2">2</td><td>3</td></tr><tr><td>4</td><td>5</td><td>6</td><td rowspan="x">7</td></tr></tbody></table>'
    assert pt.records(html, 2025) == []
    assert pt.records(html, 2025, spans=True) == [("HS", "1", "2", "2", "3"), ("HS", "4", "5", "6", "7")]
    huge = '<table><tbody><tr><td colspan="999999999">a</td></tr></tbody></table>'
    assert len(pt.records(huge, 2025, spans=True)) == 1
    assert pt.records(table(five("a"), five("b")), 2025, spans=True) == pt.records(table(five("a"), five("b")), 2025)


def test_hours_of_odd_pages(spark):
    deep = "<div>" * 5000 + table(five("deep")) + "</div>" * 5000
    rows = [(1, H + table(five("a")), 2025), (2, None, 2025), (3, "", 2025), (None, table(five("b")), 2024), (4, table(five("c")), None), (5, "<TABLE><TBODY><TR>" + "<TD>d</TD>" * 5 + "</TR></TBODY></TABLE>", 2025), (6, deep, 2025)]
    df = spark.createDataFrame(rows, "k long, h string, y int")
    got = pt.hours(df, "k", F.col("h"), F.col("y"))
    assert sorted(((r.k, r.year, r.voltage_level) for r in got.collect()), key=repr) == [(1, 2025, "a"), (5, 2025, "d"), (6, 2025, "deep"), (None, 2024, "b")]
    assert pt.hours(df.limit(0), "k", F.col("h"), F.col("y")).count() == 0
