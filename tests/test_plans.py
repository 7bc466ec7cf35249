"""How work grows: shuffles and joins of plans, and what is written."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

import pandas as pd

from gridsmith.functions import html
from gridsmith.operators import extraction
from gridsmith.plans.extraction import _export
from gridsmith.registry import load
from gridsmith.session import Tables
from gridsmith.sources import files
from gridsmith.streaming import stateful


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_meet_in_one_shuffle(spark):
    cells = spark.createDataFrame([(1, 0, ["", "Winter", "Sommer"]), (1, 1, ["MS", "08:00-09:00", "-"])], "k int, row int, cells array<string>")
    got = extraction.windows_from_cells(cells, "k")
    plan = _plan(got)
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert [(r.level, r.season, r.windows) for r in got.collect()] == [("MS", "winter", ["08:00-09:00"])]


def test_texts_are_read_where_they_stand(spark):
    df = spark.createDataFrame([(1, "NS 1 2 3 4\nHochlastzeitfenster 2024\nWinter MS 08:00-09:00")], "k int, t string")
    for got in (extraction.tariffs_from_text(df, "k", "t"), extraction.windows_from_text(df, "k", "t")):
        assert "Exchange" not in _plan(got)
        assert got.count() == 1


def test_an_export_holds_what_its_query_reads(spark):
    made = Path(_export(Tables(spark, "/root/testdata/sf0.001"), "points", "locations"))
    assert {p.name for p in made.iterdir()} == {"Netzanschlusspunkte_1.xml", "Lokationen_1.xml"}
    assert all(p.suffix == ".gz" for p in made.glob("*/part-*"))


def test_pages_are_parsed_few_at_a_time():
    page = "<h2>2025</h2><table><tr><td>a</td></tr></table>"
    for parse in (html.tables, html.placed, html.cleaned):
        sizes = [len(x) for x in parse.func(iter([pd.Series([page] * 200)]))]
        assert sum(sizes) == 200 and max(sizes) <= html.AT_ONCE


def test_members_keep_their_rows(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for n in ("a.pdf", "b.html", "c.exe"):
            z.writestr(n, n * 3)
    rows = spark.createDataFrame([(k, bytearray(held.getvalue() if k % 10 else b"no")) for k in range(100)], "k int, content binary").coalesce(1)
    got = files.members(rows, ["k"]).collect()
    assert len(got) == 190 and {(r.no, r.member, bytes(r.content)) for r in got if r.k % 10} == {(0, "a.pdf", b"a.pdf" * 3), (1, "b.html", b"b.html" * 3)}
    assert [r.member for r in got if r.k % 10 == 0] == [None] * 10


def test_first_of_a_band_is_no_sort_of_pairs(spark):
    got = load()[0]["j10_band_join"](spark, "/root/testdata/sf0.001")
    assert "Window" not in _plan(got) and "SortAggregate" not in _plan(got)


class _Handle:
    """Counts the calls that a processor makes."""

    def __init__(self):
        self.calls, self.value = 0, None

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1


def test_a_cache_is_one_value():
    handle, cache = _Handle(), stateful.Cache(1000, 500)
    cache.init(handle)
    rows = pd.DataFrame({"at": range(100), "event_id": range(100), "name": [f"d{i}" for i in range(100)]})
    (got,) = cache.handleInputRows((1,), iter([rows]), None)
    assert handle.calls == 3 and got["size"].tolist() == list(range(1, 101))
