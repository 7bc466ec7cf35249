"""Every registered query against its SQL over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from gridsmith.registry import load
from verify import plain

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    QUERIES[name](spark, SF).collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name, table", [("c9_tariffs_from_text", "part"), ("c12_windows_from_text", "events"), ("g14_flags_and_lists", "lineitem"), ("s11_parquet_seed", "customer"), ("n9_coordinate_snap", "customer"), ("x8_search_waterfall", "orders"), ("k7_import_merge", "orders")])
def test_whole_tables(spark, con, name, table):
    """Every row has its result."""
    key = {"part": "p_partkey", "events": "event_id", "lineitem": "l_orderkey", "customer": "c_custkey", "orders": "o_orderkey"}[table]
    got = QUERIES[name](spark, SF)
    mine = "k" if name == "k7_import_merge" else key
    assert {r[0] for r in got.select(mine).collect()} == {r[0] for r in con.execute(f"SELECT {key} FROM {table}").fetchall()}


def test_windows_of_the_pages_own_html(spark, tmp_path):
    """Tables that a page holds itself, each by itself."""
    rows = lambda a: f"<table><tr><th>Ebene</th><th>Winter</th><th>Sommer</th></tr><tr><td>{a}</td><td>08:00 - 12:00</td><td>-</td></tr></table>"
    spark.createDataFrame([(1, "u", rows("Mittelspannung") + rows("Hochspannung")), (2, "v", "<p>none</p>"), (3, "w", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["m6_html_windows_whole"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.no, r.level, r.season) for r in got) == [(1, 0, "MS", "winter"), (1, 1, "HS", "winter")]
